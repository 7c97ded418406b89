"""Approximate nearest neighbours by inner product: inverted lists, scanned dimension by dimension.

Centroids are fitted on a bounded sample; every vector goes to its nearest centroid's list. How many lists a query probes is
what reaches the target recall against brute force on vectors that the centroids were not fitted on. Within a list, vectors and
queries are turned by one random rotation, and distances grow block of columns by block of columns: after each, a candidate whose
partial distance makes it unlikely to reach the query's bound is abandoned (a test on the partial sum of squares, which a rotation
spreads evenly over columns). Survivors are scored exactly, in double precision, on the original vectors.

A query's bound is the score of its k-th best so far. It asks its nearest list first; what it finds there is its bound in the other
lists, and within a list the bound rises with every slice of vectors. Queries that end with fewer than k rows ask all lists.

Long lists are cut into blocks, and so are the queries of a list, so that a list with a third of all vectors is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import materialised, small


@dataclass(frozen=True)
class Settings:
    """``sample``: vectors that fitting takes at most. ``lists``: at most; the root of the number of vectors or an eighth of those
    fitted on, if that is less. ``held``: further vectors, not for fitting, on which the probes reach ``recall``. ``epsilon``: how far a
    partial distance must be off, in standard deviations, before a candidate is abandoned. ``columns``: of a block. ``few``: at what share
    of pairs left they are looked at one by one. ``slice``: vectors after which bounds rise. ``block``, ``queries``: rows of a task's
    group, about."""

    sample: int = 65_536
    lists: int = 8192
    held: int = 4096
    recall: float = 0.985
    epsilon: float = 3.0
    columns: int = 16
    few: float = 0.05
    slice: int = 512
    block: int = 2048
    queries: int = 2048


def usable(vector: Column, dim: int) -> Column:
    """Neither null nor zero, of the table's dimension, with finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class Index:
    """Centroids, the rotation and the number of probes."""

    def __init__(self, sample: np.ndarray, total: int, settings: Settings, k: int):
        rng = np.random.default_rng(7)
        self.dim, self.settings = sample.shape[1], settings
        order = rng.permutation(len(sample))
        cut = min(settings.held, len(sample) // 5)
        held, fitted = (sample[order[:cut]], sample[order[cut:]]) if cut > 1 else (sample, sample)
        n = int(max(1, min(settings.lists, round(total**0.5), len(fitted) // 8)))
        self.centroids = fitted[rng.permutation(len(fitted))[:n]].copy()
        for _ in range(8):
            near = self.nearest(fitted)
            sums, sizes = np.zeros_like(self.centroids), np.bincount(near, minlength=n)
            np.add.at(sums, near, fitted)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        self.probes = self._needed(held, rng, max(1, -(-k * len(held) // total)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        near = np.empty(len(x), np.int64)
        half = (self.centroids**2).sum(1) / 2
        for i in range(0, len(x), 1024):
            near[i : i + 1024] = (x[i : i + 1024] @ self.centroids.T - half).argmax(1)
        return near

    def probed(self, q: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists whose centroids have the largest inner products, for each query."""
        products = q @ self.centroids.T
        return np.argsort(-products, axis=1, kind="stable")[:, :n]

    def _needed(self, sample: np.ndarray, rng: np.random.Generator, k: int) -> int:
        """Probes that find the target share of the ``k`` nearest neighbours within ``sample``: as many as a query's neighbours among all
        vectors leave in a sample of this size."""
        picked = rng.permutation(len(sample))[:1000]
        near, order = self.nearest(sample), self.probed(sample[picked], len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        products = sample[picked] @ sample.T
        products[np.arange(len(picked)), picked] = -np.inf
        best = np.argsort(-products, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
        ranks = np.sort(np.take_along_axis(place, near[best], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(len(ranks) * self.settings.recall))]) + 1


def _survivors(vectors: np.ndarray, squares: np.ndarray, queries: np.ndarray, squares_q: np.ndarray, limits: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of (turned) vectors whose product may reach the query's limit.

    While many pairs are left, a block of columns is one product of matrices; then only the pairs left are looked at.
    """
    dim = vectors.shape[1]
    total = squares_q[:, None] + squares[None, :]
    limit = np.where(np.isinf(limits), 0.0, limits)[:, None]
    bound = np.where(np.isinf(limits)[:, None], np.inf, total - 2 * limit) + 1e-9 * (total + np.abs(limit))
    partial, which, rows = np.zeros_like(total), None, None
    for c in range(0, dim, settings.columns):
        cut = slice(c, min(dim, c + settings.columns))
        allowed = 1.0 if cut.stop == dim else (1 + settings.epsilon / cut.stop**0.5) ** 2 * cut.stop / dim
        if which is None:
            part, part_q = vectors[:, cut], queries[:, cut]
            partial += (part_q**2).sum(1)[:, None] + (part**2).sum(1)[None, :] - 2 * (part_q @ part.T)
            left = partial <= allowed * bound + 1e-9 * total
            partial[~left] = np.inf
            if cut.stop == dim or left.mean() < settings.few:
                which, rows = np.nonzero(left)
                partial, bound = partial[which, rows], bound[which, rows]
        else:
            partial = partial + ((vectors[rows, cut] - queries[which, cut]) ** 2).sum(1)
            left = partial <= allowed * bound + 1e-9
            which, rows, partial, bound = which[left], rows[left], partial[left], bound[left]
    return which, rows


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int, settings: Settings):
    """For each query its ``k`` nearest among ``vectors`` that score ``bounds`` or more: arrays of query ids, ids and scores. Equal
    scores go by id.

    Queries go in chunks, vectors in slices; after each slice a query's bound rises to the ``k``-th best that it has found.
    """
    turned, turned_q = vectors @ rotation, queries @ rotation
    squares, squares_q = (vectors**2).sum(1), (queries**2).sum(1)
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(queries), 128):
        chunk = slice(lo, lo + 128)
        q, own, best = queries[chunk], query_ids[chunk], np.full((len(queries[chunk]), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(vectors), settings.slice):
            part = slice(at, at + settings.slice)
            which, rows = _survivors(turned[part], squares[part], turned_q[chunk], squares_q[chunk], np.maximum(bounds[chunk], best.min(1)), settings)
            rows = rows + at
            other = ids[rows] != own[which]
            which, rows = which[other], rows[other]
            scores = (vectors[rows] * q[which]).sum(1)
            found.append((which, rows, scores))
            new = np.full((len(q), len(squares[part])), -np.inf)
            new[which, rows - at] = scores
            best = np.partition(np.concatenate([best, new], axis=1), new.shape[1], axis=1)[:, -k:]
        which, rows, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        top = np.lexsort((ids[rows], -scores, which))
        which, rows, scores = which[top], rows[top], scores[top]
        kept = np.arange(len(which)) - np.searchsorted(which, which) < k
        out.append((own[which[kept]], ids[rows[kept]], scores[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_neighbours(table: DataFrame, k: int = 20, every: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, its ``k`` nearest among all rows of other ids.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part, nor do rows
    without an id. A query's id on several rows asks once, with the least of their vectors. Equal scores go to the smaller id. Fewer candidates than ``k`` are all returned; an empty table gives no rows.
    """
    spark: SparkSession = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["n"]
    rows = rows.where(usable(F.col("v"), dim))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], out)
    most = settings.sample + settings.held
    # by a hash of ids, each id once: copies of a row weigh no more than one, and no task or driver sees more than the sample
    share = int((1 << 30) * min(1.0, most / total))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).groupBy("id").agg(F.min("v").alias("v")).limit(most).toArrow()
    if not drawn.num_rows:
        drawn = rows.limit(1).toArrow()
    index = Index(_matrix(drawn.sort_by("id")["v"].combine_chunks(), dim), total, settings, k)
    probes = index.probes

    def assigned(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim) if batch.num_rows else np.empty((0, dim))
            yield pa.RecordBatch.from_arrays([pa.array(index.nearest(x), pa.int64()), batch.column(0), batch.column(1)], names=["list", "id", "v"])

    def probing(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim) if batch.num_rows else np.empty((0, dim))
            for i in range(0, len(x), 256):
                near = index.probed(x[i : i + 256], probes)
                at = pa.array(np.repeat(np.arange(i, i + len(near)), near.shape[1]))
                turn = pa.array(np.tile(np.arange(near.shape[1]), len(near)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int64()), batch.column(0).take(at), batch.column(1).take(at), turn], names=["list", "id", "v", "turn"])

    schema = "list bigint, id bigint, v array<double>"
    stored = materialised(rows.mapInArrow(assigned, schema).withColumn("nth", F.monotonically_increasing_id()), "lists")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialised(queries.mapInArrow(probing, f"{schema}, turn int"), "probes")

    def searched(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        a, b, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if vectors.num_rows and queries.num_rows:
            (x, ids), (q, query_ids) = ((_matrix(t["v"].combine_chunks(), dim), t["id"].to_numpy()) for t in (vectors, queries))
            a, b, c = scan(x, ids, q, query_ids, queries["reach"].to_numpy(), index.rotation, k, settings)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # as many rows as lists: how many blocks a list's vectors and its queries are cut into
    cut = materialised(stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("blocks")), "cut")

    def best(asked: DataFrame) -> DataFrame:
        parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.queries).cast("int").alias("parts"))
        plan = small(materialised(cut.join(parts, "list"), "plan"))
        left = stored.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("nth"), "blocks").cast("int")).withColumn("part", numbers(F.col("parts")))
        right = asked.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int")).withColumn("block", numbers(F.col("blocks")))
        key = ["list", "block", "part"]
        near = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "id", "v", "reach").groupBy(*key)).applyInArrow(searched, "query_id bigint, vec_id bigint, score double")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    free = F.lit(float("-inf")).alias("reach")
    first = materialised(best(asked.where("turn = 0").select("list", "id", "v", free)), "first")
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("_id"), "least")
    bounded = asked.where("turn > 0").join(small(reached), F.col("id") == F.col("_id"), "left").select("list", "id", "v", F.coalesce("least", free).alias("reach"))
    both = first.unionByName(best(bounded)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    both = materialised(both, "nearest")
    full = both.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = materialised(queries.join(small(full), F.col("id") == F.col("query_id"), "left_anti"), "short")
    if not short.count():
        return both
    # as many rows as short queries and lists: all of them only where the table has no more than k candidates
    everywhere = short.join(F.broadcast(cut.select("list"))).select("list", "id", "v", free)
    again = best(materialised(everywhere, "everywhere"))
    return both.join(small(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(again)
