"""Jaccard self-join on word n-grams by a MinHash LSH forest with exact verification.

1. Each text becomes its set of hashed shingles and, for each tree, a label: a sequence of min-hashes. Texts of one set are one *class
   of copies* from there on: a group of copies of any size is one row.
2. The labels of all trees are sorted, over range partitions: each tree lies there as a prefix trie, and the longest prefix that a
   text shares with any other is the longer of those that it shares with its two neighbours. Rows at the ends of partitions get
   their outer neighbours afterwards. Texts that share too little with their neighbours in a tree are gone from it at this point.
3. The matched prefixes are shortened, level by level, until the forest reaches the target recall for the text's *least possible* link.
   That is a matter of its size: a set of six shingles is linked to another one from 5/6 on, so that longer prefixes do, and one of
   three to none; large sets can come close to the threshold. Texts meet in the trie's nodes at these depths; nodes of several trees
   that hold the same texts are looked at once.
4. Within a node, signatures are compared, in blocks; what cannot reach the threshold is dropped. What is left makes
   candidate groups.
5. Within a candidate group, shingle sets are intersected exactly, block by block. A task returns for each of its texts the
   number of its links and the smallest text it is tied to: as many rows as texts, not as pairs. No link between different
   texts is left out, and none is assumed.
6. Links make classes (connected components).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import NOT_SPACE, materialised, packed_row, small, small_batches, step, text_of, unpacked
from rankloom.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``width`` words of a shingle. ``threshold``: links have at least this similarity. ``trees`` with labels of ``deepest`` values, and
    the recall they must reach. ``sigmas``: how far, in standard deviations, an estimate may lie under the threshold. ``block``,
    ``exact_block``: texts of a block of signatures and of shingle sets."""

    width: int = 5
    threshold: Fraction = Fraction(4, 5)
    trees: int = 32
    deepest: int = 8
    recall: float = 0.9999
    sigmas: float = 5.0
    block: int = 1024
    exact_block: int = 256

    def least_link(self, size: int) -> Fraction | None:
        """The least similarity from the threshold on that a set of ``size`` elements can have with a different one; None if it has no such."""
        t, found = self.threshold, []
        for other in range(ceil(t * size), int(size / t) + 1):
            common = ceil(t * (size + other) / (1 + t))
            if common <= min(size, other) and not common == size == other:
                found.append(Fraction(common, size + other - common))
        return min(found, default=None)

    def depth(self, similarity: float) -> int:
        """The deepest prefix at which two texts of this similarity meet in some tree with the target probability."""
        depth = self.deepest
        while depth > 1 and 1 - (1 - similarity**depth) ** self.trees < self.recall:
            depth -= 1
        return depth

    @cached_property
    def stops(self) -> np.ndarray:
        """To which depth a text's prefixes are shortened, by the size of its set; sets beyond this array are like its last entry. One more
        than the deepest: the text has no links."""
        least = [None] + [self.least_link(n) for n in range(1, 65)]
        # the root gives no pairs, and beyond some size every set is taken to come as near to the threshold as can be
        return np.array([self.deepest + 1 if s is None else self.depth(float(s)) for s in least] + [self.depth(float(self.threshold))], np.int32)

    @property
    def least_match(self) -> float:
        """Least share of equal signature bytes."""
        match = float(self.threshold) + (1 - float(self.threshold)) / 256
        return match - self.sigmas * (match * (1 - match) / (self.trees * self.deepest)) ** 0.5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts. Words are runs of bytes other than space and U+0009 to U+000D."""

    def __init__(self, width: int):
        rng = np.random.default_rng(11)
        self.width = width
        self.of_byte = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse)], dtype=np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its sorted distinct shingles; a text of fewer words than a shingle has one shingle of them all, and one
        without words none."""
        data = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        self._grow(len(raw))
        solid = ~self.space[raw]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.of_byte[raw] * self.powers[: len(raw)], out=sums[1:])
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        words = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        runs = np.zeros(max(0, len(words) - self.width + 1), np.uint64)
        for i, k in enumerate(self.place):
            runs += words[i : i + len(runs)] * k
        runs = mixed(runs)
        first = np.searchsorted(starts, np.cumsum([1, *(len(d) + 1 for d in data)]))
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= self.width:
                out.append(np.unique(runs[lo : hi - self.width + 1]))
            elif hi > lo:
                short = (words[lo:hi] * self.place[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                out.append(mixed(np.array([short], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


class Forest:
    def __init__(self, settings: Settings):
        rng = np.random.default_rng(13)
        self.trees, self.n = settings.trees, settings.trees * settings.deepest
        self.flip = rng.integers(0, 2**32, self.n, np.uint32)
        self.times = rng.integers(0, 2**31, self.n, np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        half = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(half), 1024):
            np.minimum(least, ((half[i : i + 1024, None] ^ self.flip) * self.times).min(0), out=least)
        return least

    def labels(self, signature: np.ndarray) -> list[bytes]:
        """For each tree its values, two bytes of each, so that labels sort as sequences of values."""
        data = signature.astype(np.uint16).astype(">u2").tobytes()
        width = len(data) // self.trees
        return [data[i : i + width] for i in range(0, len(data), width)]


def _texts(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    at, size, run = 0, 0, []
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if run and size + len(text) > most:
            yield at, run
            at, size, run = i, 0, []
        run.append(text)
        size += len(text) + 1
    if run:
        yield at, run


def sketches(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``id, ta, tb, key, stop, labels, bytes``: the key is null for a text without words."""
    text = text_of(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit("second"), text).alias("tb"), text.alias("text"))

    def run(batches):
        shingler, forest, stops = Shingler(settings.width), Forest(settings), settings.stops
        for batch in batches:
            for at, texts in _texts(batch.column(3)):
                keys, depths, labels, marks = [], [], [], []
                for s in shingler.sets(texts):
                    signature = forest.signature(s) if len(s) else None
                    keys.append(set_key(s) if len(s) else None)
                    depths.append(int(stops[min(len(s), len(stops) - 1)]))
                    labels.append(None if signature is None else forest.labels(signature))
                    marks.append(None if signature is None else signature.astype(np.uint8).tobytes())
                part = batch.slice(at, len(texts))
                columns = [part.column(0), part.column(1), part.column(2), pa.array(keys, pa.int64()), pa.array(depths, pa.int32()), pa.array(labels, pa.list_(pa.binary())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ta", "tb", "key", "stop", "labels", "bytes"])

    return picked.mapInArrow(run, f"id {kind}, ta bigint, tb bigint, key bigint, stop int, labels array<binary>, bytes binary")


def shared_values(trees: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many first values each row's label shares with that of the row before it, from the second row on; none with another tree's."""
    same = (labels[1:] == labels[:-1]).cumprod(1).sum(1)
    return np.where(trees[1:] == trees[:-1], same, 0)


def matched(copies: DataFrame, settings: Settings) -> DataFrame:
    """``key, stop, tree, label, match``: the rows of the sorted tries whose longest shared prefix, of ``match`` values, is no shorter than
    the depth to which it is shortened."""
    spark = copies.sparkSession
    rows = copies.where(F.col("stop") <= settings.deepest).select("key", "stop", F.posexplode("labels").alias("tree", "label"))
    tries = rows.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            first = held is None
            if not first:
                rows = pa.concat_tables([held[0], rows])
            labels = np.frombuffer(b"".join(rows["label"].to_pylist()), ">u2").reshape(rows.num_rows, -1)
            shared = shared_values(rows["tree"].to_numpy(), labels)
            match = np.maximum(np.r_[0 if first else held[1], shared], np.r_[shared, 0]).astype(np.int32)
            edge = np.zeros(len(match), np.int32)
            edge[0] += first or held[2]
            yield from told(rows.slice(0, len(match) - 1), match[:-1], edge[:-1], part)
            held = rows.slice(len(match) - 1), int(shared[-1]) if len(shared) else 0, int(edge[-1])
        if held:
            yield from told(held[0], np.array([held[1]], np.int32), np.array([held[2] + 2], np.int32), part)

    def told(rows: pa.Table, match: np.ndarray, edge: np.ndarray, part: int):
        kept = pa.array((match >= rows["stop"].to_numpy()) | (edge > 0))
        columns = [*(rows[c] for c in ("key", "stop", "tree", "label")), pa.array(match), pa.array(edge), pa.array(np.full(len(match), part, np.int32))]
        yield from pa.table(columns, ["key", "stop", "tree", "label", "match", "edge", "part"]).filter(kept).to_batches()

    found = materialised(tries.mapInArrow(run, "key bigint, stop int, tree int, label binary, match int, edge int, part int"), "matched")
    # the first and the last row of each partition: as many as partitions, twice
    ends = [r.asDict() for r in found.where("edge > 0").orderBy("part", "tree", "label", "key").collect()]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a["part"] != b["part"] and a["tree"] == b["tree"]:
            label = np.frombuffer(bytes(a["label"] + b["label"]), ">u2").reshape(2, -1)
            shared = int(shared_values(np.zeros(2), label)[0])
            a["match"], b["match"] = max(a["match"], shared), max(b["match"], shared)
    columns = ("key", "stop", "tree", "label", "match")
    outer = spark.createDataFrame([tuple(r[c] for c in columns) for r in ends if r["match"] >= r["stop"]], "key bigint, stop int, tree int, label binary, match int")
    return found.where("edge = 0").select(*columns).unionByName(outer)


def in_blocks(rows: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """``rows`` dealt out by pairs of blocks of their group: with ``i, j`` of the pair and ``own``, the row's own block. A group of at
    most ``block`` rows is one pair; in a larger one each row goes to as many pairs as there are blocks."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    out = rows.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_blocks", "_other")
    return out.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "key")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first three columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place is tied to."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _crossing(table: pa.Table) -> np.ndarray:
    """Which pairs of places belong to this pair of blocks."""
    own = table["own"].to_numpy()
    if table["i"][0].as_py() == table["j"][0].as_py():
        return ~np.eye(len(own), dtype=bool)
    return own[:, None] != own[None, :]


def _similar(settings: Settings):
    def run(batches):
        least = settings.least_match
        for table in _groups(batches):
            marks = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            alike = np.empty((len(marks), len(marks)))
            for r in range(0, len(marks), 16):
                alike[r : r + 16] = (marks[r : r + 16, None] == marks[None]).mean(2)
            label = _labels((alike >= least) & _crossing(table))
            keys = table["key"].to_numpy()
            tied = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[tied], pa.int64()), pa.array(keys[label[tied]], pa.int64())], names=["u", "v"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for a in range(n):
            for b in range(a):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[place] > 1
    owner, (_, place) = owner[shared], np.unique(place[shared], return_inverse=True)
    out = np.zeros((n, n))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
        a, b = np.searchsorted(place, [lo, lo + 8192])
        has = np.zeros((n, 8192), np.float32)
        has[owner[a:b], place[a:b] - lo] = 1
        out += has @ has.T
    return np.rint(out).astype(np.int64)


def _verified(settings: Settings):
    p, q = settings.threshold.numerator, settings.threshold.denominator

    def run(batches):
        for table in _groups(batches):
            sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in table["shingles"].combine_chunks()]
            sizes, weights = np.array([len(s) for s in sets], np.int64), table["copies"].to_numpy()
            common = common_counts(sets)
            linked = (q * common >= p * (sizes[:, None] + sizes[None, :] - common)) & _crossing(table)
            keys = table["key"].to_numpy()
            columns = [pa.array(keys, pa.int64()), pa.array((linked * weights[None, :]).sum(1), pa.int64()), pa.array(keys[_labels(linked)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "links", "tied"])

    return run


def _candidates(copies: DataFrame, settings: Settings) -> DataFrame:
    """``node, root``: candidate groups among classes of copies that meet in a node of the forest and whose signatures are close.

    A text is in the node at its own depth and, since a shorter text may stop deeper, in those below it at which another text stops.
    """
    deepest = int(settings.stops[settings.stops <= settings.deepest].max())
    depths = F.explode(F.sequence(F.col("stop"), F.least("match", F.lit(deepest))))
    node = F.xxhash64("tree", "depth", F.expr("substring(label, 1, 2 * depth)"))
    rows = matched(copies, settings).withColumn("depth", depths).select("key", node.alias("prefix"), (F.col("stop") == F.col("depth")).alias("asks"))
    rows = materialised(rows, "prefixes")
    met = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor("key").alias("x"), F.bool_or("asks").alias("asked")).where("n > 1 and asked")
    # nodes of several trees with the same texts: one is enough
    once = materialised(met.groupBy("n", "low", "high", "x").agg(F.min("prefix").alias("prefix")).select("prefix", "n"), "met")
    members = rows.select("key", "prefix").join(small(once), "prefix").join(copies.select("key", "bytes"), "key")
    dealt = in_blocks(members.select("prefix", "n", "key", "bytes"), "prefix", "n", settings.block)
    return components(dealt.select("prefix", "i", "j", "own", "key", "bytes").mapInArrow(_similar(settings), "u bigint, v bigint"))


def _shingled(docs: DataFrame, wanted: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (``id, ta, tb, key, ...``) with the shingles of its texts, which are read again."""
    rest = [c for c in wanted.columns if c not in ("id", "ta", "tb")]
    texts = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
    text = F.col("_text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in rest)
    same = F.col("_doc").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("ta")) & (F.xxhash64(F.lit("second"), text) == F.col("tb"))
    found = texts.join(small(wanted), same).select(*rest, text.alias("text"))

    def run(batches):
        shingler = Shingler(settings.width)
        for batch in batches:
            for at, texts in _texts(batch.column(len(rest))):
                part = batch.slice(at, len(texts))
                sets = pa.array([s.view(np.int64) for s in shingler.sets(texts)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), sets], names=[*rest, "shingles"])

    return found.mapInArrow(run, f"{fields}, shingles array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row per row of ``docs``: ``id, ta, tb`` (its text's key), ``class_id``, ``n_links``, ``class_key``
    (unlike ``class_id`` different for any two classes, even if ids repeat; null for a text without words).

    Two rows are linked if their shingle sets have a Jaccard similarity of at least the threshold; ``n_links`` counts a row's links,
    its copies included. ``class_id`` is the smallest id among the rows that links tie together, directly or over others. A text
    without words (null, empty, blank) has no links and is a class of its own; one of fewer words than a shingle is one shingle.
    Repeated rows are copies; rows without an id are compared like others, and a class of only such has a null id; an empty
    table gives none; other columns are not looked at. Equality of shingles and of sets is that of 64-bit hashes.
    """
    with step(docs.sparkSession) as lasting:
        sketch = materialised(sketches(docs, settings, id_col, text_col), "sketches")
        copies = sketch.where(F.col("key").isNotNull()).groupBy("key")
        first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "ta", "tb"))
        copies = materialised(copies.agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("stop").alias("stop"), F.any_value("labels").alias("labels"), F.any_value("bytes").alias("bytes")), "copies")

        groups = materialised(_candidates(copies, settings), "groups")
        sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        wanted = groups.join(sizes, "root").join(copies, F.col("node") == F.col("key")).select("first.id", "first.ta", "first.tb", "key", "root", "n", "copies")
        # rows that repeat an id and a text give their shingles more than once
        shingled = _shingled(docs, materialised(wanted, "wanted"), settings, id_col, text_col).groupBy("key").agg(
            F.any_value("root").alias("root"), F.any_value("n").alias("n"), F.any_value("copies").alias("copies"), F.any_value("shingles").alias("shingles")
        )
        dealt = in_blocks(shingled, "root", "n", settings.exact_block)
        links = dealt.select("root", "i", "j", "own", "key", "copies", "shingles").mapInArrow(_verified(settings), "key bigint, links bigint, tied bigint")
        links = materialised(links, "links")

        roots = components(links.select(F.col("key").alias("u"), F.col("tied").alias("v")))
        counted = links.groupBy("key").agg(F.sum("links").alias("links"))
        told = copies.select("key", "first", "copies").join(counted, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
        told = told.select("key", F.coalesce("root", "key").alias("root"), "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        names = told.groupBy("root").agg(F.min("first").alias("least"))
        told = materialised(told.join(names, "root").select(F.col("key").alias("_key"), F.col("root").alias("class_key"), F.col("least.id").alias("class_id"), "n_links"), "classes")
        out = sketch.select("id", "ta", "tb", "key").join(small(told), F.col("key") == F.col("_key"), "left")
        own = F.col("key").isNull()
        out = out.select(
            F.col("id").alias(id_col),
            "ta",
            "tb",
            F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "class_key",
        )
        return lasting(out, "near")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of ``documents`` of each class, all columns: that of the smallest ``doc_id``, of rows that repeat id and text any one.

    Texts without words (null, empty, blank) all stay; a row without an id stays only where its class has no other; an empty table
    gives no rows.
    """
    found = near_duplicates(docs, settings=settings)
    key = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "ta", "tb")
    spoken = found.where(F.col("class_key").isNotNull())
    kept = spoken.groupBy("class_key").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.ta").alias("_ta"), F.col("k.tb").alias("_tb"))
    rows = spoken.groupBy(F.col("doc_id").alias("_id"), F.col("ta").alias("_ta"), F.col("tb").alias("_tb")).agg(F.count(F.lit(1)).alias("_rows"))
    rows = rows.withColumnsRenamed({c: f"r{c}" for c in rows.columns})
    kept = kept.join(rows, kept["_id"].eqNullSafe(rows["r_id"]) & (F.col("_ta") == F.col("r_ta")) & (F.col("_tb") == F.col("r_tb"))).select("_id", "_ta", "_tb", F.col("r_rows").alias("_rows"))
    kept = small(materialised(kept, "kept"))
    packed = docs.select(packed_row(docs, "text"), "doc_id", "text")
    text = text_of("text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_ta")) & (F.xxhash64(F.lit("second"), text) == F.col("_tb"))
    met = packed.join(kept, same)
    repeated = met.where(F.col("_rows") > 1).dropDuplicates(["_id", "_ta", "_tb"])
    silent = packed.where(~text.rlike(NOT_SPACE))
    out = met.where(F.col("_rows") == 1).select("row", "text").unionByName(repeated.select("row", "text")).unionByName(silent.select("row", "text"))
    return out.select(unpacked(docs, {"text": F.col("text")}))
