"""Scoring all documents against all queries in one pass: the queries' tokens or vectors go to the tasks, pairs never move.

A task looks its documents' tokens up in the queries' vocabulary and counts in arrays. What comes out is pairs in the task that made
them, so that a cut to the best of each query is made before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.columns import tokens

#: Pairs of a document and a query's token that are expanded at a time, about.
CHUNK = 4_000_000


class Asked:
    """Queries by token: the vocabulary, and for each of its tokens the queries that have it."""

    def __init__(self, rows: pa.Table):
        """``rows``: ``qid, token``, one for each distinct token of a query; as many as fit the driver."""
        vocabulary, queries = (rows[c].combine_chunks().dictionary_encode() for c in ("token", "qid"))
        self.vocabulary, self.qids = vocabulary.dictionary, queries.dictionary
        token, query = (x.indices.to_numpy().astype(np.int64) for x in (vocabulary, queries))
        order = np.lexsort((query, token))
        self.queries = query[order]
        self.starts = np.searchsorted(token[order], np.arange(len(self.vocabulary) + 1))
        self.sizes = np.bincount(query, minlength=len(self.qids))

    def found(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Document and token, by number, of each word that some query has; documents in order."""
        lengths = np.diff(words.offsets.to_numpy())
        at = pc.index_in(words.flatten(), value_set=self.vocabulary)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(words)), lengths)[known], at.drop_null().to_numpy().astype(np.int64)

    def pairs(self, docs: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry and each query that has its token: the entry's number, and document times queries plus query."""
        uses = self.starts[token + 1] - self.starts[token]
        entry = np.repeat(np.arange(len(token)), uses)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(uses) - uses, uses)
        return entry, docs[entry] * len(self.qids) + self.queries[self.starts[token][entry] + nth]

    def chunks(self, docs: np.ndarray, token: np.ndarray) -> Iterator[slice]:
        """Runs of entries, whole documents each, with about ``CHUNK`` pairs."""
        upto = np.cumsum(self.starts[token + 1] - self.starts[token])
        lo = 0
        while lo < len(docs):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right"))
            hi = len(docs) if hi >= len(docs) else max(int(np.searchsorted(docs, docs[hi])), int(np.searchsorted(docs, docs[lo], side="right")))
            yield slice(lo, hi)
            lo = hi


def _matched(docs: DataFrame, asked: Asked, fields: str, count: Callable) -> DataFrame:
    """Pairs of ``docs`` (``doc_id, words, ...``): for each chunk, ``count(batch, docs, token)`` gives keys and columns."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, token = asked.found(batch.column(1))
            for part in asked.chunks(doc, token):
                key, columns = count(batch, doc[part], token[part])
                for at in range(0, len(key), 50_000):
                    cut = slice(at, at + 50_000)
                    d, q = np.divmod(key[cut], len(asked.qids))
                    arrays = [asked.qids.take(pa.array(q)), batch.column(0).take(pa.array(d)), *(pa.array(c[cut]) for c in columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["qid", "doc_id", *(x.split()[0] for x in fields.split(", "))])

    return docs.mapInArrow(run, f"qid {_kind(asked.qids.type)}, doc_id {kinds['doc_id']}, {fields}")


def _kind(kind: pa.DataType) -> str:
    return {"int64": "bigint", "int32": "int"}.get(str(kind), "string")


def overlaps(docs: DataFrame, asked: Asked) -> DataFrame:
    """``qid, doc_id, inter, nq, nd``: each query with the documents (``doc_id, text``) that share a token with it, and the numbers of distinct
    tokens that both, the query and the document have."""

    def count(batch, doc, token):
        _, key = asked.pairs(doc, token)
        key, inter = np.unique(key, return_counts=True)
        d, q = np.divmod(key, len(asked.qids))
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        return key, [inter.astype(np.int64), asked.sizes[q].astype(np.int32), sizes[d].astype(np.int32)]

    return _matched(docs.select("doc_id", tokens(F.col("text")).alias("words")), asked, "inter bigint, nq int, nd int", count)


def weighed(docs: DataFrame, asked: Asked, idf: np.ndarray, mean: float, k1: float, b: float) -> DataFrame:
    """``qid, doc_id, score`` by BM25, of documents (``doc_id, words`` with repetitions); ``idf`` by the vocabulary's order."""

    def count(batch, doc, token):
        pair, tf = np.unique(doc * len(idf) + token, return_counts=True)
        d, t = np.divmod(pair, len(idf))
        length = np.diff(batch.column(1).offsets.to_numpy())[d]
        part = idf[t] * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / mean))
        entry, key = asked.pairs(d, t)
        key, place = np.unique(key, return_inverse=True)
        return key, [np.bincount(place, part[entry], len(key))]

    return _matched(docs, asked, "score double", count)


def corpus_statistics(docs: DataFrame, asked: Asked) -> tuple[int, float, np.ndarray]:
    """The number of documents (``doc_id, words``), their mean length, and in how many of them each token of the vocabulary stands; from one
    pass whose tasks each return a row for each token that they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(asked.vocabulary), np.int64)
        for batch in batches:
            doc, token = asked.found(batch.column(1))
            df += np.bincount(np.unique(doc * max(1, len(df)) + token) % max(1, len(df)), minlength=len(df)) if len(doc) else 0
            n, length = n + batch.num_rows, length + len(batch.column(1).flatten())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, seen]), pa.array(np.r_[n, length, df[seen]])], names=["token", "n"])

    found = {r["token"]: r["n"] for r in docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-2, 0)
    return n, (found.get(-1, 0) / n if n else 0.0), np.array([found.get(i, 0) for i in range(len(asked.vocabulary))], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest_by_cosine(rows: DataFrame, queries: pa.Table, k: int, digits: int = 9) -> DataFrame:
    """``qid, doc_id, score``: of each batch of ``rows`` (``doc_id, vector``), the ``k`` of the largest cosine for each of ``queries`` (``qid,
    vector``), equal ones by id: all that the best of all rows can be among. A vector of zeros has cosine 0 with all."""
    q, ids = _matrix(queries["vector"].combine_chunks()), queries["qid"].combine_chunks()
    norm = lambda x: np.where((n := np.sqrt((x * x).sum(1))) == 0, 1.0, n)
    unit = q / norm(q)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, doc = _matrix(batch.column(1)), batch.column(0).to_numpy()
            scores = np.round((x / norm(x)[:, None]) @ unit.T, digits)
            order = np.lexsort((np.broadcast_to(doc[:, None], scores.shape), -scores), axis=0)[:k]
            which = np.broadcast_to(np.arange(len(q))[None, :], order.shape)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which.ravel())), pa.array(doc[order.ravel()]), pa.array(scores[order, which].ravel())], names=["qid", "doc_id", "score"])

    return rows.mapInArrow(run, f"qid {_kind(ids.type)}, doc_id bigint, score double")


def late_interaction(rows: DataFrame, queries: pa.Table) -> DataFrame:
    """``qid, doc_id, score``: for each of ``rows`` (``doc_id, vectors``) and ``queries`` (``qid, vectors``) the sum, over the query's
    vectors, of the largest finite cosine with one of the row's; a row's vectors meet all queries in one product."""
    ids = queries["qid"].combine_chunks()
    parts = [np.array(v.as_py(), np.float64) for v in queries["vectors"].combine_chunks()]
    norm = lambda x: np.where((n := np.sqrt((x * x).sum(1))) == 0, 1.0, n)
    unit = np.concatenate([p / norm(p)[:, None] for p in parts])
    first = np.cumsum([0, *(len(p) for p in parts[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                d = np.array(batch.column(1)[at].as_py(), np.float64)
                cosines = unit @ (d / norm(d)[:, None]).T
                best = np.where(np.isfinite(cosines), cosines, -np.inf).max(1)
                scores = np.add.reduceat(np.where(np.isfinite(best), best, 0.0), first)
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).slice(at, 1).take(pa.array(np.zeros(len(ids), np.int64))), pa.array(scores)], names=["qid", "doc_id", "score"])

    return rows.mapInArrow(run, f"qid {_kind(ids.type)}, doc_id bigint, score double")
