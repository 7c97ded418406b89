"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most the capacity. Only the histogram of piece lengths, which has as many rows as the
capacity at most, reaches the driver. There lengths and the sums of two and of three lengths are indexed by hash, and each gap
is filled exactly by a single, a pair or a triple that the index has under it and of which pieces are left; what no combination
fills exactly is filled best-fit. The resulting plan says, for each length, which of its pieces (by number) go to which sequence
and place; its size depends on the capacity, not on the data. A piece is numbered within its length as it is made, by the task that
makes it; sums over tasks put the tasks' numbers behind one another. Rows are not sorted or dealt out by length for it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import materialised, small, small_batches

#: The split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE from a tokenizer's JSON file, whose ids are in the order of its merges, or from a rank file.

    A JSON file's added tokens are single ids wherever a text holds their names, as in the library that the file is for.
    """
    added: dict[str, int] = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, added = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in data["added_tokens"]) or data["normalizer"]:
            raise ValueError(f"{path} needs more than a byte-level BPE with plain added tokens")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, ids_crc32, task, nth``: each text's ids and ``end_id``, cut into pieces of ``capacity`` of which only the
    first may be shorter; and the task that made the piece with its number among the task's pieces of that length, from 0. Null is empty.

    The last two hold for one run of the tasks: write the rows before they are used.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, made, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, pieces, starts, lengths, crcs, nth = [], [], [], [], [], []
            for i in range(batch.num_rows):
                ids = np.append(enc.encode_to_numpy(batch.column(1)[i].as_py() or "", allowed_special="all"), end_id).astype("<u4")
                at, n = 0, len(ids)
                to = n % capacity or capacity
                piece = 0
                while at < n:
                    rows.append(i)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(to - at)
                    crcs.append(zlib.crc32(ids[at:to].tobytes()))
                    nth.append(made[to - at])
                    made[to - at] += 1
                    at, to, piece = to, to + capacity, piece + 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            columns += [pa.array(np.full(len(rows), task), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "task", "nth"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


class Complements:
    """Which available lengths add up to a gap: single lengths, pairs and triples, by their sum.

    The entries of a sum are listed when it is first asked for, the one with the largest length last. Availability only falls, so an
    entry at the end that has too few pieces left goes for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.singles = {int(n) for n in np.flatnonzero(left)}
        self.lengths = np.array(sorted(self.singles), np.int64)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _pairs(self, gap: int) -> list[int]:
        """The larger lengths of the pairs of a sum."""
        if gap not in self.pairs:
            larger = self.lengths[(2 * self.lengths >= gap) & (self.lengths < gap)].tolist()
            self.pairs[gap] = [a for a in larger if gap - a in self.singles]
        return self.pairs[gap]

    def _triples(self, gap: int) -> list[int]:
        """The largest lengths of the triples of a sum; the rest of each is a pair."""
        if gap not in self.triples:
            self.triples[gap] = self.lengths[(3 * self.lengths >= gap) & (self.lengths < gap - 1)].tolist()
        return self.triples[gap]

    def _there(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())

    def pair(self, gap: int) -> tuple[int, ...] | None:
        found = self._pairs(gap)
        while found:
            if self._there((found[-1], gap - found[-1])):
                return found[-1], gap - found[-1]
            found.pop()
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        found = self._triples(gap)
        while found:
            a = found[-1]
            if self.left[a] and self.pair(gap - a):
                for b in reversed(self.pairs[gap - a]):
                    if b <= a and self._there((a, b, gap - a - b)):
                        return a, b, gap - a - b
            found.pop()
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap in self.singles and self.left[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each pattern of lengths is used: ``(times, {length: pieces})``; all pieces are used, none twice."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, plan = Complements(left), []
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1  # one piece is set aside while its companions are sought
            pattern, gap = [length], capacity - length
            while gap:
                if found := sums.exact(gap):
                    pattern += found
                    break
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                pattern.append(int(fits[-1]) + 1)
                left[pattern[-1]] -= 1
                gap -= pattern[-1]
                # the piece is set aside too; its place is given back below
            taken = pattern[: len(pattern) - len(found)] if gap and found else pattern
            for x in taken:
                left[x] += 1
            need = Counter(pattern)
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            plan.append((times, dict(need)))
    return plan


def plan_table(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of piece numbers: of a length, from ``first`` on, ``each`` pieces in a row share a sequence, from ``sequence`` on, at ``offset``."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, need in plan:
        offset = 0
        for length, each in sorted(need.items(), reverse=True):
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``, from 0 on within each length, in place of ``task, nth``: how many pieces of the length earlier tasks made is
    summed over a row for each length and task."""
    made = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    before = small(materialised(before, "before"))
    joined = pieces.join(before, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    return joined.select(*(c for c in pieces.columns if c not in ("task", "nth")), (F.col("_before") + F.col("nth")).alias("number"))


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with ``sequence_id`` and ``offset``: every piece once, sequences without gaps and of at most ``capacity``."""
    pieces = materialised(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan_table(packing_plan(counts, capacity))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name not in ("task", "nth"))

    def place(batches):
        keys = (table["length"] << 44) | table["first"]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) | number, side="right") - 1
            turn, nth = np.divmod(number - table["first"][at], table["each"][at])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table["sequence"][at] + turn), pa.array(table["offset"][at] + nth * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return numbered(pieces).mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id. Repeated rows are packed each; rows tie freely, since equal pieces are
    alike; an empty table gives no rows; other columns are not looked at.
    """
    return packed(token_pieces(docs, path, capacity, id_col, text_col), capacity)
