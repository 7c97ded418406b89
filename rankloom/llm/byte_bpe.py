"""Byte-level BPE: encoding with a rank file, and decoding.

Texts of a batch lie behind one another in one array of code points. A table gives each code point its class; a state
machine over classes says where a token of the split pattern begins. Each class is a function from state to state; these
functions form a finite monoid, so the states come from an associative scan over the array by doubling, which ends as
soon as every composed function is constant. No regular expression runs over texts. The slices between boundaries go through
pair merging behind a bounded cache. Every token's byte offset is kept: decoding puts each token's bytes at its offset, so that any
span of ids decodes by itself.

All work is a map over rows, in chunks of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from rankloom.llm.common import small_batches

# Classes of code points.
OTHER, LETTER, NUMBER, WHITE, BLANK, QUOTE, BREAK = range(7)
# Symbols: classes after a look at what follows. A quote may begin a contraction of one or two letters. White space may
# go on, or be the last before something solid: a blank then joins that, other white space stands alone.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_WHITE, S_JOIN, S_ALONE, S_BREAK = range(9)
# States: what the token so far is. FRESH: the next code point begins a token in any case.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, JOINED, ONE_MORE, TWO_MORE = range(8)

#: Chunks of texts hold at most so many code points, unless one text alone has more.
CHUNK = 1_000_000
#: Cached slices, and the longest that are cached.
CACHE, CACHED_LENGTH = 600_000, 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if symbol == S_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
    if symbol in (S_QUOTE1, S_QUOTE2) and state not in (IN_OTHER, JOINED):
        return (ONE_MORE if symbol == S_QUOTE1 else TWO_MORE), True
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        return IN_OTHER, state not in (IN_OTHER, JOINED)
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return {S_JOIN: JOINED, S_ALONE: IN_WHITE, S_BREAK: FRESH}[symbol], True


def code_points(pattern: str) -> np.ndarray:
    """The code points that match ``pattern``, as the library's own pattern engine has it: asked once for all of them, with bytes as tokens."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    asked = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, ...]:
    """Code point classes; symbols by class and next class; the monoid: its composition table, constants, and generators; where tokens begin."""
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        classes[code_points(pattern)] = kind
    classes[ord(" ")], classes[ord("'")] = BLANK, QUOTE

    pair = np.zeros((8, 8), np.uint8)
    for c, symbol in ((OTHER, S_OTHER), (LETTER, S_LETTER), (NUMBER, S_NUMBER), (QUOTE, S_OTHER), (BREAK, S_BREAK)):
        pair[c, :] = symbol
    for c, last in ((WHITE, S_ALONE), (BLANK, S_JOIN)):
        pair[c, :] = [last if n in (OTHER, LETTER, NUMBER, QUOTE) else S_WHITE for n in range(8)]

    generators = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(generators))}
    queue = list(known)
    for f in queue:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    if len(known) > 256:
        raise AssertionError("the monoid no longer fits a byte")
    functions = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in functions], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return classes, pair, compose, constant, np.array([known[g] for g in generators], np.uint8), begins


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where tokens begin in ``codes``, which has a break before the first text, between texts and after the last."""
    classes, pair, compose, constant, generators, begins = _machine()
    cls = classes[codes]
    cls[breaks] = BREAK
    symbols = np.empty(len(codes), np.uint8)
    symbols[:-1] = pair.ravel()[cls[:-1] * np.uint8(8) + cls[1:]]
    symbols[-1] = S_BREAK
    quotes = np.flatnonzero(cls == QUOTE)
    if len(quotes):
        one = codes[quotes + 1]
        two = codes[np.minimum(quotes + 2, len(codes) - 1)]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[quotes[is_two]] = S_QUOTE2

    composed, width = generators[symbols], 1
    n = np.uint16(len(compose))
    while (constant[composed] == 255).any():
        composed[width:] = compose.ravel()[composed[:-width] * n + composed[width:]]
        width *= 2
    states = constant[composed]
    begin = np.ones(len(codes), bool)
    begin[1:] = begins.ravel()[states[:-1] * np.uint8(9) + symbols[1:]]
    return np.flatnonzero(begin)


def merged(data: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The ids of one slice: of all neighbours that a rank joins, those of the lowest rank are joined first, the left of equals.

    Parts are linked by their ends; a heap holds the joints that may come next, and those that are out of date are passed over.
    """
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    joints = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapify(joints)
    while joints:
        _, i, to = heappop(joints)
        if not alive[i] or (j := end[i]) >= n or end[j] != to:
            continue
        alive[j], end[i] = 0, to
        if to < n:
            before[to] = i
            if (r := ranks.get(data[i : end[to]])) is not None:
                heappush(joints, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := ranks.get(data[p:to])) is not None:
            heappush(joints, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


class _Merges(dict):
    """Ids of slices; bounded."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = merged(piece.encode("utf-8"), self.ranks)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def slices(texts: list[str]) -> Iterator[Iterator[str]]:
    """What the split pattern cuts each text into."""
    joined = "\0" + "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = boundaries(codes, breaks)
    first = np.searchsorted(starts, breaks)
    for i in range(len(texts)):
        cuts = starts[first[i] + 1 : first[i + 1] + 1].tolist()
        yield map(joined.__getitem__, map(slice, cuts, cuts[1:]))


class Codec:
    """Encodes and decodes with the ranks of one file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.merges = _Merges(ranks)
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            bytes_of[i] = token
        self.lengths = np.array([len(b) for b in bytes_of], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.digits = [str(i) for i in range(len(bytes_of))]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; for chunks of texts, see ``chunks``."""
        for found in slices(texts):
            yield list(chain.from_iterable(map(self.merges.__getitem__, found)))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """At which byte of the text each token begins, and the number of bytes as the last entry."""
        return np.concatenate(([0], np.cumsum(self.lengths[np.asarray(ids, np.int64)])))

    def decode(self, ids: list[int], offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ``ids``, each token's at its offset; ``offsets`` are those of ``encode``'s ids, or of a span of them with its end."""
        at = self.offsets(ids) if offsets is None else np.asarray(offsets) - offsets[0]
        shift = self.places[np.asarray(ids, np.int64)] - at[:-1]
        return self.bytes[np.arange(at[-1]) + np.repeat(shift, np.diff(at))].tobytes()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most ``CHUNK`` code points in all, one at least, with the place of the first. Null is empty."""
    at, size, run = 0, 0, []
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        if run and size + len(text) > CHUNK:
            yield at, run
            at, size, run = i, 0, []
        run.append(text)
        size += len(text) + 1
    if run:
        yield at, run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, offsets array<bigint>`` per row: token ids, and each token's first byte in the text.

    A null or empty text has no ids. Each row is encoded by itself: repeated rows, a long text or an empty table need nothing
    special, and other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                ids = list(c.encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([c.offsets(x)[:-1] for x in ids], pa.list_(pa.int64()))],
                    names=[id_col, "ids", "offsets"],
                )

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<bigint>")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, data binary``: the bytes of ``ids``. Null ids are no ids."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            data = [c.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encoded`` (ids and offsets) and then ``decoded`` give, in one map, so that no ids are shipped: ``id, n_tokens,
    ids_sha256, decoded_sha256``.

    ``ids_sha256`` is of the decimal ids joined by one space, ``decoded_sha256`` of the decoded bytes; an empty or null text gives
    the digests of nothing.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                n, names, data = [], [], []
                for ids in c.encode(texts):
                    n.append(len(ids))
                    names.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                    data.append(hashlib.sha256(c.decode(ids, c.offsets(ids))).hexdigest())
                columns = [pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(data, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def counted(docs: DataFrame, paths: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and, for each name in ``paths``, how many ids its rank file gives the text. Texts are cut once for all files.

    A null or empty text has none; repeated rows each get a row; an empty table gives none; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sizes = _sizes(tuple(paths.values()))
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                sums = [sum(map(sizes.__getitem__, s)) for s in slices(texts)]
                columns = [pa.array([n >> PLACE * i & (1 << PLACE) - 1 for n in sums], pa.int64()) for i in range(len(paths))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=[id_col, *paths])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{name}` bigint" for name in paths))


#: Bits of a number that holds the counts of several vocabularies side by side.
PLACE = 40


class _Sizes(dict):
    """Numbers of ids of slices under each vocabulary, ``PLACE`` bits apart in one number, so that a slice is looked up once; bounded."""

    def __init__(self, ranks: list[Mapping[bytes, int]]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8")
        n = sum(len(merged(data, r)) << PLACE * i for i, r in enumerate(self.ranks))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def _sizes(paths: tuple[str, ...]) -> _Sizes:
    """Kept by the worker from task to task."""
    return _Sizes([read_ranks(path) for path in paths])
