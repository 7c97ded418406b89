"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on windows of toxic and of ordinary text. A window is compressed once with the ordinary one
and once with the toxic one put after it; the bytes that this saves are what its toxic content explains beyond ordinary text. A
document's score comes from the savings of all its windows, by a logistic curve whose weights come from labelled texts that the
dictionaries in question have not seen.

Most windows of a toxic document are ordinary, so the toxic dictionary is trained in rounds: on all windows of toxic texts; then on
the half that dictionaries of the *other* texts save most on, and so on; at last on the words whose removal from a window takes its saving
away. Words of ordinary windows that the toxic dictionary saves bytes on train a second part of the ordinary dictionary.

Fitting takes a bounded sample of labelled rows and of their windows to the driver (``Sample``); texts stay on the executors. Scoring
is a map over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialised, small_batches

EDGES = b".,;:!?\"()"
#: Words of a window.
WINDOW = 6
#: Bytes of the ordinary dictionary, of its second part, and of the toxic one while rounds go on and in the end.
ORDINARY, CONFUSED, ROUNDS, TOXIC = 65536, 8192, 4096, 3000
#: Segment lengths of training on windows and on words.
LONG, SHORT = 48, 24
#: Savings that windows are counted by.
STEPS = (1, 2, 3, 4, 5, 6)
MOST = (2, 3, 4, 5, 6, 8)
N_FEATURES = 4 + len(STEPS) + len(MOST) + 1

#: Fixed value: the repeat offsets 1, 4 and 8, which end the header of a trained dictionary.
HEADER_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


@dataclass(frozen=True)
class Sample:
    """The bounds of what fitting takes: ``toxic`` and ``ordinary`` rows, drawn by a hash of their ids; ``pieces`` windows, drawn
    from all of a text, of each toxic text and ``plain`` of each ordinary one."""

    toxic: int = 1500
    ordinary: int = 4500
    pieces: int = 24
    plain: int = 16


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and U+0009 to U+000D, of small letters and without ``EDGES``."""
    return [w for x in text.lower().encode("utf-8", "replace").split() if (w := x.strip(EDGES))]


def encoded(words: Sequence[bytes]) -> bytes:
    return b" %b " % b" ".join(words)


def windows(words: list[bytes]) -> list[list[bytes]]:
    """Runs of ``WINDOW`` words; one empty run for no words."""
    return [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)] or [[]]


def trained(samples: list[bytes], size: int, segment: int) -> tuple[bytes, bytes]:
    """Header and content of a dictionary trained on ``samples``; no header and the samples themselves where they are too few to train on."""
    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-size:]
    at = made.index(HEADER_END) + len(HEADER_END)
    return made[:at], made[at:]


def compressor(header: bytes, content: bytes) -> Callable[[bytes], bytes]:
    """Compresses with a dictionary, by the parser that looks for the shortest result, matches of three bytes included."""
    options = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTOPT, min_match=3, search_log=4, window_log=17, chain_log=17, hash_log=17, target_length=16, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=options).compress
    kind = zstandard.DICT_TYPE_FULLDICT if header else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(header + content, dict_type=kind)
    held.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(compression_params=options, dict_data=held).compress


@dataclass(frozen=True)
class Dictionaries:
    """The trained header, the ordinary content, and the toxic content that is put after it."""

    header: bytes
    ordinary: bytes
    toxic: bytes

    def saving(self) -> Callable[[Sequence[bytes]], int]:
        """Bytes that the toxic content saves on a run of words."""
        plain, toxic = compressor(self.header, self.ordinary), compressor(self.header, self.ordinary + self.toxic)

        def saved(words: Sequence[bytes]) -> int:
            data = encoded(words)
            return len(plain(data)) - len(toxic(data))

        return saved


def features(saved: Callable[[Sequence[bytes]], int], text: str) -> list[float]:
    """The distribution of savings over a text's windows."""
    m = [saved(w) for w in windows(words_of(text))]
    n, best = len(m), nlargest(6, m)
    least = np.bincount(np.clip(m, 0, 8), minlength=9)[::-1].cumsum()[::-1]  # how many save so many bytes or more, up to 8
    return [best[0], sum(m) / n, sum(best[:3]) / min(n, 3), sum(best) / min(n, 6), *(least[list(STEPS)] / n), *np.log1p(least[list(MOST)]), np.log(n)]


def telling_words(pieces: list[list[bytes]], saved: Callable[[Sequence[bytes]], int], least: int = 2) -> list[bytes]:
    """Of each piece that saves ``least`` bytes, the word without which it saves the least, if that takes ``least`` bytes away."""
    out = []
    for words in pieces:
        whole = saved(words)
        if whole < least:
            continue
        without = [saved(words[:j] + words[j + 1 :]) for j in range(len(words))] if len(words) > 1 else [0] * len(words)
        if without and whole - min(without) >= least:
            out.append(encoded([words[int(np.argmin(without))]]))
    return out


def learned(toxic: list[list[list[bytes]]], ordinary: list[list[list[bytes]]], rounds: int = 4, passes: int = 3) -> Dictionaries:
    """Dictionaries from the pieces (runs of words) of toxic and of ordinary texts.

    Toxic texts are halved: what is kept of either half is decided by a dictionary of the other, so that no piece speaks for itself.
    """
    plain = [p for text in ordinary for p in text]
    halves = [[p for i, text in enumerate(toxic) if i % 2 == h for p in text] for h in (0, 1)]
    header, base = trained([encoded(p) for p in plain], ORDINARY, LONG)
    kept, confused, known = [list(x) for x in halves], [], base
    for _ in range(rounds):
        found = [Dictionaries(header, known, trained([encoded(p) for p in kept[1 - h]], ROUNDS, LONG)[1]).saving() for h in (0, 1)]
        for h in (0, 1):
            saved = np.array([found[h](p) for p in kept[h]])
            best = np.argsort(-saved, kind="stable")[: max(1, len(saved) // 2)]
            kept[h] = [kept[h][i] for i in sorted(best)]
    contents = [trained([encoded(p) for p in kept[h]], ROUNDS, LONG)[1] for h in (0, 1)]
    told: list[list[bytes]] = [[], []]
    for _ in range(passes):
        found = [Dictionaries(header, known, contents[1 - h]).saving() for h in (0, 1)]
        told = [telling_words(halves[h], found[h]) or told[h] for h in (0, 1)]
        confused += [w for s in found for w in telling_words(plain[:: len(found)], s)]
        if confused:
            known = base + trained(confused, CONFUSED, SHORT)[1]
        contents = [trained(told[h], TOXIC, SHORT)[1] if told[h] else contents[h] for h in (0, 1)]
    final = trained([*told[0], *told[1]], TOXIC, SHORT)[1] if told[0] or told[1] else b"".join(contents)
    # what the final dictionary saves on ordinary pieces is ordinary as well
    confused += telling_words(plain, Dictionaries(header, known, final).saving())
    return Dictionaries(header, base + trained(confused, CONFUSED, SHORT)[1] if confused else base, final)


@dataclass(frozen=True)
class Model:
    """What scoring needs; some tens of kilobytes."""

    dictionaries: Dictionaries
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        saved = self.dictionaries.saving()
        centre, scale, weights = (np.array(x) for x in (self.centre, self.scale, self.weights))

        def score(texts: list[str]) -> np.ndarray:
            z = (np.array([features(saved, t) for t in texts]) - centre) / scale
            return 1 / (1 + np.exp(-np.clip(z @ weights[:-1] + weights[-1], -500, 500)))

        return score


def curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge: centre and scale of the features, weights with the offset last."""
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def constant(share: float) -> Model:
    """Scores everything by the share of toxic rows."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(Dictionaries(b"", b"", b""), (0.0,) * N_FEATURES, (1.0,) * N_FEATURES, (*(0.0,) * N_FEATURES, float(np.log(share / (1 - share)))))


def pieces_of(text: str, most: int) -> list[list[bytes]]:
    """At most ``most`` windows of the text, drawn from all of it, by a hash of their place and words."""
    found = windows(words_of(text))
    drawn = sorted(range(len(found)), key=lambda i: zlib.crc32(b"%d %b" % (i, encoded(found[i]))))[:most]
    return [found[i] for i in sorted(drawn) if found[i]]


def sampled(docs: DataFrame, labels: DataFrame, sample: Sample) -> DataFrame:
    """``id, toxic, fold, text``: the sample's rows, one for each id. Null labels, ids and texts are left out; of an id's
    labels the larger counts, and of its texts the first."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.approx_count_distinct("id").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = None
    for y, most in ((1, sample.toxic), (0, sample.ordinary)):
        share = int((1 << 30) * min(1.0, 1.2 * most / max(1, sizes.get(y, 0))))
        some = known.where((F.col("toxic") == y) & (place < share)).distinct().limit(most)
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = materialised(drawn.groupBy("id").agg(F.max("toxic").alias("toxic")), "drawn")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), "text")
    met = texts.join(F.broadcast(drawn), F.col("_id") == F.col("id"))  # at most as many ids as the sample's bounds
    once = met.groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return materialised(once.select("id", "toxic", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int").alias("fold"), "text"), "sample")


def fitted(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """A model from rows of ``labels`` (``doc_id, toxic``) and their texts. Where one of the two halves lacks a label, and so
    for empty tables, the score is the share of toxic rows."""
    rows = sampled(docs, labels, sample)

    def cut(batches):
        for batch in batches:
            found = [pieces_of(t, sample.pieces if y else sample.plain) for t, y in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.list_(pa.binary())))], names=["id", "toxic", "fold", "pieces"])

    held = small_batches(rows).select(F.col("id").cast("string"), F.col("toxic").cast("int"), "fold", "text").mapInArrow(cut, "id string, toxic int, fold int, pieces array<array<binary>>").collect()
    held.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    if any({r["toxic"] for r in held if r["fold"] == f} != {0, 1} for f in (0, 1)):
        return constant(float(np.mean([r["toxic"] for r in held])) if held else 0.0)
    by = lambda f, y: [[list(map(bytes, p)) for p in r["pieces"]] for r in held if r["fold"] != f and r["toxic"] == y]
    made = [learned(by(f, 1), by(f, 0)) for f in (0, 1)]

    def measured(batches):
        saved = [d.saving() for d in made]
        for batch in batches:
            x = [features(saved[f], t) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    told = small_batches(rows).select(F.col("toxic").cast("int"), "fold", "text").mapInArrow(measured, "toxic int, x array<double>").collect()
    told.sort(key=lambda r: (r["toxic"], r["x"]))
    shape = curve(np.array([r["x"] for r in told]), np.array([r["toxic"] for r in told], float))
    return Model(learned(by(2, 1), by(2, 0)), *(tuple(map(float, x)) for x in shape))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` per row, from the whole text; null counts as empty. Repeated rows get equal scores; an empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(texts), pa.float64())], names=[id_col, "score"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """True for rows that fitting never sees: crc32 of the id as text leaves 1 when divided by 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def judged(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; learned from labels of rows not held out.

    Null texts are scored as empty ones, rows without an id like others, repeated rows alike; an empty table gives no rows; columns
    other than ``doc_id`` and ``text`` are not looked at.
    """
    model = fitted(docs, labels.where(~held_out()), sample)
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold.

    Null texts are scored as empty ones and stay null; repeated rows share a fate; an empty table gives no rows.
    """
    model = fitted(docs, labels.where(~held_out()), sample)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = score([t or "" for t in part.column(at).to_pylist()]) < threshold
                yield part.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
