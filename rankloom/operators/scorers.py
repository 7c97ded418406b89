"""Scorers: transforms of candidates ``qid, query, idx, doc, ...`` that add ``score``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import ModelConfig, RerankConfig
from rankloom.functions import columns


class Scorer(Protocol):
    def score(self, candidates: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ColumnScorer:
    """Scores by an expression over the candidates' columns, a ``Column`` or SQL; it stays inside the JVM's generated code."""

    expression: Column | str
    normalize: bool = False

    def score(self, candidates: DataFrame) -> DataFrame:
        found = F.expr(self.expression) if isinstance(self.expression, str) else self.expression
        return candidates.withColumn("score", columns.sigmoid(found) if self.normalize else found.cast("double"))


@dataclass(frozen=True)
class LexicalScorer:
    """The share of the query's distinct tokens that the document has, as a logit from -3 to 3 put through the logistic curve."""

    normalize: bool = True

    def score(self, candidates: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect(columns.tokens(F.col("query")), columns.tokens(F.col("doc"))))
        logit = F.coalesce(F.try_divide(both * 6.0, F.size(columns.tokens(F.col("query")))), F.lit(0.0)) - 3.0
        return ColumnScorer(logit, self.normalize).score(candidates)


@dataclass(frozen=True)
class VectorScorer:
    """Cosine of ``query_vector`` and ``doc_vector``."""

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("score", columns.cosine(F.col("query_vector"), F.col("doc_vector")))


@dataclass(frozen=True)
class LateInteractionScorer:
    """The logistic curve of the summed best cosines of ``query_vectors`` with ``doc_vectors``."""

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("score", columns.sigmoid(columns.maxsim(F.col("query_vectors"), F.col("doc_vectors"))))


@lru_cache(maxsize=2)
def _session(model: bytes | str, tokenizer: bytes | str):
    """One session for a Python worker, of one thread: partitions are the workers."""
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    known = onnxruntime.get_available_providers()
    providers = [p for p in ("TensorrtExecutionProvider", "CUDAExecutionProvider", "CPUExecutionProvider") if p in known]
    read = Tokenizer.from_file if isinstance(tokenizer, str) else Tokenizer.from_buffer
    session = onnxruntime.InferenceSession(model, options, providers=providers)
    return session, {i.name for i in session.get_inputs()}, read(tokenizer)


def pair_tensors(tokenizer, queries: list[str], docs: list[str], max_length: int) -> dict[str, np.ndarray]:
    """Token ids, mask and type ids of pairs, cut to ``max_length`` and padded to the longest of the batch."""
    tokenizer.enable_truncation(max_length)
    tokenizer.no_padding()
    found = tokenizer.encode_batch(list(zip(queries, docs, strict=True)))
    width = max((len(e.ids) for e in found), default=0)
    names = {"input_ids": "ids", "attention_mask": "attention_mask", "token_type_ids": "type_ids"}
    out = {name: np.zeros((len(found), width), np.int64) for name in names}
    for name, field_ in names.items():
        for row, e in zip(out[name], found, strict=True):
            row[: len(e.ids)] = getattr(e, field_)
    return out


@dataclass(frozen=True)
class OnnxScorer:
    """A cross-encoder in ONNX, from files that executors see or from bytes.

    Batches go through one opaque map, so no filter above can make the model run twice, and a session is made only when a row
    arrives. Pairs are put in order of length before they are cut into batches, so that little is padded. Models of two and of
    three inputs are told apart by their signature. A batch that fails gives null scores and its message in ``error``.
    """

    model: str | bytes
    tokenizer: str | bytes
    config: ModelConfig = field(default_factory=ModelConfig)
    settings: RerankConfig = field(default_factory=RerankConfig)

    def score(self, candidates: DataFrame) -> DataFrame:
        names = candidates.columns
        q, d = names.index("query"), names.index("doc")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                session, inputs, tokenizer = _session(self.model, self.tokenizer)
                queries, docs = ([x or "" for x in batch.column(i).to_pylist()] for i in (q, d))
                order = sorted(range(len(docs)), key=lambda i: len(queries[i]) + len(docs[i]))
                scores: list[float | None] = [None] * len(docs)
                errors: list[str | None] = [None] * len(docs)
                for at in range(0, len(order), self.settings.batch_size):
                    part = order[at : at + self.settings.batch_size]
                    try:
                        tensors = pair_tensors(tokenizer, [queries[i] for i in part], [docs[i] for i in part], self.config.max_length)
                        logits = session.run(None, {k: v for k, v in tensors.items() if k in inputs})[0].reshape(len(part), -1)[:, 0]
                        if self.settings.normalize_scores:
                            logits = 1.0 / (1.0 + np.exp(-logits.astype(np.float64)))
                        for i, s in zip(part, logits, strict=True):
                            scores[i] = float(s)
                    except Exception as e:  # noqa: BLE001  whatever the model raises belongs to the rows it was given
                        for i in part:
                            errors[i] = f"inference error: {e}"
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(errors, pa.string())], names=[*names, "score", "error"])

        return candidates.mapInArrow(run, f"{fields}, score double, error string")


def encode_once(texts: DataFrame, encode, path: str | None = None) -> DataFrame:
    """``text, vectors``: each distinct text encoded once by ``encode``, an Arrow UDF from text to token vectors; kept at ``path`` if given."""
    out = texts.select("text").distinct().withColumn("vectors", encode("text"))
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    return texts.sparkSession.read.parquet(path)
