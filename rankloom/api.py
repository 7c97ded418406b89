"""A small API for one query at a time: the operators behind plain lists."""

from __future__ import annotations

import asyncio
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankloom.config import ModelConfig, RerankConfig
from rankloom.errors import InferenceError, ModelError
from rankloom.functions import names
from rankloom.operators import fusion, rank, retrieval, scorers

CANDIDATE = "qid string, query string, idx int, doc string"


@dataclass(frozen=True)
class Result:
    index: int
    score: float
    document: str | None = None


def load(spark: SparkSession, model_id: str, device: str = "cpu", precision: str = "fp32", root=None) -> Reranker:
    """A reranker with a cached model."""
    config = ModelConfig(model_id, names.parse_precision(precision), names.parse_device(device))
    model, tokenizer = names.load_model(root or names.cache_root(), model_id, config.device)
    return Reranker(spark, scorers.OnnxScorer(str(model), str(tokenizer), config, RerankConfig()))


class Reranker:
    """Reranks lists with a scorer; unusable after ``unload``."""

    def __init__(self, spark: SparkSession, scorer):
        self.spark, self.scorer = spark, scorer

    def _candidates(self, query: str, documents: Sequence[str]):
        if self.scorer is None:
            raise ModelError("the model is unloaded")
        if not query:
            raise InferenceError("a query without text")
        return self.spark.createDataFrame([("q", query, i, d) for i, d in enumerate(documents)], CANDIDATE)

    def rerank(self, query: str, documents: Sequence[str], top_k: int | None = None, return_documents: bool = False) -> list[Result]:
        found = rank.rerank(self._candidates(query, documents), self.scorer, top_k, return_documents)
        rows = sorted(found.collect(), key=lambda r: r["rank"])
        return [Result(r["idx"], r["score"], r["document"] if return_documents else None) for r in rows]

    async def arerank(self, query: str, documents: Sequence[str], top_k: int | None = None, return_documents: bool = False) -> list[Result]:
        """``rerank`` in a thread of its own, for callers that must not wait."""
        return await asyncio.to_thread(self.rerank, query, documents, top_k, return_documents)

    def rerank_hybrid(self, query: str, documents: Sequence[str], lexical_scores: Sequence[float], alpha: float = 0.5) -> list[Result]:
        """All documents by the fusion of their given scores (weight ``1 - alpha``) and the scorer's (``alpha``)."""
        if len(documents) != len(lexical_scores):
            raise InferenceError(f"{len(documents)} documents and {len(lexical_scores)} scores")
        given = self.spark.createDataFrame([("q", i, float(s)) for i, s in enumerate(lexical_scores)], "qid string, idx int, score double")
        scored = self.scorer.score(self._candidates(query, documents))
        fused = fusion.hybrid(fusion.as_list(given, 0, doc="idx"), fusion.as_list(scored, 1, doc="idx"), alpha)
        return [Result(r["doc_id"], r["score"]) for r in fused.orderBy("rank").collect()]

    def unload(self) -> None:
        self.scorer = None


class Pipeline:
    """Retrieval, then reranking; indexes in results refer to the retrieved list."""

    def __init__(self, retriever: retrieval.Retriever, corpus, reranker: Reranker):
        self.retriever, self.corpus, self.reranker = retriever, corpus, reranker

    def search(self, query: str, top_k: int = 10, retrieve: int = 100) -> list[Result]:
        asked = self.reranker.spark.createDataFrame([("q", query)], "qid string, query string")
        found = self.retriever.search(asked, retrieve).join(self.corpus.select("doc_id", "text"), "doc_id").orderBy("idx")
        return self.reranker.rerank(query, [r["text"] for r in found.collect()], top_k, return_documents=True)
