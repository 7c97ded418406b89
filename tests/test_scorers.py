"""The ONNX scorer with a model made here, and the small API."""

import asyncio

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom import api, cli, errors
from rankloom.config import ModelConfig, RerankConfig
from rankloom.operators import experiment, rank, retrieval, scorers, statistics

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, kind, dims):
    shape = b"".join(part(1, part(2, d) if isinstance(d, str) else part(1, d)) for d in dims)
    return part(1, name) + part(2, part(1, part(1, kind) + part(2, shape)))


def node(kind, inputs, output, **attributes):
    out = b"".join(part(1, i) for i in inputs) + part(2, output) + part(4, kind)
    for name, value in attributes.items():
        body = part(1, name) + (part(8, value[0]) + part(20, 7) if isinstance(value, list) else part(3, value) + part(20, 2))
        out += part(5, body)
    return out


def model(three_inputs, width="s"):
    """Its logit is the number of tokens, and of tokens of the second type where there is a third input."""
    counted = "token_type_ids" if three_inputs else "attention_mask"
    names = ["input_ids", "attention_mask"] + ["token_type_ids"] * three_inputs
    nodes = [node("Cast", [counted], "f", to=1), node("ReduceSum", ["f"], "logits", axes=[1], keepdims=1)]
    graph = b"".join(part(1, n) for n in nodes) + part(2, "g")
    graph += b"".join(part(11, tensor(n, 7, ["b", width])) for n in names) + part(12, tensor("logits", 1, ["b", 1]))
    return part(1, 7) + part(7, graph) + part(8, part(2, 11))


def candidates(spark, docs, query="a query"):
    return spark.createDataFrame([("q", query, i, d) for i, d in enumerate(docs)], "qid string, query string, idx int, doc string")


@pytest.mark.parametrize("three", [False, True])
def test_onnx(spark, three):
    docs = ["one two three four", "one", None, "one two"]
    with open(TOKENIZER, "rb") as f:
        scorer = scorers.OnnxScorer(model(three), f.read(), ModelConfig(max_length=64), RerankConfig(batch_size=2, normalize_scores=False))
    found = scorer.score(candidates(spark, docs)).collect()
    assert not any(r["error"] for r in found)
    by = {r["idx"]: r["score"] for r in found}
    if not three:
        t = Tokenizer.from_file(TOKENIZER)
        assert by == {i: float(len(t.encode("a query", d or "").ids)) for i, d in enumerate(docs)}
    assert [r["idx"] for r in rank.rerank(candidates(spark, docs), scorer, 2).orderBy("rank").collect()] == ([0, 3] if not three else [0, 3] if by[0] else [0, 1])


def test_onnx_cuts_to_the_length_and_normalizes(spark):
    scorer = scorers.OnnxScorer(model(False), TOKENIZER, ModelConfig(max_length=5), RerankConfig())
    found = scorer.score(candidates(spark, ["word " * 1000])).first()["score"]
    assert found == pytest.approx(1 / (1 + np.exp(-5)))


def test_a_failing_batch_marks_its_rows(spark):
    scorer = scorers.OnnxScorer(model(False, width=3), TOKENIZER, settings=RerankConfig(batch_size=1))
    found = {r["idx"]: r for r in scorer.score(candidates(spark, ["x", "x y z and more"], "y")).collect()}
    assert {i: r["score"] is None for i, r in found.items()} == {i: r["error"] is not None for i, r in found.items()}
    assert found[1]["error"].startswith("inference error")


def test_the_model_runs_once_under_a_filter(spark):
    scorer = scorers.OnnxScorer(model(False), TOKENIZER)
    plan = scorer.score(candidates(spark, ["x"])).where("score > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pair_tensors():
    tensors = scorers.pair_tensors(Tokenizer.from_file(TOKENIZER), ["a b", "c"], ["d e f", ""], 4)
    assert {v.shape for v in tensors.values()} == {(2, 4)} and tensors["attention_mask"].sum(1).tolist() == [4, 1]


def test_reranker(spark):
    r = api.Reranker(spark, scorers.LexicalScorer())
    docs = ["blue sky", "red fox", "fox"]
    assert [x.index for x in r.rerank("red fox", docs)] == [1, 2, 0]
    assert r.rerank("red fox", docs, 1, return_documents=True)[0].document == "red fox"
    assert r.rerank("red fox", []) == [] and r.rerank("red fox", docs, 0) == []
    hybrid = r.rerank_hybrid("red fox", docs, [9.0, 1.0, 0.0], alpha=0.25)
    assert [x.index for x in hybrid] == [0, 1, 2] and hybrid[0].score == pytest.approx(0.75 / 61 + 0.25 / 63)
    with pytest.raises(errors.InferenceError, match="a query without text"):
        r.rerank("", docs)
    with pytest.raises(errors.InferenceError):
        r.rerank_hybrid("x", docs, [1.0])
    r.unload()
    with pytest.raises(errors.ModelError):
        r.rerank("red fox", docs)


def test_reranking_without_waiting(spark):
    r = api.Reranker(spark, scorers.LexicalScorer())

    async def both():
        return await asyncio.gather(r.arerank("red fox", ["blue", "red fox"]), r.arerank("blue", ["blue", "red fox"], 1))

    one, two = asyncio.run(both())
    assert [x.index for x in one] == [1, 0] and [x.index for x in two] == [0]


def test_pipeline(spark):
    corpus = spark.createDataFrame([(1, "the red fox runs"), (2, "red red red"), (3, "nothing")], "doc_id bigint, text string")
    found = api.Pipeline(retrieval.Bm25(corpus), corpus, api.Reranker(spark, scorers.LexicalScorer())).search("red fox", 1)
    assert [x.document for x in found] == ["the red fox runs"]


def test_load_without_a_cache(spark, tmp_path):
    with pytest.raises(errors.CacheError):
        api.load(spark, "org/none", root=tmp_path)
    with pytest.raises(errors.ConfigError):
        api.load(spark, "org/none", device="abacus", root=tmp_path)


def test_encode_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<array<float>>")
    def encode(text):
        seen.add(1)
        return [[float(len(text))]]

    texts = spark.createDataFrame([("aa",), ("b",), ("aa",)], "text string")
    found = scorers.encode_once(texts, encode, str(tmp_path / "vectors"))
    assert sorted((r["text"], r["vectors"]) for r in found.collect()) == [("aa", [[2.0]]), ("b", [[1.0]])] and seen.value == 2


def test_late_interaction(spark):
    rows = spark.createDataFrame([([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])], "query_vectors array<array<double>>, doc_vectors array<array<double>>")
    assert scorers.LateInteractionScorer().score(rows).first()["score"] == pytest.approx(1 / (1 + np.exp(-1)))


def test_configured_requests(spark):
    kind = "name string, at bigint, weight_a int, weight_b int, retain string"
    configs = spark.createDataFrame([("t", 10, 100, 0, None), ("t", 20, 0, 100, None), ("t", 30, 5, 5, "a"), ("u", 0, 0, 0, None)], kind)
    asked = spark.createDataFrame([("t", t) for t in (5, 10, 19, 20, 35)] + [("u", 1), ("v", 1)], "name string, at bigint")
    found = experiment.configured(asked, configs).select("name", "at", experiment.variant(F.lit("x"), F.col("config")).alias("v"), F.col("config.active").alias("on"))
    assert sorted(map(tuple, found.collect())) == [("t", 5, None, None), ("t", 10, "a", True), ("t", 19, "a", True), ("t", 20, "b", True), ("t", 35, "a", False), ("u", 1, "a", True), ("v", 1, None, None)]


def test_targets_and_observation(spark):
    stats = statistics.latency_stats(spark.createDataFrame([(10.0,), (20.0,)], "ms double"), "ms")
    assert statistics.within_target(stats).first()["within_target"] and not statistics.within_target(stats, 5.0).first()["within_target"]
    rows = spark.createDataFrame([(0.5,), (1.0,)], "score double")
    assert statistics.observed(rows).count() == 2


def test_command_line(tmp_path, capsys):
    assert cli.main(["models", "delete"]) == 2
    assert cli.main(["models", "delete", "org/none", "--cache", str(tmp_path)]) == 1
    with pytest.raises(SystemExit):
        cli.main(["models", "forget"])
    capsys.readouterr()
