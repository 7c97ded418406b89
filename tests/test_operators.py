import math

import pytest
from pyspark.sql import functions as F

from rankloom import config, errors
from rankloom.operators import calibration, cascade, drift, evaluation, fusion, rank, retrieval, rollout, scorers, statistics

CANDIDATES = "qid string, query string, idx int, doc string, s double"


def candidates(spark, scores, qid="q"):
    return spark.createDataFrame([(qid, "query", i, f"d{i}", s) for i, s in enumerate(scores)], CANDIDATES)


def order(frame):
    return [r["idx"] for r in sorted(frame.collect(), key=lambda r: r["rank"])]


GIVEN = scorers.ColumnScorer("s")


@pytest.mark.parametrize(
    "scores,k,expected",
    [([-10.0, -1.0, 0.0, 1.0, 10.0], None, [4, 3, 2, 1, 0]), ([0.5, 0.5, 0.5], None, [0, 1, 2]), ([0.1, 0.9, 0.5], 2, [1, 2]), ([0.1], 5, [0]), ([0.1, 0.2], 0, []), ([float("nan"), 0.2, None], None, [1, 2, 0])],
)
def test_rerank(spark, scores, k, expected):
    assert order(rank.rerank(candidates(spark, scores), GIVEN, k)) == expected


def test_documents_are_attached(spark):
    found = rank.rerank(candidates(spark, [0.1, 0.2]), GIVEN, 1, return_documents=True).first()
    assert found["document"] == "d1"


def test_requests(spark):
    kind = "qid string, query string, documents array<string>, top_k int, return_documents boolean"
    rows = spark.createDataFrame([("a", "x", ["p", "q"], 1, True), ("b", "x", [], None, False)], kind)
    assert [(r["qid"], r["idx"]) for r in rank.requests_to_candidates(rows).orderBy("idx").collect()] == [("a", 0), ("a", 1)]
    with pytest.raises(Exception, match="a query without text"):
        rank.requests_to_candidates(spark.createDataFrame([("a", "", ["p"], 1, True)], kind)).collect()


def test_responses_leave_out_absent_documents(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 1, None), ("a", 0, 0.25, 2, "t")], "qid string, idx int, score double, rank int, document string")
    assert rank.responses(rows).first()["response"] == '{"results":[{"index":1,"score":0.5},{"index":0,"score":0.25,"document":"t"}]}'


def lists(spark, *docs):
    return [spark.createDataFrame([("q", i, r, d, 1.0 - r / 10) for r, d in enumerate(x)], "qid string, list_id int, rank0 int, doc_id bigint, score double") for i, x in enumerate(docs)]


def fused(spark, docs, cfg=config.FusionConfig()):
    return {r["doc_id"]: r["score"] for r in fusion.reciprocal_rank_fusion(lists(spark, *docs), cfg).collect()}


def test_lists_rank_null_and_nan_last(spark):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.5, float("nan"), None, 0.9, 0.5])], "qid string, doc_id bigint, score double")
    assert [r["doc_id"] for r in fusion.as_list(rows, 0).orderBy("rank0").collect()] == [3, 0, 4, 2, 1]
    ranked = fusion.reciprocal_rank_fusion(lists(spark, [5, 3, 9], [3, 5]))
    assert [(r["doc_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(3, 1), (5, 2), (9, 3)]


def test_fusion(spark):
    assert fused(spark, ([0, 1, 2], [1, 2, 3])) == pytest.approx({0: 1 / 61, 1: 1 / 62 + 1 / 61, 2: 1 / 63 + 1 / 62, 3: 1 / 63})
    three = fused(spark, ([0, 1], [1, 2], [1, 0]))
    assert len(three) == 3 and max(three, key=three.get) == 1
    assert fused(spark, ([0, 1, 2],)) == pytest.approx({0: 1.0, 1: 0.9, 2: 0.8})
    assert fusion.reciprocal_rank_fusion([]) is None
    assert fused(spark, ([0, 1], [1, 0]), config.FusionConfig(60, (0.3, 0.7))) == pytest.approx({0: 0.3 / 61 + 0.7 / 62, 1: 0.3 / 62 + 0.7 / 61})
    assert fused(spark, ([0], [1]), config.FusionConfig(60, (0.0, 1.0))) == pytest.approx({0: 0.0, 1: 1 / 61})
    assert fused(spark, ([0], [1]), config.FusionConfig(60, (0.5,)))[1] == pytest.approx(1 / 61)
    assert fused(spark, ([0, 0], [1])) == pytest.approx({0: 1 / 61 + 1 / 62, 1: 1 / 61})
    assert fused(spark, ([0, 1], [1, 0]), config.FusionConfig(0.0)) == pytest.approx({0: 1.5, 1: 1.5})
    one, two = lists(spark, [0, 1], [1, 0])
    assert {r["doc_id"]: r["score"] for r in fusion.hybrid(one, two, 1.0).collect()} == pytest.approx({0: 1 / 62, 1: 1 / 61})


class Big:
    """Scores from a mapping; records what it is asked."""

    def __init__(self, given, fails=False):
        self.given, self.fails = given, fails

    def score(self, rows):
        pick = F.create_map(*[F.lit(x) for kv in self.given.items() for x in kv]) if self.given else None
        out = rows.withColumn("score", pick[F.col("idx")] if self.given else F.raise_error(F.lit("asked")).cast("double"))
        return out.withColumn("error", F.lit("down" if self.fails else None).cast("string"))


@pytest.mark.parametrize(
    "fast,big,fails,k,expected",
    [
        ([0.9, 0.5, 0.1], {1: 0.75}, False, 10, [0, 1]),
        ([0.95, 0.90, 0.88], {}, False, 10, [0, 1, 2]),
        ([0.9, 0.5, 0.1], {1: 0.75}, True, 10, [0]),
        ([0.05, 0.10, 0.02], {}, False, 10, []),
        ([0.4, 0.5, 0.6], {0: 0.1, 1: 0.2, 2: 0.3}, False, 10, [2, 1, 0]),
        ([0.9, 0.92, 0.95, 0.88, 0.91], {}, False, 2, [2, 1]),
        ([0.9, 0.5, 0.1, 0.6], {1: 0.3, 3: 0.4}, False, 10, [0, 3, 1]),
        ([float("nan"), 0.85, 0.15], {2: 0.2}, False, 10, [1, 2]),
    ],
)
def test_cascade(spark, fast, big, fails, k, expected):
    assert order(cascade.cascade(candidates(spark, fast), GIVEN, Big(big, fails), k)) == expected


def test_a_failure_drops_doubtful_rows_of_its_query_only(spark):
    class Half:
        def score(self, rows):
            return rows.withColumn("score", F.lit(0.5)).withColumn("error", F.when((F.col("qid") == "x") & (F.col("idx") == 1), "down"))

    both = candidates(spark, [0.9, 0.5, 0.4], "x").unionByName(candidates(spark, [0.9, 0.5, 0.4], "y"))
    found = cascade.cascade(both, GIVEN, Half(), 10)
    assert sorted((r["qid"], r["idx"]) for r in found.collect()) == [("x", 0), ("y", 0), ("y", 1), ("y", 2)]


def test_platt_fit(spark):
    rows = [((i - 100) / 50.0, 1 / (1 + math.exp(-2 * (i - 100) / 50.0 + 1)) > (7 * i % 100) / 100) for i in range(200)]
    a, b = calibration.fit_platt(spark.createDataFrame(rows, "score float, label boolean"))
    assert abs(a + 2) < 1.5 and abs(b - 1) < 1.5
    assert (a, b) == pytest.approx((-1.756060, 0.807680), abs=1e-3)


def test_platt_errors_and_single_class(spark):
    few = spark.createDataFrame([(0.1, True)] * 9, "score float, label boolean")
    with pytest.raises(errors.CalibrationError, match="10"):
        calibration.fit_platt(few)
    with pytest.raises(errors.CalibrationError):
        calibration.fit_platt(spark.createDataFrame([(0.1, None)] * 20, "score float, label boolean"))
    for label in (True, False):
        a, b = calibration.fit_platt(spark.createDataFrame([(i / 20, label) for i in range(20)], "score float, label boolean"))
        assert (1 / (1 + math.exp(a + b)) > 0.5) == label


@pytest.mark.parametrize("bins", [1, 10, 100])
def test_ece(spark, bins):
    rows = spark.createDataFrame([(i / 50, i % 3 == 0) for i in range(51)], "prob double, label boolean")
    assert 0 <= calibration.expected_calibration_error(rows, bins).first()["ece"] <= 1
    assert calibration.expected_calibration_error(rows.limit(0), bins).first()["ece"] == 0
    with pytest.raises(errors.CalibrationError):
        calibration.expected_calibration_error(rows, 0)


def metrics(spark, ranked, rel, k):
    shown = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranked)], "qid string, doc_id int, rank int")
    judged = spark.createDataFrame([("q", d, r) for d, r in enumerate(rel)], "qid string, doc_id int, rel int")
    return evaluation.ndcg_at(shown, judged, k).first()["ndcg"], evaluation.reciprocal_rank(shown, judged).first()["rr"]


def test_ranking_metrics(spark):
    assert metrics(spark, [0, 1, 2], [3, 2, 1], 3) == (pytest.approx(1.0), 1.0)
    assert 0 < metrics(spark, [2, 1, 0], [3, 2, 1], 3)[0] < 1
    assert metrics(spark, [0, 1, 2], [0, 0, 0], 3) == (0.0, 0.0)
    assert metrics(spark, [2, 0, 1], [3, 2, 0], 1)[0] == 0 < metrics(spark, [2, 0, 1], [3, 2, 0], 3)[0]
    assert metrics(spark, [3, 1, 2, 0], [1, 0, 1, 0], 4)[1] == pytest.approx(1 / 3)


def test_ideal_order_is_over_all_judgments(spark):
    # the best document is not ranked at all
    ndcg, _ = metrics(spark, [1], [3, 1], 10)
    assert ndcg == pytest.approx(1 / 7)


def test_macro_means_differ_in_unjudged_queries(spark):
    per = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "qid string, ndcg double")
    all_ = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    assert evaluation.macro_mean(per).first()["ndcg"] == 0.75
    assert evaluation.macro_mean(per, all_).first()["ndcg"] == 0.5
    assert evaluation.macro_mean(per.limit(0)).first()["ndcg"] == 0.0


def test_negatives(spark):
    queries = spark.createDataFrame([("q",)], "qid string")
    corpus = spark.range(50).select(F.col("id").alias("doc_id"))
    judged = spark.createDataFrame([("q", 3, 1), ("q", 7, 0), ("q", 99, 1)], "qid string, doc_id bigint, rel int")
    found = evaluation.sampled_negatives(queries, corpus, judged, 10).orderBy("idx").collect()
    assert [r["idx"] for r in found] == list(range(10))
    assert [r["doc_id"] for r in found[:2]] == [3, 7] and not {3, 7} & {r["doc_id"] for r in found[2:]}
    again = evaluation.sampled_negatives(queries, corpus, judged, 10).orderBy("idx").collect()
    assert found == again
    assert evaluation.sampled_negatives(queries, corpus, judged, 1).count() == 2


def test_percentiles_by_index(spark):
    rows = spark.createDataFrame([("a", float(i), False) for i in range(1, 101)] + [("b", 15.0, False), ("b", 0.0, True)], "variant string, latency double, is_error boolean")
    found = {r["variant"]: r for r in statistics.variant_metrics(rows).collect()}
    assert (found["a"]["p50"], found["a"]["p95"], found["a"]["p99"], found["a"]["n"]) == (51, 96, 100, 100)
    assert (found["b"]["n"], found["b"]["errors"], found["b"]["mean"]) == (1, 1, 15.0)
    stats = statistics.latency_stats(rows.where("variant = 'a'"), "latency").first()
    assert (stats["p50"], stats["p95"], stats["p99"], stats["mean"]) == (51, 96, 100, 50.5)
    assert stats["qps"] == pytest.approx(100 / 5.05)
    assert statistics.at_index(rows, ["variant"], "latency", statistics.UNCLAMPED).where("variant = 'a'").first()["p95"] == 96


def test_only_errors(spark):
    rows = spark.createDataFrame([("a", 5.0, True)], "variant string, latency double, is_error boolean")
    found = statistics.variant_metrics(rows).first()
    assert (found["n"], found["total"], found["mean"], found["errors"], found["p50"]) == (0, 0.0, 0.0, 1, 0.0)


def test_server_metrics_of_nothing(spark):
    rows = spark.createDataFrame([], "latency_seconds double, is_error boolean, batch_size int")
    assert tuple(statistics.server_metrics(rows).first()) == (0, 0, 0.0, 0.0)


def test_least_loaded(spark):
    rows = spark.createDataFrame([(0, 5, True), (1, 2, True), (2, 2, True), (3, 0, False)], "device_id int, in_flight int, healthy boolean")
    assert statistics.least_loaded(rows).first()["device_id"] == 1
    assert statistics.least_loaded(rows.where("not healthy")).count() == 0


def test_bm25_and_two_stage(spark):
    corpus = spark.createDataFrame([(1, "the cat sat"), (2, "the dog ran far away"), (3, "cat cat cat"), (4, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "cat"), ("r", "zebra")], "qid string, query string")
    found = retrieval.Bm25(corpus).search(queries, 10).orderBy("idx").collect()
    assert [r["doc_id"] for r in found] == [3, 1]
    both = retrieval.two_stage(retrieval.Bm25(corpus), queries, corpus, scorers.LexicalScorer(), 10, 1).collect()
    assert [(r["qid"], r["doc_id"], r["idx"]) for r in both] == [("q", 3, 0)]


def observed(spark, scores):
    return spark.createDataFrame([("m", i + 1, s) for i, s in enumerate(scores)], "model string, n int, score float")


def test_decayed_histogram_is_the_sequential_one(spark):
    scores = [(7 * i % 31) / 30 for i in range(500)]
    bins = [0.0] * 100
    for i, s in enumerate(scores):
        if i:
            bins = [b * 0.99 for b in bins]
        bins[min(int(s * 100 + 1e-6), 99)] += 1
    found = {r["bin"]: r["weight"] for r in drift.histogram(observed(spark, scores)).collect()}
    assert sum(found.values()) == pytest.approx(sum(bins))
    assert found == pytest.approx({i: b for i, b in enumerate(bins) if b})


def test_equal_histograms_do_not_diverge(spark):
    h = drift.histogram(observed(spark, [i / 100 for i in range(100)]))
    assert abs(drift.kl(h, h).first()["kl"]) < 1e-6


def test_drift_escalates_and_recovers(spark):
    cfg = config.DriftConfig(threshold=0.1, warm_up=100)
    low, high = [0.5] * 100, [0.95] * 600
    found = drift.checks(observed(spark, low + high + [0.5] * 2000), 100, cfg).orderBy("n").collect()
    said = [r["status"] for r in found]
    assert said[0] == "Stable" and said[1:5] == ["Warning"] * 4 and said[5:7] == ["Critical"] * 2
    assert "Recovered" in said and said[-1] == "Stable"
    assert said[said.index("Recovered") - 1] == "Critical" and found[said.index("Recovered")]["alerts"] == 0


def test_no_status_before_the_baseline(spark):
    found = drift.checks(observed(spark, [0.5] * 60), 20, config.DriftConfig(warm_up=1000)).collect()
    assert {r["status"] for r in found} == {"InsufficientData"} and {r["kl"] for r in found} == {None}


TICKS = "canary string, tick bigint, at double, drift string, latency_ok boolean, command string"


def course(spark, ticks, cfg=config.CanaryConfig(observation_seconds=0.0)):
    rows = spark.createDataFrame([("c", i, float(i), d, ok, cmd) for i, (d, ok, cmd) in enumerate(ticks)], TICKS)
    return [(r["action"], r["state"], r["percent"]) for r in rollout.canary_course(rows, cfg).orderBy("tick").collect()]


def test_canary(spark):
    fine = ("Stable", True, None)
    assert [x[0] for x in course(spark, [fine] * 5)] == ["Advance(5)", "Advance(25)", "Advance(100)", "Complete", "None"]
    for bad in (("Warning", True, None), ("Critical", True, None), ("Stable", False, None)):
        assert course(spark, [fine, bad, fine])[1:] == [("Rollback", "RollingBack", 0), ("None", "RollingBack", 0)]
    assert course(spark, [("Recovered", True, None)])[0][0] == "Advance(5)"
    slow = config.CanaryConfig(observation_seconds=300.0)
    assert course(spark, [fine, ("Stable", True, "advance"), ("Stable", True, "abort")], slow) == [("None", "Active", 1), ("Advance(5)", "Active", 5), ("Rollback", "RollingBack", 0)]
    assert rollout.remaining(rollout.started(10.0), 60.0, slow) == 250.0
    assert rollout.checked(rollout.Canary(), 0.0, "Critical", True, slow)[1] == "None"


def test_batches(spark):
    kind = "stream string, request_id bigint, at double"
    rows = spark.createDataFrame([("s", i, 0.001 * i) for i in range(20)] + [("t", 1, 0.0), ("t", 2, 1.0)], kind)
    found = rollout.batches(rows, config.BatchConfig(16, 60.0)).collect()
    assert sorted((r["stream"], r["batch_id"]) for r in found).count(("s", 0)) == 16 and len(found) == 22
    apart = {r["request_id"]: r["batch_id"] for r in rollout.batches(rows.where("stream = 't'"), config.BatchConfig(16, 0.5)).collect()}
    assert apart == {1: 0, 2: 1}
    with pytest.raises(errors.ConfigError):
        config.BatchConfig(0, 1.0)
