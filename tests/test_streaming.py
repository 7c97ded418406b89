"""Streams give what their batch twins give."""

import json
import time

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rankloom import sinks
from rankloom.config import CanaryConfig, DriftConfig
from rankloom.operators import drift, rollout, scorers, statistics
from rankloom.streaming import monitor, serving


def streamed(spark, frames, schema, folder, query):
    """Runs ``query`` over a stream of a file for each frame; all output rows."""
    source = folder / "in"
    source.mkdir()
    for i, frame in enumerate(frames):
        pq.write_table(spark.createDataFrame(frame, schema).toArrow(), source / f"{i:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = []
    writer = query(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect()))
    writer.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_drift_stream(spark, tmp_path):
    n = 900
    scores = [0.2 + (i % 7) / 50 if i < 300 or i > 600 else 0.9 for i in range(n)]
    frame = pd.DataFrame({"model": "m", "ts": pd.date_range("2024-01-01", periods=n, freq="s"), "event_id": range(n), "kind": "score", "score": scores}).astype({"score": "float32"})
    schema = "model string, ts timestamp_ntz, event_id bigint, kind string, score float"
    cfg = DriftConfig(threshold=0.3, warm_up=100)
    out = streamed(spark, [frame[i : i + 250] for i in range(0, n, 250)], schema, tmp_path, lambda s: monitor.drift_stream(s, 50, cfg))
    rows = drift.numbered(spark.createDataFrame(frame).withColumn("score", F.col("score").cast("float")))
    batch = drift.checks(rows, 50, cfg).orderBy("n").collect()
    found = sorted(out, key=lambda r: r["n"])
    assert [(r["n"], r["status"], r["alerts"]) for r in found] == [(r["n"], r["status"], r["alerts"]) for r in batch]
    for a, b in zip(found, batch, strict=True):
        # a column of doubles may turn null into NaN on its way through pandas
        assert (b["kl"] is None and (a["kl"] is None or a["kl"] != a["kl"])) or abs(a["kl"] - b["kl"]) < 1e-9


def test_drift_reset(spark, tmp_path):
    n = 400
    kinds = ["score"] * n
    kinds[299] = "reset"
    frame = pd.DataFrame({"model": "m", "ts": pd.date_range("2024-01-01", periods=n, freq="s"), "event_id": range(n), "kind": kinds, "score": [0.2] * 100 + [0.9] * 300}).astype({"score": "float32"})
    schema = "model string, ts timestamp_ntz, event_id bigint, kind string, score float"
    out = streamed(spark, [frame], schema, tmp_path, lambda s: monitor.drift_stream(s, 99, DriftConfig(threshold=0.3, warm_up=99)))
    assert [r["status"] for r in sorted(out, key=lambda r: r["n"])] == ["Stable", "Warning", "Warning", "Stable"]


def test_canary_stream(spark, tmp_path):
    schema = "canary string, tick bigint, at double, drift string, latency_ok boolean, command string"
    frame = pd.DataFrame([("a" if i % 2 else "b", i, float(i), "Critical" if i == 25 else "Stable", True, "advance" if i == 4 else None) for i in range(40)], columns=["canary", "tick", "at", "drift", "latency_ok", "command"])
    cfg = CanaryConfig(observation_seconds=7.0)
    out = streamed(spark, [frame[i : i + 15] for i in range(0, 40, 15)], schema, tmp_path, lambda s: monitor.canary_stream(s, cfg))
    batch = rollout.canary_course(spark.createDataFrame(frame, schema), cfg).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch))


def test_serving(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    requests = [
        {"qid": "1", "query": "red fox", "documents": ["blue fox", "red fox", "tree"], "top_k": 2, "return_documents": True},
        {"qid": "2", "query": "", "documents": ["x"]},
        {"qid": "3", "query": "y", "documents": []},
    ]
    (source / "a.txt").write_text("\n".join(map(json.dumps, requests)))
    got = {}
    stream = spark.readStream.text(str(source))
    scorer = scorers.LexicalScorer()
    writer = serving.serve(stream, {"a": scorer, "b": scorer}, (1, 1), lambda frame, _: got.update({r["qid"]: (json.loads(r["response"]), r["variant"]) for r in frame.collect()}))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["index"], r["document"]) for r in got["1"][0]["results"]] == [(1, "red fox"), (0, "blue fox")]
    assert "a query without text" in got["2"][0]["error"] and got["3"][0] == {"results": []}
    assert {v for _, v in got.values()} <= {"a", "b"}


def test_variant_stream(spark):
    rows = spark.createDataFrame([("a", float(i), False) for i in range(100)] + [("a", 1.0, True)], "variant string, latency double, is_error boolean")
    found = monitor.variant_stream(rows).first()
    assert (found["n"], found["errors"], found["mean"]) == (100, 1, 49.5)


def test_progress_and_json(spark, tmp_path):
    told = []
    listener = sinks.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().withColumn("score", F.lit(0.5))
        query = statistics.observed(stream).writeStream.foreachBatch(lambda b, _: sinks.append_json(b.select("value", F.lit(None).cast("int").alias("gone")), str(tmp_path / "out")))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
        while not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.1)
        query.stop()
        for _ in range(50):
            if any(t["event"] == "terminated" for t in told):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = [t for t in told if t["event"] == "progress" and t["numInputRows"]]
    assert rows and rows[0]["observedMetrics"]["scores"]["mean"] == 0.5
    found = spark.read.json(str(tmp_path / "out"))
    assert found.columns == ["value"] and found.count() >= 5
