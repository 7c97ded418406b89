import json

import pytest

from rankloom import errors
from rankloom.config import Device
from rankloom.functions import names
from rankloom.sources import beir, registry


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture
def folder(tmp_path):
    lines(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "which moons has it"}, "", {"_id": "q2", "text": "how tides turn", "metadata": {}}, {"_id": "q3", "text": "unjudged"}])
    lines(tmp_path / "corpus.jsonl", [{"_id": "d1", "title": "Moons", "text": "go round"}, {"_id": "d2", "title": "Tides", "text": "come twice"}, {"_id": "d3", "title": "", "text": "plain"}, {"_id": "d4", "text": "other"}])
    judged = ["query-id\tcorpus-id\tscore", "q1\td1\t2", "q2\td2\t1", "q1\td3", "q1\td2\tabc", "q2\td3\t-1", "q9\td1\t1", "q1\td9\t1", "q2\td1\t1", "q2\td1\t3"]
    lines(tmp_path / "qrels" / "test.tsv", judged)
    lines(tmp_path / "qrels" / "dev.tsv", ["query-id\tcorpus-id\tscore", "q1\td1\t1", "q2\td2\t1"])
    return tmp_path


def test_beir(spark, folder):
    data = beir.load_beir(spark, str(folder))
    assert data.queries.count() == 3
    assert {r["doc_id"]: r["text"] for r in data.corpus.collect()} == {"d1": "Moons go round", "d2": "Tides come twice", "d3": "plain", "d4": "other"}
    assert sorted(tuple(r) for r in data.judged.collect()) == [("q1", "d1", 2), ("q1", "d2", 0), ("q2", "d1", 3), ("q2", "d2", 1), ("q2", "d3", 0)]


def test_missing_text_is_an_error(spark, tmp_path):
    lines(tmp_path / "queries.jsonl", [{"_id": "q1"}])
    with pytest.raises(Exception, match="lacks _id or text"):
        beir.read_queries(spark, str(tmp_path / "queries.jsonl")).collect()


def test_msmarco(spark, folder):
    data = beir.load_msmarco(spark, str(folder))
    assert sorted(r["qid"] for r in data.queries.collect()) == ["q1", "q2"]
    assert data.corpus.count() == 4 and data.judged.count() == 2
    assert beir.load_msmarco(spark, str(folder), max_queries=1).queries.collect()[0]["qid"] == "q1"
    assert beir.load_msmarco(spark, str(folder), extra=0).corpus.count() == 2


def test_headerless_judgments(spark, tmp_path):
    lines(tmp_path / "a.tsv", ["q1\td1\t1", "q2\td2\t1"])
    assert beir.read_judgments(spark, str(tmp_path / "a.tsv"), header="named").count() == 2
    assert beir.read_judgments(spark, str(tmp_path / "a.tsv")).count() == 1
    # ids may begin like a header
    lines(tmp_path / "b.tsv", ["query-id\tcorpus-id\tscore", "query1\td1\t1", "query2\td2\t1"])
    assert beir.read_judgments(spark, str(tmp_path / "b.tsv"), header="named").count() == 2
    lines(tmp_path / "c.tsv", ["q1\td1\t1", "query2\td2\t1"])
    assert beir.read_judgments(spark, str(tmp_path / "c.tsv"), header="named").count() == 2


FIELDS = {"source_url": "u", "sha256": "s", "download_date": "0s since epoch", "file_size_bytes": 3}


def test_model_cache(spark, tmp_path):
    assert registry.cached_models(spark, str(tmp_path)).count() == 0
    for model in ("org/a", "org/b"):
        place = tmp_path / names.cache_folder(model) / "snapshots" / "r1"
        registry.write_metadata(spark, str(place), model_id=model, precision="INT8", **FIELDS)
    bad = tmp_path / "models--bad" / "snapshots" / "r1"
    bad.mkdir(parents=True)
    (bad / "cache.json").write_text("{not json")
    (tmp_path / "other").mkdir()
    found = registry.cached_models(spark, str(tmp_path)).orderBy("model_id").collect()
    assert [r["model_id"] for r in found] == ["org/a", "org/b"] and found[0]["platt_a"] is None

    with pytest.raises(errors.CacheError, match="snapshots"):
        names.snapshot(tmp_path, "org/none")
    (tmp_path / "models--empty" / "snapshots").mkdir(parents=True)
    with pytest.raises(errors.CacheError, match="no snapshot"):
        names.snapshot(tmp_path, "empty")
    with pytest.raises(errors.CacheError, match="lacks"):
        names.load_model(tmp_path, "org/a", Device("cpu"))

    snap = names.snapshot(tmp_path, "org/a")
    (snap / "onnx").mkdir()
    for name in ("model.onnx", "model_O2.onnx"):
        (snap / "onnx" / name).write_text("x")
    (snap / "tokenizer.json").write_text("{}")
    assert names.load_model(tmp_path, "org/a", Device("cpu"))[0].name == "model_O2.onnx"
    assert names.load_model(tmp_path, "org/a", Device("cuda"))[0].name == "model.onnx"
    assert registry.folder_size(spark, str(snap / "onnx")) == 2

    registry.delete_model(spark, str(tmp_path), "org/a")
    assert registry.cached_models(spark, str(tmp_path)).count() == 1
    with pytest.raises(errors.CacheError):
        registry.delete_model(spark, str(tmp_path), "org/a")


def test_workload(spark):
    q, d = registry.workload(spark, 3, 10)
    assert q.count() == 3 and d.count() == 10 and d.where("text like 'document 4 %'").count() == 1
