"""The stages one by one against brute force, and as a whole."""

import duckdb
from llm_support import DOCUMENT, with_clashes
from support import SF

import corpus_pipeline
from rankloom.llm import queries, toxicity
from rankloom.llm.common import forget, materialised, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_run_gives_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert sorted(r["doc_id"] for r in pieces.select("doc_id").distinct().collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_survive(spark):
    docs = with_clashes(spark.read.parquet(f"{SF}/documents.parquet").limit(60))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert "n_lines" in docs.columns and docs.select("ranges").distinct().count() == 1


def test_forget(spark):
    forget(spark)
    assert shared_dir(spark) == shared_dir(spark)


def duck_over(docs):
    """DuckDB with ``docs`` as its documents."""
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents_frame", frame)
    con.execute("create view documents as select * from documents_frame")
    return con


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_each_stage_against_sql_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    scores = toxicity.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    docs, given = materialised(stages["toxicity"](spark, docs, SF), "t"), docs
    assert ids(docs) == ids(scores.where("predicted = 0")) and len(ids(given)) > len(ids(docs))

    want = duck_over(docs).execute(queries.OP3_SQL).df()
    docs = materialised(stages["quality_rules"](spark, docs, SF), "q")
    assert ids(docs) == sorted(want[want.kept].doc_id)

    want = duck_over(docs).execute(queries.OP7_SQL).df()
    want = want[(want.n_deleted == 0) | (want.n_deleted < want.n_lines)]
    docs = materialised(stages["line_dedup"](spark, docs, SF), "l")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == dict(zip(want.doc_id, want.text, strict=True))

    want = duck_over(docs).execute(queries.OP2_SQL).df()
    docs = materialised(stages["ngram_join"](spark, docs, SF), "n")
    assert ids(docs) == sorted(want[want.doc_id == want.class_id].doc_id)

    pieces = stages["packing"](spark, docs, SF).toPandas()
    assert sorted(set(pieces.doc_id)) == ids(docs)
    ends = pieces.sort_values(["sequence_id", "offset"])
    assert (ends.offset == ends.groupby("sequence_id").length.cumsum() - ends.length).all()
    assert ends.groupby("sequence_id").length.sum().max() <= 2048
    assert ends.sequence_id.nunique() <= -(-ends.length.sum() // 2048) + 1
