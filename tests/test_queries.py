"""Every query of the engine against its SQL."""

import pytest
from support import SF, duck, same_rows

from rankloom.plans import queries, surfaces  # noqa: F401  the second adds its queries to the first


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["qid", "idx", "score", "rank"]
    assert frame.count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), duck().execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize(("name", "unit"), [("cosine_topk", 1), ("maxsim", 8)])
def test_vector_searches_ask_with_every_twentieth(spark, name, unit):
    asked = {r["qid"] for r in queries.QUERIES[name](spark, SF).select("qid").distinct().collect()}
    owners = {r["vec_id"] // unit for r in queries.table(spark, SF, "embeddings").collect()}
    assert asked == {i for i in owners if i % 20 == 0} and len(asked) > 1


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = queries.rerank_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_needed_columns(spark):
    plan = queries.sigmoid_calibrate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_pairs_are_cut_where_they_are_made(spark):
    """Nothing is shuffled between scoring and the cut to the best of each query."""
    plan = queries.rerank_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("WindowGroupLimit", plan.index("Exchange"))
    assert "Exchange" not in plan[at : plan.index("MapInArrow", at)]


def test_joined_paths_give_the_same(spark, monkeypatch):
    from rankloom.operators import retrieval

    q, docs = queries.bm25_inputs(spark, SF)
    held = [retrieval.overlaps(q, docs).toPandas(), retrieval.Bm25(docs).search(q, 5).toPandas()]
    monkeypatch.setattr(retrieval, "is_small", lambda _: False)
    same_rows(retrieval.overlaps(q, docs).toPandas(), held[0])
    same_rows(retrieval.Bm25(docs).search(q, 5).toPandas(), held[1])


def test_no_cross_join_in_negatives(spark):
    plan = queries.negatives_sampled(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
