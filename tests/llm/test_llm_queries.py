"""The operators' queries against their SQL, and the pipeline's shape."""

import pytest
from support import SF, duck, same_rows

from rankloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same_rows(queries.queries()[name](spark, SF).toPandas(), duck().execute(queries.oracle_sql()[name]).df())


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()


def test_quality_rules_stay_in_the_jvm(spark):
    plan = queries.op3_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
