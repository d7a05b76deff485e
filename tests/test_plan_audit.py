"""Scale guard over every registered query, every job it runs: no unbounded single task and no cross join."""

import pytest

from carepath.plans.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.plan_audit import audit, unbounded_single_tasks


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_unbounded_single_task(spark, name):
    assert audit(spark, QUERIES[name], SF_SMALL) == []


def test_full_ranking_of_terms_has_no_single_task(spark):
    """All terms, and a cut above the threshold of Spark's window limit."""
    from carepath.operators import risk as rk
    from tests.plan_audit import recorded_plans

    rows = spark.range(5000).selectExpr("id as hadm_id", "'train' as split", "cast(id % 900 as string) as code")
    for k in (None, 5000):
        with recorded_plans() as plans:
            got = rk.doc_freq_vocab(rows, k)
            plans.append(got._jdf.queryExecution().executedPlan().toString())
        assert [x for p in plans for x in unbounded_single_tasks(p)] == []
        assert got.count() == 900


def test_the_audit_sees_a_single_task(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert unbounded_single_tasks(df._jdf.queryExecution().executedPlan().toString())
