"""Rows of cases are dealt over tasks before they are judged, also where their table is one small file."""

from sievework.plans import asking, cases

from oracle import same


def test_dealt_before_judged(spark):
    d = "/root/testdata/sf0.001"
    given = cases.given(spark, d, "part", "p_partkey", cases.columns("v s", asking._RANGES))
    assert "REPARTITION_BY_COL" in given._jdf.queryExecution().optimizedPlan().toString() or "Exchange hashpartitioning(p_partkey" in given._jdf.queryExecution().executedPlan().toString()
    same(spark, d, asking.QUERIES["range_cases"], asking.ORACLES["range_cases"])
