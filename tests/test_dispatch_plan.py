"""Requests are not dealt by provider, of which there are a handful."""

import re

from sievework.plans import weighing

from oracle import same


def test_no_shuffle_by_provider(spark):
    for name in ("dispatch_jobs", "routed_providers"):
        plan = weighing.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # supported itself, of five rows, is grouped by provider; no join or window on requests is.
        assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\(provider[^\n]*\n[^\n]*query_id", plan)
        same(spark, "/root/testdata/sf0.001", weighing.QUERIES[name], weighing.ORACLES[name])
