"""Versions are judged once for each set of ranges, whatever packages and advisories have it."""

import re

from sievework.operators import advisories

RANGES = "array<struct<fixed: array<string>, last_affected: array<string>, spec: string>>"


def test_shared_sets_and_missing_versions(spark):
    low, listed, junk = ([], [], "<2"), ([], ["3"], None), (["1"], [], "junk")
    known = [(1, "npm", "a", [low]), (2, "npm", "b", [low]), (3, "npm", "a", [low, listed]), (4, "npm", "b", None), (5, "npm", "a", []), (6, "npm", "b", [junk]), (7, "pypi", "A_b", [listed])]
    found = [(10, "npm", "a", "1"), (11, "npm", "b", "1"), (12, "npm", "a", None), (13, "npm", "b", "3"), (14, "npm", "a", "3"), (15, "pypi", "a.B", "3"), (16, "npm", "none", "1"), (17, "npm", "a", "1")]
    out = advisories.applicable(
        spark.createDataFrame(found, "finding_id long, ecosystem string, name string, version string"),
        spark.createDataFrame(known, f"advisory_id long, ecosystem string, name string, ranges {RANGES}"),
        spark.createDataFrame([(1,), (1,)], "advisory_id long"),
    )
    got = sorted((r.finding_id, r.advisory_id, r.verdict[:3], r.confidence, r.known_exploited) for r in out.collect())
    assert got == [
        (10, 1, "aff", "high", True), (10, 3, "aff", "medium", False), (10, 5, "unk", "low", False),
        (11, 2, "aff", "high", False), (11, 4, "unk", "low", False), (11, 6, "not", "high", False),
        (12, 1, "unk", "high", True), (12, 3, "unk", "medium", False), (12, 5, "unk", "low", False),
        (13, 2, "not", "high", False), (13, 4, "unk", "low", False), (13, 6, "unk", "high", False),
        (14, 1, "not", "high", True), (14, 3, "aff", "medium", False), (14, 5, "unk", "low", False),
        (15, 7, "aff", "high", False),
        (17, 1, "aff", "high", True), (17, 3, "aff", "medium", False), (17, 5, "unk", "low", False),
    ]
    assert re.search(r"Aggregate \[version#\d+, set#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
