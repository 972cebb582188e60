"""The spelling licence, and long names behind long phrases."""

from sievework.llm import license_scan


def test_spelling_and_long_context(spark):
    cases = {
        "European Union Public Licence 1.2": ("eupl-1.2", 0, 5, 0.95),
        "The licence is the European Union Public License v 1.2": ("eupl-1.2", 4, 10, 0.95),
        "distributed under the terms of the University of Illinois/NCSA Open Source License": ("ncsa", 0, 12, 0.93),
        "Released under the terms of the Do What The Fuck You Want To Public License": ("wtfpl", 0, 14, 0.98),
        "Licensed under the MIT Licence": ("mit", 0, 4, 0.93),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    for r in license_scan.scan(df).collect():
        label, first, last, score = cases[r.text]
        assert [(d["label"], d["first"], d["last"]) for d in r.detections] == [(label, first, last)], r
        assert abs(r.score - score) < 1e-9
