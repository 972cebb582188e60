import pytest
from pyspark.sql import functions as F

from sievework.functions import urls, versions
from sievework.plans import registry

from oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, name):
    same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_dedup_key(spark):
    cases = {
        "HTTP://Example.com:80/en/a/index.html?b=2&utm_source=x&a=1#f": "http://example.com/a/?a=1&b=2".replace("/?", "?"),
        "https://u:p@example.com:8443/": "https://example.com:8443/",
        "https://example.com/en": "https://example.com/en",
        "https://example.com?b=1&b=0&a": "https://example.com/?a=&b=1&b=0",
        "no url": None,
        None: None,
    }
    df = spark.createDataFrame([(u, k) for u, k in cases.items()], "u string, k string")
    assert df.withColumn("got", urls.dedup_key(F.col("u"))).filter("not (got <=> k)").collect() == []


def test_ranges_have_three_outcomes(spark):
    cases = [
        ("3.0", "<2, junk", False), ("3.0", "junk, <2", None), ("3.0", ">=2, <4", True), ("1.x.3", "=1.3", True), ("1.0", "1.0", True),
        ("1.0", "1.0, 1.0", None), ("1.0-rc.1", "<1.0", True), ("x", ">1", None), ("1.0", None, None), ("1.0", "", None),
    ]
    df = spark.createDataFrame(cases, "v string, s string, want boolean")
    assert df.withColumn("got", versions.in_range(F.col("v"), F.col("s"))).filter("not (got <=> want)").collect() == []


def test_versions_in_order(spark):
    names = ["1.0-rc.10", "1.0-rc.2", "1.0", "1.0.1", "1.2", "1.10", "2"]
    df = spark.createDataFrame([(a, b, (i > j) - (i < j)) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, want int")
    assert df.filter(~versions.compare(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).collect() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
