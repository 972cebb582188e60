"""The registered unlike_passages judges every passage, as its SQL does, also past 256 in a query."""

from pyspark.sql import types as T

from sievework.plans import selecting

from oracle import same


def test_passages_past_the_bound_are_judged(spark, tmp_path):
    rows = [(40 * k, 0, "user", f"same words said over and over again here {k % 3}") for k in range(300)]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query, sql = selecting.QUERIES["unlike_passages"], selecting.ORACLES["unlike_passages"]
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == 300 and not any(r.kept for r in got if r.pos >= 40 * 256 * 1000)
    same(spark, str(tmp_path), query, sql)
