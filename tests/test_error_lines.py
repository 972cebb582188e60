"""The registered error_pieces gives the primary line whole, wherever it stands in its text."""

from sievework.plans import reading

from oracle import same


def test_digits_at_the_ends_of_a_line_stay(spark, tmp_path):
    texts = ["A wall of 19.37.233.111", "1 error in 21", "\n\n3 items 33", " 2 \n", None]
    rows = [(9 + 5 * k, t) for k, t in enumerate(texts)] + [(100 + k, "1 of 1\n2 of 2\n3 failed of 3") for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = reading.QUERIES["error_pieces"], reading.ORACLES["error_pieces"]
    got = {r.doc_id: r.primary_line for r in query(spark, str(tmp_path)).collect()}
    assert (got[9], got[14], got[19]) == ("A wall of 19.37.233.111", "1 error in 21", "3 items 33")
    same(spark, str(tmp_path), query, sql)
