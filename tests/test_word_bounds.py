"""Words end at accented letters in the shapes of queries, as they do in the SQL."""

from sievework.plans import classify, reading

from oracle import same

TEXTS = [
    "du euxréeau 187.50.237.187 éré", "éE0308 TS2345é", "éCVE-2021-44228é CWE-79é", "ñlib/x.tsé a::bé ñc::d", "mot_é foo_baré", "ünumpy@1.20é", "plain words", None,
]


def test_accented_letters_are_no_word_characters(spark, tmp_path):
    rows = [(240 * k + p, t) for k, t in enumerate(TEXTS) for p in (15, 4)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.intent for r in classify.intents(spark, str(tmp_path)).collect()}
    assert got[15] == "code"
    for module, name in ((classify, "query_intents"), (classify, "identifiers_found"), (reading, "error_pieces")):
        same(spark, str(tmp_path), module.QUERIES[name], module.ORACLES[name])
