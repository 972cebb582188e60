"""Ties, repeats, very long texts and clashing columns where the other tests have none."""

from sievework.llm import decontaminate, mixing, spotsigs, suffix_dedup, url_filter


def test_spotsigs_ties_and_long_texts(spark):
    long = "the quick fox of the lazy dog " * 20_000
    rows = [(1, "b the cat sat down"), (1, "a the cat sat down"), (2, long), (2, long), (None, "the end of it all"), (3, None)]
    docs = spark.createDataFrame([(*r, "old", "x") for r in rows], "doc_id long, text string, Fingerprint string, next_text string")
    out = spotsigs.with_next(docs).collect()
    assert len(out) == len(rows)
    texts = {(r.doc_id, r.text): r.next_text for r in out}
    assert texts[(None, rows[4][1])] in (rows[0][1], rows[1][1]) and texts[(3, "")] == rows[4][1]
    first = texts[(None, rows[4][1])]
    second = ({rows[0][1], rows[1][1]} - {first}).pop()
    assert texts[(1, first)] == second and texts[(1, second)] == long
    assert sorted(r.next_text == long for r in out if r.text == long) == [False, True]
    prints = spotsigs.fingerprints(docs)
    assert [c for c in prints.columns if c.lower() == "fingerprint"] == ["fingerprint"]
    assert len({r.fingerprint for r in prints.filter("doc_id = 2").collect()}) == 1
    one = spotsigs.with_next(docs.filter("doc_id = 3")).collect()
    assert [(r.text, r.next_text) for r in one] == [("", "")]


def test_urls_repeated_and_long(spark):
    long = "http://a.example.org/es/" + "x" * 200_000
    urls = [long, long, "http://" + "a." * 5_000 + "com/fr/x", "http://example.org/en/1"]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, Host string, path int")
    rules = spark.createDataFrame([*url_filter.RULES, ("block", "COM", "/fr/x"), ("allow", "com", "/fr/"), ("allow", None, "/")], "verdict string, host string, path string")
    got = url_filter.judge(pages, rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.org/es/", "block")] * 2 + [("com/fr/x", "block"), ("example.org/en/1", "block")]
    assert len(got[0].path) == 200_004 and sorted(c.lower() for c in got[0].asDict()) == ["host", "page_id", "path", "rule", "url", "verdict"]


def test_columns_that_clash(spark):
    rows = [(1, "alpha beta " * 50, "s", "old", "old", "old"), (1, "alpha beta " * 50, "s", "old", "old", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, KEPT string, taken string, Contaminated string")
    assert [c.lower() for c in suffix_dedup.dedup(docs).columns].count("kept") == 1
    assert [c.lower() for c in mixing.Mix(docs).taken().columns].count("taken") == 1
    bench = spark.createDataFrame([(7, "alpha beta alpha", "x")], "item_id long, text string, n_words string")
    got = decontaminate.decontaminate(docs, bench)
    assert [c.lower() for c in got.columns].count("contaminated") == 1 and all(r.contaminated for r in got.collect())
