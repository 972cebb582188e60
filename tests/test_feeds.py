from pyspark.sql import functions as F

from sievework.sources import feeds

FEED = '<?xml version="1.0"?><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title type="html">Q</a:title>%s</a:feed>'
ENTRY = "<a:entry><a:id>http://arxiv.org/abs/2401.1v2</a:id><a:title> A &amp;\n <![CDATA[<b>]]></a:title><a:title>B</a:title><a:author><a:name> N </a:name></a:author><a:author/><a:updated>2024-01-03</a:updated></a:entry>"


def test_feeds_whole_and_broken(spark):
    bodies = {
        1: FEED % ENTRY, 2: FEED % "", 3: (FEED % ENTRY)[:-9], 4: FEED % "<a:entry><a:id>x</a:title></a:entry>", 5: "no feed", 6: None, 7: "", 8: FEED % f"<a:entry>{ENTRY}</a:entry>", 9: FEED % "<a:entry><a:id>1 & 2</a:id></a:entry>",
        10: FEED % (ENTRY * 40), 11: FEED % "<a:entry><a:id/><a:title>t</a:title></a:entry><a:entry><a:id>q</a:id><a:title> </a:title></a:entry><a:entry><a:id>q</a:id><a:title>t</a:title><a:summary>s</a:summary><a:updated>soon</a:updated></a:entry>",
    }
    df = spark.createDataFrame(list(bodies.items()), "query_id long, body string")
    got = {}
    for r in feeds.atom_hits(df).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(tuple(r)[1:])
    assert sorted(got) == [1, 10, 11] and len(got[10]) == 30
    assert got[1] == [(1, "A & <b>", "https://arxiv.org/abs/2401.1", None, "2024-01-03", "N")]
    assert got[11] == [(1, "t", "https://arxiv.org/abs/q", "s", None, "")]
    assert sorted(r.query_id for r in feeds.faults(df).collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert feeds.atom_hits(df.limit(0)).count() == 0


def test_addresses_of_articles(spark):
    cases = {"http://arxiv.org/abs/2401.00001v1": "2401.00001", " http://arxiv.org/abs/cs/9901001v2/ ": "cs/9901001", "2401.2": "2401.2", "v1": "v1", "1v": "1v", "1v2v3": "1v2v3", "": None, "http://arxiv.org/abs/": None, None: None, "a b/c": "a%20b/c", "x/": None}
    df = spark.createDataFrame([(k, v and feeds.ARTICLES + v) for k, v in cases.items()], "raw string, want string").withColumn("got", feeds.article_url(F.col("raw")))
    assert df.filter("NOT (got <=> want)").collect() == []


def test_a_body_is_parsed_once(spark):
    from sievework.plans import feeding

    plan = feeding.feed_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
