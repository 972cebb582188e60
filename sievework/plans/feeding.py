"""Queries over recorded feeds, with their DuckDB SQL. Each document is a feed; its lines are the titles of entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.sources import feeds
from sievework.session import table

#: SQL of both engines: parts of entry i (from 0) with line x of a document's text.
_ID = "CASE i % 5 WHEN 0 THEN concat('http://arxiv.org/abs/24', lpad(CAST(i AS string), 2, '0'), '.', doc_id, 'v', i) WHEN 1 THEN concat('http://arxiv.org/abs/cs/', doc_id, 'v12') WHEN 2 THEN concat('a b/', doc_id) WHEN 3 THEN 'http://arxiv.org/abs/' ELSE concat('v', doc_id, 'v') END"
_URL = "CASE i % 5 WHEN 0 THEN concat('https://arxiv.org/abs/24', lpad(CAST(i AS string), 2, '0'), '.', doc_id) WHEN 1 THEN concat('https://arxiv.org/abs/cs/', doc_id) WHEN 2 THEN concat('https://arxiv.org/abs/a%20b/', doc_id) WHEN 4 THEN concat('https://arxiv.org/abs/v', doc_id, 'v') END"
_DAY = "concat('2024-0', 1 + i % 9, '-1', doc_id % 10)"
BROKEN = "doc_id % 9 = 8"


def bodies(spark, sf_dir):
    """One feed for each document: its lines as titles, twice as summaries, with one author or two; each
    ninth feed is cut short, nested or no XML."""
    xml = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    date = F.when(F.expr("i % 2 = 0"), F.concat(tag("updated", F.lit("2030-01-01")), tag("published", F.concat(F.expr(_DAY), F.lit("T01:02:03Z"))))).otherwise(tag("updated", F.expr(_DAY)))
    names = F.concat(tag("author", tag("name", F.expr("concat(' N', i)"))), F.when(F.expr("i % 3 = 0"), tag("author", F.concat(tag("name", F.lit("M. O")), F.lit("<x/>")))).otherwise(""))
    entry = tag("entry", F.concat(tag("id", F.expr(_ID)), tag("title", F.lit(" ")), F.lit('<title type="html">\n '), xml("x"), F.lit("</title>"), tag("summary", F.concat(xml("x"), F.lit("\n  "), xml("x"))), date, names))
    feed = line.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", entry.alias("e")))), lambda s: s["e"]), "\n").alias("entries"))
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>'), F.col("entries"), F.lit("</feed>"))
    broken = F.when(F.expr("doc_id % 27 = 8"), F.expr("left(body, length(body) - 3)")).when(F.expr("doc_id % 27 = 17"), F.replace(F.col("body"), F.lit("</feed>"), F.lit("<entry><entry><id>1</id></entry></entry></feed>"))).otherwise(F.lit("no feed"))
    return feed.select("doc_id", whole.alias("body")).select(F.col("doc_id").alias("query_id"), F.when(F.expr(BROKEN), broken).otherwise(F.col("body")).alias("body"))


def feed_hits(spark, sf_dir):
    return feeds.atom_hits(bodies(spark, sf_dir)).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


def feed_faults(spark, sf_dir):
    return feeds.faults(bodies(spark, sf_dir))


QUERIES = {"feed_hits": feed_hits, "feed_faults": feed_faults}
_FOLD = r"trim(regexp_replace(regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g'))"
ORACLES = {
    "feed_hits": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND NOT {BROKEN}),
e AS (SELECT doc_id, i, {_URL} AS url, {_FOLD.format('x')} AS title, {_FOLD.format("x || ' ' || x")} AS said, {_DAY} || CASE WHEN i % 2 = 0 THEN ' 01:02:03' ELSE ' 00:00:00' END AS published_at, concat('N', i, CASE WHEN i % 3 = 0 THEN ', M. O' ELSE '' END) AS authors FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM e WHERE url IS NOT NULL AND title <> '')
SELECT doc_id AS query_id, CAST(rank AS INT) AS rank, title, url, CASE WHEN length(said) <= {feeds.SNIPPET} THEN said ELSE regexp_replace(left(said, {feeds.SNIPPET}), '\\s+\\S*$', '') || '…' END AS snippet, published_at, authors FROM r WHERE rank <= 30""",
    "feed_faults": f"SELECT doc_id AS query_id FROM documents WHERE text IS NOT NULL AND {BROKEN}",
}
