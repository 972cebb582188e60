"""Queries over evidence: kinds, links, ledgers, verdicts, slices and health, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import kinds, urls
from sievework.operators import evidence
from sievework.plans.retrieval import _key_sql
from sievework.session import table
from sievework.sources.derived import ATTEMPTS, HITS, attempts, hits
from sievework.streaming.health import health

_MADE = "CASE page_id % 6 WHEN 0 THEN 'https://docs.rs/x' WHEN 1 THEN 'https://pypi.org/p' WHEN 2 THEN 'https://osv.dev/v' WHEN 3 THEN 'https://x.org/CHANGELOG.md' WHEN 4 THEN 'https://learn.x.org/' ELSE url END"
_HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(u, '{urls.URL}', 2), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = f"regexp_extract(u, '{urls.URL}', 3)"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def source_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_MADE).alias("u")).select("page_id", kinds.source_kind(F.col("u")).alias("kind"))


def links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    sources = pages.filter("page_id % 3 != 0").selectExpr("page_id AS source_id", "url", "page_id % 17 AS place")
    listed = hits(spark, sf_dir).withColumn("page", F.regexp_extract("url", "/([0-9]+)", 1).cast("long"))
    fetches = listed.select(F.concat_ws("-", "query_id", "provider", "rank").alias("fetch_id"), F.when(F.col("rank") % 4 == 0, F.col("rank")).cast("long").alias("source_id"), "url")
    return evidence.linked(fetches, sources)


QUERIES = {
    "source_kinds": source_kinds,
    "fetch_links": links,
    "ledger_repeats": lambda spark, d: evidence.repeated(attempts(spark, d).withColumn("hour", F.date_trunc("hour", "ts")), ["provider", "hour"]),
    "range_verdicts": lambda spark, d: evidence.combined(
        table(spark, d, "lineitem").selectExpr("l_partkey AS part", "CASE WHEN l_quantity > 49 THEN 'affected' WHEN l_quantity > 47 THEN 'unknown' ELSE 'not_affected' END AS verdict"), "part"
    ),
    "recent_attempts": lambda spark, d: evidence.recent(attempts(spark, d), "ts", "2024-01-15", 7).groupBy("provider").count().withColumnRenamed("count", "n"),
    "line_slices": lambda spark, d: table(spark, d, "documents").select("doc_id", evidence.line_slice(F.col("text"), 2, 6, 300).alias("part")),
    "document_chunks": lambda spark, d: evidence.paragraphs(table(spark, d, "documents"), 1000),
    "provider_health": lambda spark, d: health(attempts(spark, d)),
}

ORACLES = {
    "source_kinds": f"""SELECT page_id, CASE WHEN h = '' THEN 'unknown' WHEN h IN {_in(kinds.DOCS)} OR regexp_matches(h, '[.]readthedocs[.](io|org)$') THEN 'docs'
  WHEN h IN {_in(kinds.REGISTRIES)} THEN 'registry' WHEN h IN {_in(kinds.ADVISORIES)} THEN 'advisory' WHEN regexp_matches(p, 'CHANGELOG|changelog|CHANGES') THEN 'release_notes'
  WHEN h IN {_in(kinds.TUTORIALS)} OR regexp_matches(h, 'tutorial|learn') THEN 'tutorial' WHEN h = 'discourse.org' OR regexp_matches(h, 'forum|[.]discourse[.]app$') THEN 'forum'
  WHEN h IN {_in(kinds.NEWS)} OR regexp_matches(h, 'news|blog') THEN 'news' ELSE 'unknown' END AS kind
FROM (SELECT page_id, {_HOST} AS h, {_PATH} AS p FROM (SELECT page_id, {_MADE} AS u FROM pages))""",
    "fetch_links": f"""WITH {HITS}, s AS (SELECT page_id AS source_id, {_key_sql("url")} AS key, page_id % 17 AS place FROM pages WHERE page_id % 3 <> 0),
f AS (SELECT query_id || '-' || provider || '-' || rank AS fetch_id, CASE WHEN rank % 4 = 0 THEN rank END AS sid, {_key_sql("url")} AS key FROM hits),
k AS (SELECT key, source_id AS by_key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, source_id) AS r FROM s) WHERE r = 1)
SELECT fetch_id, coalesce(s.source_id, by_key) AS source_id, CASE WHEN s.source_id IS NOT NULL THEN 'id' WHEN by_key IS NOT NULL THEN 'url' END AS link
FROM f LEFT JOIN s ON s.source_id = f.sid LEFT JOIN k ON k.key = f.key""",
    "ledger_repeats": f"WITH {ATTEMPTS} SELECT provider, date_trunc('hour', ts) AS hour, count(*) AS attempts FROM attempts GROUP BY ALL HAVING count(*) > 1",
    "range_verdicts": """SELECT l_partkey AS part, CASE WHEN max(l_quantity) > 49 THEN 'affected' WHEN max(l_quantity) > 47 THEN 'unknown' ELSE 'not_affected' END AS verdict, count(*) AS n_ranges
FROM lineitem GROUP BY l_partkey""",
    "recent_attempts": f"WITH {ATTEMPTS} SELECT provider, count(*) AS n FROM attempts WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY GROUP BY provider",
    "line_slices": """WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, range(2, 7) r(i) WHERE i <= len(string_split(text, chr(10)))),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS part FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id AND n <= 301 GROUP BY d.doc_id""",
    "document_chunks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, line, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE line <> '')
SELECT doc_id, CAST(floor(before / 1000) AS BIGINT) AS chunk, string_agg(line, chr(10) ORDER BY pos) AS text FROM c GROUP BY doc_id, floor(before / 1000)""",
    "provider_health": f"""WITH {ATTEMPTS} SELECT provider, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS attempts, count(*) FILTER (outcome = 'failed') AS failed, round(avg(duration_ms), 6) AS mean_ms
FROM attempts GROUP BY provider, time_bucket(INTERVAL 1 HOUR, ts)""",
}
