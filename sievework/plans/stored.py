"""Queries over stored responses that are asked about again, with their DuckDB SQL.

Pages become responses: four in a row answer for one key, with headers made from their addresses and lengths. The
SQL has the values of the headers from where they come from, without reading headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import storing
from sievework.session import table

_FROM = 1_700_000_000
NOW = _FROM + 1200
#: SQL of both engines: key, times and status of a page as a response, and the values that its headers hold.
_KEY = "CAST(floor(page_id / 4) AS bigint)"
_TS = f"{_FROM} + (page_id * 7919) % 1000"
_STORED_AT = f"{_FROM} + page_id % 500"
_STATUS = "CASE page_id % 5 WHEN 0 THEN 200 WHEN 3 THEN 203 WHEN 4 THEN 503 ELSE 304 END"
_TYPE = "CASE WHEN page_id % 11 = 0 THEN 'Image/png; x' ELSE 'text/html' END"
_AGE = "CASE page_id % 6 WHEN 0 THEN length(html) WHEN 1 THEN 5 WHEN 3 THEN length(url) * 20 END"
_CONTROL = "CASE page_id % 6 WHEN 0 THEN concat('Max-Age=', length(html)) WHEN 1 THEN 'private, max-age=5' WHEN 2 THEN 'no-cache' WHEN 3 THEN concat('max-age=1, s-maxage=\"', length(url) * 20, '\"') WHEN 4 THEN 'max-age=soon' END"
_ETAG = "CASE WHEN page_id % 3 = 0 THEN md5(url) END"
_DAY = "CASE WHEN page_id % 4 = 1 THEN 10 + page_id % 9 END"
_EXPIRES = f"concat('Tue, ', CAST({_DAY} AS string), ' Nov 2023 10:00:00 ', CASE WHEN page_id % 8 = 1 THEN 'GMT' ELSE 'EST' END)"
_VARY = "CASE WHEN page_id % 13 = 0 THEN 'Accept, Cookie' WHEN page_id % 7 = 0 THEN 'Accept' END"
_PLACED = "page_id % 4 = 0 AND floor(page_id / 4) % 3 > 0"


def _pages(spark, sf_dir):
    headers = f"map_filter(map('cache-control', {_CONTROL}, 'etag', {_ETAG}, 'expires', CASE WHEN {_DAY} IS NOT NULL THEN {_EXPIRES} END, 'vary', {_VARY}), (k, v) -> v IS NOT NULL)"
    return table(spark, sf_dir, "pages").selectExpr(f"{_KEY} AS key", "page_id AS answer_id", f"{_TS} AS ts", f"{_STORED_AT} AS stored_at", f"{_PLACED} AS placed", f"{_STATUS} AS status", f"{_TYPE} AS content_type", f"{headers} AS headers", "md5(html) AS body_id", "html AS body")


def _store(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumns({"ts": F.timestamp_seconds("ts"), "stored_at": F.timestamp_seconds("stored_at")})
    stored = pages.filter("placed").select("key", "body_id", F.col("stored_at").alias("fetched_at"), storing.freshness(F.col("headers")).alias("fresh"))
    return pages, stored, storing.revalidated(stored, pages)


def revalidated_pages(spark, sf_dir):
    f = F.col("fresh")
    now = storing.is_fresh(f, F.col("fetched_at"), F.timestamp_seconds(F.lit(NOW)))
    out = _store(spark, sf_dir)[2].select("key", "status", "body_id", F.unix_seconds("fetched_at").alias("fetched_at"), f["max_age"].alias("max_age"), F.unix_seconds(f["expires"]).cast("string").alias("expires"), f["no_cache"].alias("no_cache"), f["private"].alias("private"), f["vary"].alias("vary"), f["etag"].alias("etag"), now.alias("is_fresh"))
    return out


def bodies_to_write(spark, sf_dir):
    pages, stored, entries = _store(spark, sf_dir)
    return storing.new_bodies(stored, pages, entries).select("body_id", F.length("body").alias("n_chars"))


QUERIES = {"revalidated_pages": revalidated_pages, "bodies_to_write": bodies_to_write}

_AFTER = f"""p AS (SELECT {_KEY} AS key, page_id AS n, {_TS} AS ts, {_STATUS} AS status, {_TYPE} AS ctype, {_AGE} AS age, {_CONTROL} AS control, {_ETAG} AS etag, {_VARY} AS vary, md5(html) AS body_id, {_STORED_AT} AS stored_at, {_PLACED} AS placed,
  CASE WHEN {_DAY} IS NOT NULL AND {_AGE} IS NULL THEN epoch(make_timestamp(2023, 11, {_DAY}, 10, 0, 0.0))::BIGINT + CASE WHEN page_id % 8 = 1 THEN 0 ELSE 18000 END END AS expires FROM pages),
full_ AS (SELECT key, ts AS at_, 1 AS new, n, * EXCLUDE (key, ts, n) FROM p WHERE status IN (200, 203) AND ctype = 'text/html' AND coalesce(vary, '') <> 'Accept, Cookie' AND coalesce(control, '') NOT LIKE 'private%'
  UNION ALL SELECT key, stored_at, 0, n, * EXCLUDE (key, ts, n) FROM p WHERE placed),
b AS (SELECT *, bool_or(new = 0) OVER (PARTITION BY key) AS known FROM full_ QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_ DESC, new DESC, n DESC) = 1),
l AS (SELECT p.*, row(p.ts, p.n) AS o FROM p JOIN b ON b.key = p.key AND p.status = 304 AND (p.ts > b.at_ OR p.ts = b.at_ AND (b.new = 0 OR p.n > b.n))),
g AS (SELECT key, max(ts) AS renewed, arg_max(control, o) FILTER (WHERE control IS NOT NULL) AS control, arg_max(coalesce(age, -1), o) FILTER (WHERE control IS NOT NULL) AS age, arg_max(expires, o) FILTER (WHERE expires IS NOT NULL) AS expires,
  arg_max(vary, o) FILTER (WHERE vary IS NOT NULL) AS vary, arg_max(etag, o) FILTER (WHERE etag IS NOT NULL) AS etag FROM l GROUP BY key),
e AS (SELECT b.key, b.body_id, CASE WHEN g.key IS NOT NULL THEN 'revalidated' WHEN new = 0 THEN 'stored' WHEN known THEN 'replaced' ELSE 'added' END AS status, coalesce(renewed, at_) AS fetched_at, CASE WHEN g.control IS NULL THEN b.age ELSE nullif(g.age, -1) END AS max_age, coalesce(g.expires, b.expires) AS expires,
  coalesce(coalesce(g.control, b.control) = 'no-cache', false) AS no_cache, coalesce(coalesce(g.control, b.control) LIKE 'private%', false) AS private, coalesce(g.vary, b.vary) AS vary, coalesce(g.etag, b.etag) AS etag FROM b LEFT JOIN g USING (key))"""
ORACLES = {
    "revalidated_pages": f"WITH {_AFTER} SELECT * REPLACE (expires::VARCHAR AS expires), NOT no_cache AND coalesce(CASE WHEN max_age IS NOT NULL THEN {NOW} - fetched_at < max_age ELSE {NOW} < e.expires END, false) AS is_fresh FROM e",
    "bodies_to_write": f"WITH {_AFTER} SELECT DISTINCT e.body_id, length(html) AS n_chars FROM e JOIN pages ON md5(html) = e.body_id WHERE e.body_id NOT IN (SELECT body_id FROM p WHERE placed)",
}
