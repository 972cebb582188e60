"""Queries over fusion, metrics, text and versions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text, urls, versions
from sievework.operators import fusion, measures
from sievework.session import table
from sievework.sources.derived import ATTEMPTS, HITS, attempts, hits

_tracking = ", ".join(f"'{x}'" for x in urls.TRACKING)
_locales = "|".join(x.replace("-", "[-_]") for x in urls.LOCALES)


def _key_sql(url: str) -> str:
    x = lambda k: f"regexp_extract({url}, '{urls.URL}', {k})"
    host = f"regexp_replace(regexp_replace({x(2)}, '^.*@', ''), ':[0-9]*$', '')"
    path = f"regexp_replace(regexp_replace(regexp_replace({x(3)}, '(?i)^/({_locales})/', '/'), '(index[.]html|index[.]htm|index[.]php)$', ''), '/+$', '')"
    pairs = f"list_filter(string_split({x(4)}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({_tracking}))"
    query = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})), lambda s: s.p), '&')"
    return f"""CASE WHEN regexp_matches({url}, '{urls.URL}') THEN lower({x(1)}) || '://' || lower({host})
      || CASE WHEN regexp_extract({x(2)}, ':([0-9]+)$', 1) IN ('', CASE lower({x(1)}) WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END) THEN '' ELSE ':' || regexp_extract({x(2)}, ':([0-9]+)$', 1) END
      || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"""


FUSED = f"""{HITS},
keyed AS (SELECT *, {_key_sql("url")} AS key FROM hits),
fused AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, arg_min(url, provider || lpad(rank::VARCHAR, 12, '0')) AS url,
                 arg_min(title, provider || lpad(rank::VARCHAR, 12, '0')) AS title, count(DISTINCT provider) AS n_providers
          FROM keyed WHERE key IS NOT NULL GROUP BY query_id, key)"""
TOP = f"""{FUSED},
kept AS (SELECT * FROM fused WHERE NOT regexp_matches(url, '^[a-z]+://([^/?#]*[.])?m[.]') AND
         (regexp_matches(url, '^[a-z]+://([^/?#]+[.])?(example[.]com|example[.]org)([:/?#]|$)'))),
boosted AS (SELECT * REPLACE (round(score + 0.1::DOUBLE * max(score) OVER (PARTITION BY query_id) * CASE WHEN contains(url, '/en/') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END, 12) AS score) FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, url) AS place FROM boosted)"""


def fused_top(spark, sf_dir, n=10):
    rows = fusion.in_domains(fusion.fuse(hits(spark, sf_dir)), include=["example.com", "example.org"])
    rows = rows.filter(~F.col("url").rlike(r"^[a-z]+://([^/?#]*[.])?m[.]"))
    return fusion.top(fusion.boosted(rows, [("contains(url, '/en/')", 2.0)]), n)


def fused_top10(spark, sf_dir):
    return fused_top(spark, sf_dir).select("query_id", "place", "key", "url", "title", "score", "n_providers")


def retrieval_metrics(spark, sf_dir):
    """Judged by arithmetic: a key's grade is its length modulo 4, less one."""
    fused = fusion.fuse(hits(spark, sf_dir))
    judged = fused.select("query_id", "key", (F.length("key") % 4 - 1).alias("grade"))
    return measures.metrics(fusion.top(fused, 10).select("query_id", "key", "place"), judged)


def versions_of(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat(p_size, '.', p_partkey % 7, CASE WHEN p_partkey % 3 = 0 THEN concat('.x.', p_partkey % 5) ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN concat('-rc.', p_partkey % 13) ELSE '' END) AS version",
        "CASE p_partkey % 4 WHEN 0 THEN '>=10, <30.5' WHEN 1 THEN '<20, junk' WHEN 2 THEN 'junk, <20' ELSE '!=7.3' END AS spec",
    )
    v = F.col("version")
    return part.select("p_partkey", "version", "spec", versions.compare(v, F.lit("25.3")).alias("order"), versions.in_range(v, F.col("spec")).alias("in_range"))


_nums = "list_filter(string_split(split_part({v}, '-', 1), '.'), lambda s: regexp_matches(s, '^[0-9]{{1,18}}$'))"


def _vkey(v: str) -> str:
    nums = _nums.format(v=v)
    tag = f"regexp_extract({v}, '^[^-]*-(.*)$', 1)"
    return f"{{'n': list_resize(list_transform({nums}, lambda s: s::BIGINT), 6, 0::BIGINT), 'r': CASE WHEN {tag} = '' THEN 1 ELSE 0 END, 't': {tag}}}"


VERSIONS = f"""
WITH p AS (SELECT p_partkey, p_size || '.' || p_partkey % 7 || CASE WHEN p_partkey % 3 = 0 THEN '.x.' || p_partkey % 5 ELSE '' END
                  || CASE WHEN p_partkey % 11 = 0 THEN '-rc.' || p_partkey % 13 ELSE '' END AS version,
           CASE p_partkey % 4 WHEN 0 THEN '>=10, <30.5' WHEN 1 THEN '<20, junk' WHEN 2 THEN 'junk, <20' ELSE '!=7.3' END AS spec FROM part),
k AS (SELECT *, {_vkey("version")} AS v, {_vkey("'25.3'")} AS c, {_vkey("'10'")} AS a, {_vkey("'30.5'")} AS b, {_vkey("'20'")} AS d, {_vkey("'7.3'")} AS e FROM p)
SELECT p_partkey, version, spec, CASE WHEN v < c THEN -1 WHEN v = c THEN 0 ELSE 1 END AS "order",
       CASE p_partkey % 4 WHEN 0 THEN v >= a AND v < b WHEN 1 THEN CASE WHEN v < d THEN NULL ELSE false END WHEN 2 THEN NULL ELSE v <> e END AS in_range
FROM k"""


def clean_turns(spark, sf_dir):
    """Marks are put in by arithmetic, as the table has none."""
    put = F.concat(F.substring("text", 1, 3), F.lit("\u200b\u202e"), F.expr("substr(text, 4)"), F.lit("\u2028x"))
    t = table(spark, sf_dir, "conversations").withColumn("dirty", F.when(F.col("turn") % 5 == 0, put).otherwise(F.col("text")))
    clean = text.visible(F.col("dirty"))
    return t.select("conv_id", "turn", text.n_removed(F.col("dirty")).alias("n_removed"), text.bounded(text.one_line(clean), 200).alias("line"), F.size(text.tokens(clean)).alias("n_tokens"))


CLEAN = """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN substr(text, 1, 3) || chr(8203) || chr(8238) || substr(text, 4) || chr(8232) || 'x' ELSE text END AS dirty FROM conversations),
c AS (SELECT *, replace(replace(replace(dirty, chr(8232), ' '), chr(8203), ''), chr(8238), '') AS clean FROM t),
l AS (SELECT *, trim(regexp_replace(clean, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS one FROM c)
SELECT conv_id, turn, length(dirty) - length(replace(replace(dirty, chr(8203), ''), chr(8238), '')) AS n_removed,
       CASE WHEN length(one) <= 200 THEN one ELSE substr(one, 1, 199) || '…' END AS line,
       len(regexp_extract_all(clean, '[\\p{L}\\p{N}]+')) AS n_tokens
FROM l"""


def package_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'nuget' ELSE 'npm' END AS ecosystem", "concat('Pkg__', p_partkey % 50, '.-Name') AS name")
    return p.select("p_partkey", "ecosystem", text.package_name(F.col("ecosystem"), F.col("name")).alias("canonical"))


QUERIES = {
    "fused_top10": fused_top10,
    "url_dedup_key": lambda spark, d: table(spark, d, "pages").select("page_id", urls.dedup_key(F.col("url")).alias("key"), urls.host(F.col("url")).alias("host")),
    "rank_fusion": lambda spark, d: fusion.fuse(hits(spark, d)),
    "rank_unfused": lambda spark, d: fusion.unfused(hits(spark, d)),
    "domain_filter": lambda spark, d: fusion.in_domains(hits(spark, d), exclude=["example.net"]).select("query_id", "provider", "rank", "url"),
    "provider_summary": lambda spark, d: hits(spark, d).groupBy("provider").agg(F.count("*").alias("n_hits"), F.count_distinct("query_id").alias("n_queries")),
    "retrieval_metrics": retrieval_metrics,
    "attempt_counts": lambda spark, d: measures.attempt_counts(attempts(spark, d)),
    "version_ranges": versions_of,
    "clean_turns": clean_turns,
    "package_names": package_names,
}

_z = 1.959963984540054
ORACLES = {
    "fused_top10": f"WITH {TOP} SELECT query_id, place, key, url, title, score, n_providers FROM ranked WHERE place <= 10",
    "url_dedup_key": f"SELECT page_id, {_key_sql('url')} AS key, lower(regexp_replace(regexp_replace(regexp_extract(url, '{urls.URL}', 2), '^.*@', ''), ':[0-9]*$', '')) AS host FROM pages",
    "rank_fusion": f"WITH {FUSED} SELECT query_id, key, score, url, title, n_providers FROM fused",
    "rank_unfused": f"WITH {HITS} SELECT query_id, provider, rank, url, round(1.0::DOUBLE / (60 + rank), 12) AS score FROM hits",
    "domain_filter": f"WITH {HITS} SELECT query_id, provider, rank, url FROM hits WHERE NOT regexp_matches(url, '^[a-z]+://([^/?#]+[.])?example[.]net([:/?#]|$)')",
    "provider_summary": f"WITH {HITS} SELECT provider, count(*) AS n_hits, count(DISTINCT query_id) AS n_queries FROM hits GROUP BY provider",
    "retrieval_metrics": f"""WITH {FUSED}, judged AS (SELECT query_id, key, length(key) % 4 - 1 AS grade FROM fused),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, url) AS place FROM fused),
f AS (SELECT query_id, count(*) FILTER (grade > 0) AS hits, min(place) FILTER (grade > 0) AS first, sum((pow(2.0::DOUBLE, grade) - 1) / log2(place + 1.0::DOUBLE)) AS dcg
      FROM r JOIN judged USING (query_id, key) WHERE place <= 5 GROUP BY query_id),
i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN place <= 5 THEN (pow(2.0::DOUBLE, grade) - 1) / log2(place + 1.0::DOUBLE) ELSE 0 END) AS ideal
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM judged WHERE grade > 0) GROUP BY query_id)
SELECT query_id, round(hits / 5, 9) AS precision, round(hits / least(relevant, 5), 9) AS recall, round(coalesce(1 / first, 0), 9) AS mrr, round(dcg / ideal, 9) AS ndcg FROM f JOIN i USING (query_id)""",
    "attempt_counts": f"""WITH {ATTEMPTS}, c AS (SELECT provider, count(*) AS attempts, count(*) FILTER (outcome = 'success') AS succeeded,
  count(*) FILTER (outcome = 'zero_results') AS zero_results, count(*) FILTER (outcome = 'failed') AS failed, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM attempts GROUP BY provider),
w AS (SELECT *, attempts::DOUBLE AS n, (succeeded + zero_results) / attempts::DOUBLE AS p, {_z}::DOUBLE AS z FROM c)
SELECT provider, attempts, succeeded, zero_results, failed, mean_ms, max_ms,
  round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low,
  round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM w""",
    "version_ranges": VERSIONS,
    "clean_turns": CLEAN,
    "package_names": """SELECT p_partkey, e AS ecosystem, CASE e WHEN 'pypi' THEN regexp_replace(lower(n), '[-_.]+', '-', 'g') WHEN 'nuget' THEN lower(n) ELSE n END AS canonical
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'nuget' ELSE 'npm' END AS e, 'Pkg__' || p_partkey % 50 || '.-Name' AS n FROM part)""",
}
