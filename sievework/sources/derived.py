"""Tables of the retrieval engine, derived from the given ones by plain arithmetic.

Each has its DataFrame and the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.session import table

#: Providers, and requests for each run of pages: requests grow with the pages.
PROVIDERS, QUERIES, RUN = 5, 3, 500


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, provider, rank, url, title: ranked lists of pages, urls spelt as providers do."""
    lists = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(p).alias("p")) for q in range(QUERIES) for p in range(PROVIDERS)])).alias("l")
    page = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), lists)
    listed = page.select("page_id", "url", "title", "l.p", (F.col("l.q") + F.lit(QUERIES) * F.floor(F.col("page_id") / RUN)).alias("query_id")).filter("(page_id * 7 + p * 13) % 5 < 1 + page_id % 3")
    order = Window.partitionBy("query_id", "p").orderBy(F.expr("(page_id * 31 + query_id * 17) % 997"), "page_id")
    spelt = F.when((F.col("p") == 1) & ~F.col("url").contains("#"), F.concat("url", F.lit("#list"))).when(
        (F.col("p") == 2) & ~F.col("url").rlike("[?#]"), F.concat("url", F.lit("?utm_source=p2"))
    ).otherwise(F.col("url"))
    return listed.select("query_id", F.concat(F.lit("p"), F.col("p")).alias("provider"), F.row_number().over(order).alias("rank"), spelt.alias("url"), "title")


HITS = f"""hits AS (
  SELECT query_id, 'p' || p AS provider,
         row_number() OVER (PARTITION BY query_id, p ORDER BY (page_id * 31 + query_id * 17) % 997, page_id) AS rank,
         CASE WHEN p = 1 AND NOT contains(url, '#') THEN url || '#list'
              WHEN p = 2 AND NOT regexp_matches(url, '[?#]') THEN url || '?utm_source=p2' ELSE url END AS url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
  FROM (SELECT page_id, url, html, q + {QUERIES} * (page_id // {RUN}) AS query_id, p FROM pages, range({QUERIES}) a(q), range({PROVIDERS}) b(p))
  WHERE (page_id * 7 + p * 13) % 5 < 1 + page_id % 3)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """provider, outcome, duration_ms, ts: calls of providers."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 8 AS provider",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'zero_results' ELSE 'success' END AS outcome",
        "value AS duration_ms",
        "ts",
    )


ATTEMPTS = """attempts AS (
  SELECT user_id % 8 AS provider,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'zero_results' ELSE 'success' END AS outcome,
         value AS duration_ms, ts FROM events)"""
