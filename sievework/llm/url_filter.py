"""URL filters as a sort-merge range join, in DataFrame functions only.

A host turns into a key of its labels in reverse, each ended by a dot ("a.example.org"
is "org.example.a."). A rule for a host and all its subdomains then covers the interval
from its key to the same key with "/" for the last dot, since "/" is the character after
"." and no label holds either. Intervals of rules are nested or apart. Rules send an
opening and a closing event, pages are points, and one sorted sweep carries the stack of
the rules open at each point: an event holds the whole stack as it is after it, so the
stack at a page is that of the last event before it. Of the stack's rules whose path the
page's path starts with, the longest wins.

Cost: the sweep is dealt out by the first two labels and a salt (``salts`` parts), so one
hot host spreads over that many parts; a rule's events go only to the parts of its own
two labels, and rules of a single label enter as the stack at the start of a part. The
stack of a rule is found among rules only. No rule table is broadcast by force.

Cases: a null url or one without "://" has an empty host and path and gets no rule. Ports
and user names belong to the host as the contract reads it. Empty rules or pages give the
default verdict or no rows. Repeated rows are judged each; a very long url is judged whole,
and only its host is in the sorted key. Rules that repeat count once;
of rules equally long, the longer host wins, then the text order. Columns that clash with
the result's are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

RULE = "struct<n:int,nh:int,rule:string,verdict:string,path:string,key:string>"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url):
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _prefix(labels, n):
    return F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))


def _labels(host):
    return F.reverse(F.split(host, r"\.", -1))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = 64) -> DataFrame:
    """pages (with a url) plus host, path, rule ("host/path" of the winning rule, or null) and verdict.

    rules: verdict, host, path."""
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    at = (
        pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("url").alias("_url"))
        .withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
        .withColumn("_labels", _labels(F.col("_host")))
        .select(
            "_row",
            "_host",
            "_path",
            _prefix(F.col("_labels"), F.size("_labels")).alias("_key"),
            _prefix(F.col("_labels"), 2).alias("_part"),
            F.pmod(F.xxhash64("_url", "_row"), F.lit(salts)).alias("_salt"),
        )
    )
    own = (
        rules.select(common.ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .distinct()
        .withColumn("labels", _labels(F.col("host")))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("key", _prefix(F.col("labels"), F.size("labels")))
        .withColumn("one", F.struct(F.length("rule").alias("n"), F.length("host").alias("nh"), "rule", "verdict", "path", "key").cast(RULE))
    )
    enclosing = (
        own.select("key", "labels").distinct()
        .select("key", "labels", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: _prefix(F.col("labels"), n))).alias("above"))
    )
    stacks = (
        enclosing.join(own.select(F.col("key").alias("above"), "one"), "above")
        .groupBy("key", "labels")
        .agg(F.collect_list("one").alias("stack"))
    )
    parts = at.select("_part", "_salt").distinct()
    none = F.array().cast(f"array<{RULE}>")
    start = parts.join(
        stacks.filter(F.size("labels") == 1).select(F.col("key").alias("_first"), "stack"),
        F.regexp_extract("_part", r"^([^.]*\.)", 1) == F.col("_first"),
        "left",
    ).select("_part", "_salt", F.lit("").alias("_key"), F.lit(0).alias("_kind"), F.coalesce("stack", none).alias("_stack"))
    events = (
        stacks.filter(F.size("labels") > 1)
        .select(
            _prefix(F.col("labels"), 2).alias("_part"),
            F.explode(
                F.array(
                    F.struct(F.col("key").alias("k"), F.col("stack").alias("s")),
                    F.struct(
                        F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")).alias("k"),
                        F.filter("stack", lambda r: r["key"] != F.col("key")).alias("s"),
                    ),
                )
            ).alias("e"),
        )
        .join(parts, "_part")
        .select("_part", "_salt", F.col("e.k").alias("_key"), F.lit(1).alias("_kind"), F.col("e.s").alias("_stack"))
    )
    sweep = Window.partitionBy("_part", "_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    best = F.array_max(F.filter("_stack", lambda r: F.startswith(F.col("_path"), r["path"])))
    return (
        at.withColumn("_kind", F.lit(2))
        .unionByName(start.unionByName(events), allowMissingColumns=True)
        .withColumn("_stack", F.last("_stack", ignorenulls=True).over(sweep))
        .filter("_kind = 2")
        .withColumn("_best", best)
        .select(
            *[F.col(f"_row.`{c}`") for c in kept],
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{common.UPPER}', '{common.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT rid, r.host || r.path AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (rid)
"""
