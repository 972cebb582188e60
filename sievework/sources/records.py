"""Recorded bodies of providers as rows: ranked hits of search interfaces, and advisories.

A body is read with JSON paths that stand in a table, one row for each provider, so that a
provider is added by its paths. A record without an address on the web is passed over; a
title that is missing is the last part of the address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import local, text

# Where a provider's body holds its records, and a record its title, address (or a
# pattern of one with the path that fills it), description and date.
SHAPES = {
    "searxng": ("$.results", "$.title", "$.url", "$.content", "$.publishedDate"),
    "brave_api": ("$.web.results", "$.title", "$.url", "$.description", "$.page_age"),
    "exa": ("$.results", "$.title", "$.url", None, "$.publishedDate"),
    "tavily": ("$.results", "$.title", "$.url", "$.content", "$.published_date"),
    "serpapi": ("$.organic_results", "$.title", "$.link", "$.snippet", None),
    "kagi": ("$.data", "$.title", "$.url", "$.snippet", "$.published"),
    "wikipedia": ("$.query.search", "$.title", ("https://en.wikipedia.org/wiki/{}", "$.title"), "$.snippet", "$.timestamp"),
    "hn_algolia": ("$.hits", "$.title", "$.url", None, "$.created_at"),
    "github_issues": ("$.items", "$.title", "$.html_url", "$.body", "$.updated_at"),
    "github_releases": ("$", "$.name", "$.html_url", "$.body", "$.published_at"),
    "gitlab_issues": ("$", "$.title", "$.web_url", "$.description", "$.updated_at"),
    "crates_io": ("$.crates", "$.name", ("https://crates.io/crates/{}", "$.name"), "$.description", "$.updated_at"),
    "npm": ("$.objects", "$.package.name", ("https://www.npmjs.com/package/{}", "$.package.name"), "$.package.description", "$.package.date"),
    "packagist": ("$.results", "$.name", ("https://packagist.org/packages/{}", "$.name"), "$.description", None),
    "openalex": ("$.results", "$.title", "$.doi", None, "$.publication_date"),
    "crossref": ("$.message.items", "$.title[0]", ("https://doi.org/{}", "$.DOI"), "$.abstract", None),
    "semantic_scholar": ("$.data", "$.title", "$.url", "$.abstract", "$.publicationDate"),
}
SNIPPET = 300

OSV = "STRUCT<id: STRING, aliases: ARRAY<STRING>, published: STRING, severity: ARRAY<STRUCT<score: STRING>>, affected: ARRAY<STRUCT<package: STRUCT<name: STRING, ecosystem: STRING>, versions: ARRAY<STRING>, ranges: ARRAY<STRUCT<events: ARRAY<STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING>>>>>>>"


def _plain(raw: Column) -> Column:
    """Text without tags, on one line, cut at a word; null for none."""
    line = text.one_line(F.regexp_replace(raw, r"<[^>]*>", ""))
    cut = F.when(F.length(line) <= SNIPPET, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, SNIPPET), r"\s+\S*$", ""), F.lit("…")))
    return F.nullif(cut, F.lit(""))


def hits(bodies: DataFrame, most: int = 30) -> DataFrame:
    """query_id, provider, rank, title, url, snippet, published_at: the usable records of each body, in
    order. bodies: query_id, provider, body; a body that is no JSON, or of an unknown provider, gives none."""
    listed = F
    for provider, (at, *_) in SHAPES.items():
        listed = listed.when(F.col("provider") == provider, F.from_json(F.get_json_object("body", at), "array<string>"))
    rows = bodies.select("query_id", "provider", F.posexplode(listed.otherwise(F.lit(None).cast("array<string>"))).alias("pos", "record"))

    def field(k):
        out = F
        for provider, shape in SHAPES.items():
            path = shape[k]
            value = F.lit(None).cast("string") if path is None else F.get_json_object("record", path if isinstance(path, str) else path[1])
            if isinstance(path, tuple):
                name = F.when(F.col("provider") == "wikipedia", F.replace(F.replace(F.url_encode(F.trim(value)), F.lit("+"), F.lit("_")), F.lit("%2F"), F.lit("/"))).otherwise(F.trim(value))
                value = F.when(F.trim(value) != "", F.replace(F.lit(path[0]), F.lit("{}"), name))
            out = out.when(F.col("provider") == provider, value)
        return out

    url = F.when(field(2).rlike(r"^\s*(?i:https?)://[^\s/]+"), F.trim(field(2)))
    thread = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.nullif(F.trim(F.get_json_object("record", "$.objectID")), F.lit("")))
    read = rows.select("query_id", "provider", "pos", F.coalesce(url, F.when(F.col("provider") == "hn_algolia", thread)).alias("url"), text.one_line(field(1)).alias("said"), _plain(field(3)).alias("snippet"), local.timestamp(field(4)).alias("published_at"))
    title = F.coalesce(F.nullif("said", F.lit("")), F.regexp_extract("url", "([^/]+)/*$", 1))
    rank = F.row_number().over(Window.partitionBy("query_id", "provider").orderBy("pos"))
    usable = read.filter("url IS NOT NULL").withColumns({"rank": rank, "title": title}).filter(F.col("rank") <= most)
    return usable.select("query_id", "provider", "rank", "title", "url", "snippet", "published_at")


def advisories(bodies: DataFrame) -> DataFrame:
    """advisory_id, cve, ghsa, ecosystem, package, severity, affected and fixed: the advisory of each
    body in the format of the open vulnerability database. bodies: body. Each stretch between an
    introduced version and the fixed or last affected one after it is a range expression."""
    v = bodies.select(F.from_json("body", OSV).alias("v")).filter("v.id IS NOT NULL").select("v.*")
    named = lambda p: F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.startswith(p))
    packages = F.filter(F.transform("affected", lambda a: a["package"]), lambda p: p.isNotNull())
    ranges = F.flatten(F.transform(F.coalesce("affected", F.array().cast("array<" + OSV.split("affected: ARRAY<")[1][:-2] + ">")), lambda a: F.coalesce(a["ranges"], F.array().cast("array<struct<events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"))))

    def spec(r):
        e = r["events"]
        first = lambda k: F.get(F.filter(F.transform(e, lambda x: x[k]), lambda x: x.isNotNull()), 0)
        low, high, last = first("introduced"), first("fixed"), first("last_affected")
        return F.array_join(F.array_compact(F.array(F.when(low != "0", F.concat(F.lit(">="), low)), F.coalesce(F.concat(F.lit("<"), high), F.concat(F.lit("<="), last)))), ", ")

    fixed = F.array_distinct(F.filter(F.flatten(F.transform(ranges, lambda r: F.transform(r["events"], lambda x: x["fixed"]))), lambda x: x.isNotNull()))
    score = F.lower(F.get(F.filter(F.transform("severity", lambda s: s["score"]), lambda s: s.isNotNull()), 0))
    level = F
    for name, words in {"critical": "critical", "high": "high", "medium": "medium|moderate", "low": "low"}.items():
        level = level.when(score.rlike(words), name)
    number = F.regexp_extract(score, r"^(?:.*\s)?([0-9]+(?:\.[0-9]+)?)(?:\s|$)", 1).try_cast("double")
    by_number = F.when(number >= 9, "critical").when(number >= 7, "high").when(number >= 4, "medium").when(number > 0, "low")
    return v.select(
        F.col("id").alias("advisory_id"),
        named("CVE-").alias("cve"),
        F.transform(named("GHSA-"), F.upper).alias("ghsa"),
        F.get(packages, 0)["ecosystem"].alias("ecosystem"),
        F.get(packages, 0)["name"].alias("package"),
        F.coalesce(level.otherwise(F.lit(None).cast("string")), by_number, F.lit("unknown")).alias("severity"),
        F.filter(F.transform(ranges, spec), lambda s: s != "").alias("affected"),
        fixed.alias("fixed"),
        local.timestamp(F.col("published")).alias("published_at"),
    )
