"""Recorded feeds in XML as ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import local, text

ARTICLES = "https://arxiv.org/abs/"
SNIPPET = 500
FIELDS = "id title summary published updated".split()
#: An entry; one that holds entries itself is no entry.
ENTRY = f"struct<{', '.join(f'{k}: array<string>' for k in FIELDS)}, author: array<struct<name: string>>, entry: array<string>>"


def article_url(raw: Column) -> Column:
    """The address of an article without its version, so that all versions are one; the archive of old
    identifiers stays. raw is an address with /abs/ or a bare identifier; null without one."""
    tail = F.trim(raw)
    tail = F.when(F.contains(tail, F.lit("/abs/")), F.regexp_replace(F.regexp_replace(tail, "^.*?/abs/", ""), "^/+|/+$", "")).otherwise(tail)
    last = F.regexp_replace(F.regexp_extract(tail, "([^/]*)$", 1), r"^([^v]+)v[0-9]+$", "$1")
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    archive = F.regexp_extract(tail, "^(.*)/[^/]*$", 1)
    return F.when(last != "", F.concat(F.lit(ARTICLES), F.when(archive != "", F.concat(encode(archive), F.lit("/"))).otherwise(""), encode(last)))


def _feeds(bodies: DataFrame) -> DataFrame:
    """query_id, feed, whole: parsed bodies, and whether each is a feed up to its end without entries in entries."""
    read = F.from_xml("body", f"entry array<{ENTRY}>, broken string", {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"})
    nested = F.exists(F.coalesce("feed.entry", F.array().cast(f"array<{ENTRY}>")), lambda e: e["entry"].isNotNull())
    # As a generated row a body is parsed once; a filter would otherwise be pushed below and parse it again.
    return bodies.select("query_id", F.explode(F.array(read)).alias("feed")).withColumn("whole", F.col("feed").isNotNull() & F.col("feed.broken").isNull() & ~nested)


def faults(bodies: DataFrame) -> DataFrame:
    """query_id of the bodies that are no whole feed."""
    return _feeds(bodies).filter("NOT whole").select("query_id")


def atom_hits(bodies: DataFrame, most: int = 30) -> DataFrame:
    """query_id, rank, title, url, snippet, published_at, authors: the usable entries of each Atom feed, in
    order. bodies: query_id (unique), body.

    Of a field that is repeated the first that is not blank counts, and white space in it is folded. Entries
    without an article or a title are passed over; the date is that of the last change where none of
    publication is given. A body that is no feed, is cut short or has entries within entries gives none, as
    does null; ``faults`` tells those from feeds without entries."""
    rows = _feeds(bodies).filter("whole").select("query_id", F.posexplode("feed.entry").alias("pos", "e"))
    one = lambda k: F.get(F.filter(F.transform(F.col(f"e.{k}"), text.one_line), lambda v: v != ""), F.lit(0))
    cut = lambda c: F.when(F.length(c) <= SNIPPET, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, SNIPPET), r"\s+\S*$", ""), F.lit("…")))
    names = F.filter(F.transform(F.col("e.author"), lambda a: text.one_line(a["name"])), lambda n: n != "")
    made = rows.select("query_id", "pos", article_url(one("id")).alias("url"), one("title").alias("title"), cut(one("summary")).alias("snippet"), local.timestamp(F.coalesce(one("published"), one("updated"))).alias("published_at"), F.array_join(F.coalesce(names, F.array()), ", ").alias("authors"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return made.filter("url IS NOT NULL AND title IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "rank", "title", "url", "snippet", "published_at", "authors")
