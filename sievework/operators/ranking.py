"""Scores of cards that might be fetched, and boosts of cards that fit a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points by mode of a request, for kinds of source and for roles of a file.
KINDS = {
    "normal": {"docs": 10, "registry": 8, "release": 5, "issue": 5, "pull_request": 5, "source_file": 5},
    "exact_error": {"issue": 25, "pull_request": 20, "release": 15, "source_file": 10, "docs": 5},
    "package_migration": {"release": 20, "registry": 15, "docs": 10, "source_file": 5},
    "security": {"advisory": 30, "release": 15, "issue": 10},
    "research": {"docs": 15, "source_file": 10, "advisory": 10, "release": 5},
}
ROLES = {
    "normal": {"implementation": 10, "documentation": 10, "readme": 8, "example": 5, "changelog": 5, "migration": 5, "test": 3, "benchmark": 3, "configuration": 2},
    "exact_error": {"changelog": 10, "migration": 8},
    "package_migration": {"changelog": 15, "migration": 15},
    "security": {},
    "research": {"benchmark": 10},
}
PROVENANCE = {"pinned_raw": 30, "pinned_browser": 20, "locator": 15, "raw": 10, "browser": 5}
CONFIDENCE = {"exact": 15, "strong": 10, "weak": 5, "unknown": -5}
CONTEXT = {"path": 8, "language": 5, "file": 5, "error": 10, "version": 5, "package": 8}
# Boosts by intent, in tenths of a query's best score.
INTENTS = {"docs": 2.0, "code": 2.0, "issues": 2.0, "releases": 2.0, "news": 2.0, "security": 3.0, "web": 0.0}
ERROR_BOOSTS = {"phrase": 2.5, "code": 1.5, "docs_with_code": 1.0, "official_docs": 1.0, "issue": 0.5, "release": 0.5}


def _points(table: dict, *keys: Column) -> Column:
    flat = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(flat, F.concat_ws("/", *keys) if len(keys) > 1 else keys[0]), F.lit(0))


def candidate_score(mode: Column, kind: Column, role: Column, provenance: Column, confidence: Column, context: Column) -> Column:
    """Points of a card: for kind and role under the mode (normal's if there is no such mode), where
    its text comes from, how sure that is, and what of the request it shares (an array of names;
    a symbol counts for source files only). A source file of unknown confidence loses five more."""
    known = F.when(mode.isin(list(KINDS)), mode).otherwise("normal")
    flat = lambda t: {f"{m}/{k}": v for m, d in t.items() for k, v in d.items()}
    shares = F.array_distinct(F.coalesce(context, F.array().cast("array<string>")))
    shared = F.aggregate(shares, F.lit(0), lambda a, x: a + _points(CONTEXT, x))
    symbol = F.when((kind == "source_file") & F.array_contains(shares, "symbol"), 10).otherwise(0)
    doubt = F.when((kind == "source_file") & (confidence == "unknown"), -5).otherwise(0)
    return _points(flat(KINDS), known, kind) + _points(flat(ROLES), known, role) + _points(PROVENANCE, provenance) + _points(CONFIDENCE, confidence) + shared + symbol + doubt


def error_boosted(cards: DataFrame) -> DataFrame:
    """cards with score raised by a tenth of the query's best for each unit: the error's phrase or one
    of its codes in title or snippet (a code once), kinds that explain errors; stable on pos.

    cards: query_id, pos, score, title, snippet, kind, phrase, codes (array)."""
    said = F.lower(F.concat_ws(" ", "title", "snippet"))
    has_code = F.exists(F.coalesce("codes", F.array().cast("array<string>")), lambda c: F.contains(said, F.lower(c)))
    b, kind = ERROR_BOOSTS, F.col("kind")
    unit = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    units = (
        unit((F.length("phrase") > 0) & F.contains(said, F.lower("phrase")), b["phrase"])
        + unit(has_code, b["code"])
        + unit(kind.isin("docs", "reference") & has_code, b["docs_with_code"])
        + unit(kind == "docs", b["official_docs"])
        + unit(kind.isin("issue", "pull_request"), b["issue"])
        + unit(kind.isin("release", "tag"), b["release"])
    )
    w = Window.partitionBy("query_id")
    out = cards.withColumn("score", F.round(F.col("score") + 0.1 * F.max("score").over(w) * units, 12))
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "pos")))


def quality(kind: Column, providers: Column, has_code: Column, has_record: Column, has_snippet: Column, exact: Column) -> Column:
    """struct(authority, strength, doubts): how official a card's source is, how firm what it shows
    is, and why to doubt it. Null flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    native = F.exists(F.coalesce(providers, F.array().cast("array<string>")), lambda p: p.rlike("github|gitlab|gitea"))
    authority = (
        F.when(kind.isin("docs", "reference"), "official")
        .when(kind == "registry", "package_registry")
        .when(kind == "advisory", "primary")
        .when(kind.isin("issue", "pull_request", "release", "tag", "commit", "source_file") & native, "maintainer")
        .when(kind.isin("issue", "pull_request", "tutorial", "forum"), "community")
        .when(kind == "news", "news_or_blog")
        .otherwise("unknown")
    )
    strength = (
        F.when(yes(has_code), "exact_code_span").when(yes(exact), "exact_identifier").when(yes(has_record), "structured_metadata").when(yes(has_snippet), "snippet_only").otherwise("url_only")
    )
    bare = ~yes(has_code) & ~yes(has_record) & ~yes(has_snippet)
    doubts = F.array_compact(F.array(F.when(authority == "unknown", "low_authority"), F.when(bare, "no_snippet")))
    return F.struct(authority.alias("authority"), strength.alias("strength"), doubts.alias("doubts"))
