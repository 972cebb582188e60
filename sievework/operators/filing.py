"""Summaries of files, trust and verdicts, what to do about findings, and pages, budgets and unions of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.sources import holds

# What tells a test by its text and by its path, and how sure each kind of hint is.
TEST_TEXT = ["#[test]", "def test_", "func Test", "describe(", "it("]
TEST_ENDINGS = ["_test.rs", "_test.py", "_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
CONFIDENCE = ["syntax", "path", "name_reference", "package"]


def trust(fields: DataFrame) -> DataFrame:
    """Of each query_id: sources by trust, and what was done to their texts, added up. fields: query_id,
    trust, sanitized, truncated, framed, removed, injections."""
    return fields.groupBy("query_id").agg(
        F.count_if(F.col("trust") == "external_untrusted").alias("external"),
        F.count_if(F.col("trust") == "local_trusted").alias("local"),
        F.sum("injections").alias("injections"),
        F.sum("removed").alias("removed"),
        *[F.bool_or(c).alias(c) for c in ("sanitized", "truncated", "framed")],
    )


def languages(files: DataFrame) -> DataFrame:
    """repo, language, n_files, bytes, share of the bytes; files: repo, language, size."""
    each = files.filter("language IS NOT NULL").groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    return each.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy("repo")), 9))


def remedies(verdicts: DataFrame) -> DataFrame:
    """finding_id, action, what: what to do about findings that are not cleared. verdicts: finding_id,
    package, verdict (affected, unknown, insufficient_evidence or not_affected), fixed (array)."""
    first = F.get("fixed", 0)
    has = (F.col("verdict") == "affected") & first.isNotNull()
    review = lambda why: F.concat(F.lit("Manual review required for "), F.col("package"), F.lit(f" - {why}"))
    what = (
        F.when(has, F.concat(F.lit("Upgrade "), F.col("package"), F.lit(" to version "), first, F.lit(" or later")))
        .when(F.col("verdict") == "affected", review("no fixed version available in advisory metadata"))
        .when(F.col("verdict") == "unknown", review("applicability could not be determined"))
        .when(F.col("verdict") == "insufficient_evidence", review("insufficient version/dependency data to assess"))
    )
    return verdicts.select("finding_id", F.when(has, "upgrade").otherwise("manual_review").alias("action"), what.alias("what")).filter("what IS NOT NULL")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """package and its findings by verdict."""
    return verdicts.groupBy("package").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("affected", "not_affected", "unknown", "insufficient_evidence")])


def references(texts: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, symbol, line, said: lines in which a symbol stands as a word of its own, the first ``most``
    of a document. texts: doc_id, text, symbol and symbols: symbol; a text is looked through for its own symbol."""
    lines = texts.join(symbols, "symbol", "left_semi").select("doc_id", "symbol", F.posexplode(F.split("text", "\r?\n")).alias("n", "x"))
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("symbol"), F.lit(r"\E(?![A-Za-z0-9_])"))
    found = lines.filter(F.contains("x", "symbol") & F.regexp_like("x", word)).select("doc_id", "symbol", (F.col("n") + 1).alias("line"), F.substring(F.trim("x"), 1, 500).alias("said"))
    place = F.row_number().over(Window.partitionBy("doc_id", "symbol").orderBy("line"))
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def test_hints(pairs: DataFrame) -> DataFrame:
    """repo, source, test, confidence, reasons: files that may test a source file. pairs: repo, source, test, text (of the test)."""
    test, text = F.lower("test"), F.coalesce("text", F.lit(""))
    name = F.substring_index(test, "/", -1)
    parts = F.split(F.substring_index("source", "/", -1), r"\.")
    stem = F.lower(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.get(parts, 0)))
    folder = F.regexp_extract("source", "^(.*)/[^/]*$", 1)
    syntax = holds(text, TEST_TEXT)
    path = test.startswith("tests/") | F.contains(test, F.lit("/tests/")) | name.startswith("test_") | name.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS) + ")$")
    named = F.contains(test, stem) & (F.octet_length(stem) >= 3)
    package = (folder != "") & F.startswith("test", F.concat(folder, F.lit("/"))) & ~syntax & ~path & ~named
    confidence = F.when(syntax, "syntax").when(path, "path").when(named, "name_reference").when(package, "package")
    reasons = F.array_compact(F.array(F.when(named, F.lit("name_reference")), F.when(package, F.lit("package_boundary")), F.when(path, F.lit("path_convention")), F.when(syntax, F.lit("syntax_test_item"))))
    out = pairs.filter("source <> test").select("repo", "source", "test", confidence.alias("confidence"), F.array_join(reasons, ",").alias("reasons")).filter("confidence IS NOT NULL")
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("repo", "source").orderBy(rank, "test")))


def paged(groups: DataFrame, size: int = 14) -> DataFrame:
    """groups (query_id, group_no, group) with page, from 0, and pages."""
    w = Window.partitionBy("query_id")
    return groups.withColumns({"page": F.floor((F.row_number().over(w.orderBy("group_no", "group")) - 1) / size), "pages": F.ceil(F.count("*").over(w) / size)})


def budgeted(findings: DataFrame, per_file: int, in_all: int) -> DataFrame:
    """request, file, pos, cut: the first ``per_file`` findings of a file and of those the first
    ``in_all`` of a request, in order, and whether any of the file's were left out."""
    of_file = Window.partitionBy("request", "file")
    own = findings.withColumns({"k": F.row_number().over(of_file.orderBy("pos")), "n": F.count("*").over(of_file)}).filter(F.col("k") <= per_file)
    of_all = Window.partitionBy("request").orderBy("file", "pos")
    return own.withColumn("a", F.row_number().over(of_all)).filter(F.col("a") <= in_all).select("request", "file", "pos", (F.col("n") > per_file).alias("cut"))


def with_local(local: DataFrame, remote: DataFrame, most: int) -> DataFrame:
    """query_id, place, origin, pos: up to half of the results from the workspace, at least one, then
    remote ones until there are ``most``. Both: query_id, pos."""
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    near = local.select("query_id", "pos").withColumn("k", own).filter(F.col("k") <= max(most // 2, 1) * (most > 0)).select("query_id", "pos", F.lit("local").alias("origin"))
    far = remote.select("query_id", "pos").withColumn("k", own).filter(F.col("k") <= most).select("query_id", "pos", F.lit("remote").alias("origin"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "pos"))
    return near.unionByName(far).withColumn("place", place).filter(F.col("place") <= most)


def candidates(files: DataFrame, most: int, score, language: str | None = None, file: str | None = None, folder: str | None = None) -> DataFrame:
    """repo, place, path, score: of the files of a repository that fit all hints given the best
    2 x ``most``, those of equal score by path. files: repo, path, language and what score reads."""
    fits = F.lit(True)
    if language is not None:
        fits = fits & F.coalesce(F.col("language") == language, F.lit(False))
    if file is not None:
        fits = fits & F.contains(F.substring_index("path", "/", -1), F.lit(file))
    if folder is not None:
        fits = fits & F.contains(F.lower("path"), F.lit(folder.lower()))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "path"))
    return files.filter(fits).withColumn("score", score).withColumn("place", place).filter(F.col("place") <= 2 * most).select("repo", "place", "path", "score")
