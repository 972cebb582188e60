"""Quality rules on lines: what many documents of a host share goes, and what is left is judged.

Lines are normalised (lower case, runs of digits to one 0, white space to single spaces) and hashed
with the host. For each line the distinct documents of its host are counted; copies of one text
count once, so a text copied whole is no boilerplate of itself. A line is removed where more than
``many`` documents and more than ``share`` of the host's documents have it: menus, notices and
footers. A document is rejected if the base rules fail it (few words, or words that repeat), or if
removal depletes it: under ``keep`` of its words or under ``least`` words are left.

Cost: texts are read once and not shuffled; a line travels as three hashes, twice: once to be counted
(folded by text first) and once to the lines above the limits. Both counts and sums are taken
in the tasks first. The lines above the limits are written out, so the join has two plain sides and
Spark splits the tasks of a hot one.

Cases: a null or empty text, or white space alone, has no words and fails the base rules. A null
host is a host of its own. Repeated rows stand each and count as one document; so do copies under
other ids. Equal counts pose no ties: limits are strict. A text of any length is judged whole. An
empty table gives no rows. Columns whose names clash with the result's are replaced, others
are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

common.by_value(__name__)

SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed", "base_failed", "kept")


def repeated_words(text: str | None, size: int = 5) -> int:
    """Words that lie in windows of ``size`` words found twice or more in the text."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    # Numbers of pairs of words, of pairs of pairs, and so on: exact, no hash.
    one, at = ids, 1
    while at < size:
        step = min(at, size - at)
        pairs = one[: len(one) - step] * np.int64(one.max() + 1) + one[step:]
        one, at = np.unique(pairs, return_inverse=True)[1].astype(np.int64), at + step
    twice = (np.bincount(one) > 1)[one]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[size : size + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def normalised(text):
    """The text with its lines normalised, still separated by newlines."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.regexp_replace(out, " ?\n ?", "\n")


def line_hashes(text):
    """struct(h, w) of every line: hash and words (0 of a line without words)."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    lines = F.split(normalised(F.coalesce(text, F.lit(""))), "\n")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.when(F.trim(x) == "", 0).otherwise(words(F.trim(x))).alias("w")))


def measured(docs: DataFrame) -> DataFrame:
    """docs plus the base counts, _host, _a and _b (hashes of the text) and _lines."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def repeats(texts: pd.Series) -> pd.Series:
        return pd.Series([repeated_words(t) for t in texts], dtype="int64")

    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(common.TOKEN)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*RESULT, "kept_text"}]
    return docs.select(
        *kept,
        F.regexp_count(text, F.lit(common.TOKEN)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        repeats("text").alias("n_repeat_words"),
        F.xxhash64("source", F.lit("host")).alias("_host"),
        F.xxhash64(text).alias("_a"),
        F.xxhash64(text, F.lit("b")).alias("_b"),
        line_hashes(F.col("text")).alias("_lines"),
    )


def frequent(rows: DataFrame, many: int, share: float) -> DataFrame:
    """_host, h: the lines that more distinct documents of the host have than the limits allow."""
    lines = rows.select("_host", "_a", "_b", F.explode("_lines").alias("_l")).filter("_l.w > 0").select("_host", "_a", "_b", "_l.h")
    docs = lines.distinct().groupBy("_host", "h").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > many)
    hosts = rows.select("_host", "_a", "_b").distinct().groupBy("_host").agg(F.count("*").alias("_all"))
    return docs.join(hosts, "_host").filter(F.col("_docs") > F.col("_all") * share).select("_host", "h")


def judge(docs: DataFrame, many: int = 10, share: float = 0.05, keep: float = 0.5, least: int = 10, repeat: int = 20, texts: bool = True) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    n_words_removed, base_failed, kept and, with ``texts``, kept_text: the text without the lines removed."""
    names = [c for c in docs.columns if c.lower() not in {*RESULT, "kept_text"} and (texts or c.lower() != "text")]
    rows = measured(docs)
    if not texts:
        rows = rows.drop("text")
    rows = common.materialise(rows, "measured")
    gone = common.materialise(frequent(rows, many, share), "frequent-lines")
    each = rows.select("_host", "_a", "_b", F.explode("_lines").alias("_l")).filter("_l.w > 0").select("_host", "_a", "_b", "_l.h", "_l.w")
    hit = each.join(gone, ["_host", "h"])
    wanted = [F.count("*").alias("_n"), F.sum("w").alias("_w")] + ([F.collect_set("h").alias("_gone")] if texts else [])
    copies = rows.groupBy("_host", "_a", "_b").agg(F.count("*").alias("_copies"))
    removed = hit.groupBy("_host", "_a", "_b").agg(*wanted)
    removed = removed.join(copies, ["_host", "_a", "_b"])
    # Copies of a text add the same sum each.
    removed = removed.withColumns({"_n": F.expr("_n div _copies"), "_w": F.expr("_w div _copies")}).drop("_copies")
    both = rows.join(common.materialise(removed, "lines-removed"), ["_host", "_a", "_b"], "left")
    both = both.withColumns({"n_lines_removed": F.coalesce("_n", F.lit(0)).cast("long"), "n_words_removed": F.coalesce("_w", F.lit(0)).cast("long")})
    left = F.col("n_words") - F.col("n_words_removed")
    both = both.withColumn("base_failed", (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > repeat * F.col("n_words")))
    both = both.withColumn("kept", ~F.col("base_failed") & (left >= least) & (left >= keep * F.col("n_words")))
    out = [*[F.col(f"`{c}`") for c in names], *RESULT]
    if not texts:
        return both.select(*out)

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(t, own, drop):
            drop = set(drop if drop is not None else ())
            return "\n".join(x for x, h in zip((t or "").split("\n"), own, strict=True) if h not in drop)

        return pd.Series([one(*r) for r in zip(text, lines, hashes, strict=True)], dtype=object)

    return both.select(*out, without("text", F.transform("_lines", lambda x: x.h), "_gone").alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs, texts=False).select("doc_id", *RESULT)


SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{common.TOKEN}') AS w FROM documents),
raw AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS MATERIALIZED (
  SELECT rid, source, text, line, CAST(len(regexp_extract_all(line, '{common.TOKEN}')) AS BIGINT) AS n,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS norm
  FROM raw WHERE regexp_matches(line, '{common.TOKEN}')),
frequent AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS docs FROM lines GROUP BY ALL)
  JOIN (SELECT source AS host, count(DISTINCT text) AS every FROM d GROUP BY ALL) h ON source IS NOT DISTINCT FROM host
  WHERE docs > 10 AND docs > every * 0.05::DOUBLE),
removed AS (
  SELECT rid, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_words
  FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
windows AS (SELECT rid, i, w[i : i + 4] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n_lines, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(removed.n_words, 0) AS BIGINT) AS n_words_removed
  FROM d LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND n_words - n_words_removed >= 10 AND 2 * (n_words - n_words_removed) >= n_words AS kept FROM judged
"""
