"""Importance resampling towards a target distribution, over hashed n-grams.

Texts become a table of words with their positions. For each order up to ``order`` the words
that follow within the document are fetched by lead() over its positions and joined to the word;
order one needs none, so there no window runs. Each n-gram falls into one of ``buckets`` by its
crc32. The gain of a bucket is floor(1000 * ln) of how much likelier it is in the target than in
the corpus, with one added to every count; a document's weight is the sum of the gains of its
n-grams. Weights are perturbed with Gumbel noise from a hash of the id and the highest
scores are drawn: a draw without replacement in proportion to exp(weight / 1000).

Cost: two scans of the texts. Counts are added up in the tasks that read the texts, so what is
shuffled is at most ``buckets`` rows of each task and one row of each document; for orders
over one the words of documents are shuffled once for the windows. The table of gains, which is
broadcast, has ``buckets`` rows whatever the input, at most ``MAX_BUCKETS``. Ranks are counted
within ranges of scores, with the counts of ranges above added; ranges wholly below the draw are
not sorted.

Cases: a null or empty text has no n-grams, weight 0 and is never drawn under ``least`` words. A
null id has no hash, so no score, and is never drawn, but counts among the documents. Repeated
rows (id and text) are folded while they are counted and come back each with a rank of its
own. Ties go to the smaller id, then to the text's hash. An empty target gives gains from the
corpus alone; an empty corpus no rows. A text of any length is counted whole. Columns other than
id and text are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

MAX_BUCKETS = 1_000_000
#: Rows in a range of scores that are ranked together, and ranges at most.
RANGE, RANGES = 5_000, 1_024


def grams(rows: DataFrame, order: int) -> DataFrame:
    """rows' columns but text, with pos, gram (null where a text has no words) and n (its words): all n-grams of its text."""
    keys = [F.col(f"`{c}`") for c in rows.columns if c != "text"]
    words = F.regexp_extract_all(common.ascii_lower("text"), F.lit(common.WORD), F.lit(0))
    if order == 1:
        return rows.select(*keys, F.posexplode_outer(words).alias("pos", "gram")).withColumn("n", F.lit(1))
    # One number for each row, given before its words are dealt out: copies of a row must not share a window.
    numbered = rows.withColumn("_r", F.monotonically_increasing_id())
    table = numbered.select(*keys, "_r", F.posexplode_outer(words).alias("pos", "gram"))
    along = Window.partitionBy("_r").orderBy("pos")
    after = [F.lead("gram", k).over(along).alias(f"_{k}") for k in range(1, order)]
    wide = table.select("*", *after).select(
        *table.columns, F.array(*[F.struct(F.lit(n).alias("n"), _joined(n).alias("gram")) for n in range(1, order + 1)]).alias("_all")
    )
    each = wide.drop("gram").select("*", F.explode("_all").alias("_g"))
    return each.filter("_g.n = 1 OR _g.gram IS NOT NULL").select(*keys, "pos", "_g.gram", "_g.n")


def _joined(n: int):
    parts = [F.col("gram"), *[F.col(f"_{k}") for k in range(1, n)]]
    return F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)) if n > 1 else parts[0]


def bucketed(table: DataFrame, buckets: int) -> DataFrame:
    return table.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int"))


def gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: one row for each bucket."""
    count = lambda df, name: bucketed(grams(df.select("text"), order), buckets).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left")
    held = common.materialise(both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]), "bucket-counts")
    corpus, wanted = held.agg(F.sum("s"), F.sum("t")).first()
    share = (F.col("t") + 1) * F.lit(corpus + buckets) / ((F.col("s") + 1) * F.lit(wanted + buckets))
    return held.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def scores(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, _a and _b (hashes of the text), copies, n_words, n_features, weight and score of each
    distinct (doc_id, text) of docs."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} buckets: their gains are broadcast")
    learned = gains(docs, target, order, buckets)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_a"), F.xxhash64("text", F.lit("b")).alias("_b"), "text")
    each = bucketed(grams(rows, order), buckets).join(F.broadcast(learned), "bucket", "left")
    first = (F.col("n") == 1) & F.coalesce(F.col("pos") == 0, F.lit(True))
    found = each.groupBy("doc_id", "_a", "_b").agg(
        F.count_if(first).alias("copies"),
        F.count_if((F.col("n") == 1) & F.col("gram").isNotNull()).alias("_w"),
        F.count("gram").alias("_f"),
        F.coalesce(F.sum("gain"), F.lit(0)).alias("_g"),
    )
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.selectExpr("doc_id", "_a", "_b", "copies", "_w div copies AS n_words", "_f div copies AS n_features", "_g div copies AS weight").withColumn(
        "score", (F.col("weight") + noise).cast("long")
    )


def ranked(scored: DataFrame, percent: int = 10, least: int = 20) -> DataFrame:
    """scored, one row for each copy, with rank: 1, 2, 3 ... of the ``percent`` percent of the
    documents of at least ``least`` words that have the highest scores; null of the others."""
    found = common.materialise(scored, "scores")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least)
    total, rows = found.filter(F.col("n_words") >= least).agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    draw, parts = percent * total // 100, max(1, min(RANGES, rows // RANGE))
    edges = found.filter(able).agg(F.percentile_approx("score", F.array(*[F.lit(k / parts) for k in range(parts)]), 10_000)).first()[0] or [0]
    # Ranges from the top: how many of the edges lie above the score.
    above = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in sorted(set(edges))]), lambda e: e > F.col("score")))
    dealt = found.withColumn("_range", F.when(able, above))
    counts = {r[0]: r[1] for r in dealt.filter("_range IS NOT NULL").groupBy("_range").agg(F.sum("copies")).collect()}
    before, live = 0, []
    for r in sorted(counts):
        if before < draw:
            live.append((r, before))
        before += counts[r]
    offsets = scored.sparkSession.createDataFrame(live, "_range int, _before long")
    along = Window.partitionBy("_range").orderBy(F.desc("score"), "doc_id", "_a", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = dealt.join(F.broadcast(offsets), "_range").withColumn("_last", F.sum("copies").over(along) + F.col("_before"))
    each = top.select(*found.columns, F.explode(F.sequence(F.col("_last") - F.col("copies") + 1, F.col("_last"))).alias("_k"))
    drawn = each.withColumn("rank", F.when(F.col("_k") <= draw, F.col("_k")).cast("long")).drop("_k")
    rest = dealt.filter(F.col("_range").isNull() | ~F.col("_range").isin([r for r, _ in live])) if live else dealt
    rest = rest.select(*found.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k")).withColumn("rank", F.lit(None).cast("long")).drop("_k")
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (null if not drawn)."""
    return ranked(scores(docs, target, order, buckets, seed), percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank", "_a", "_b")


def drawn(docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that resample() drew, and times: how many of the
    row's copies were drawn. A row that is repeated comes once."""
    picked = sampled.filter("rank IS NOT NULL").groupBy(F.col("doc_id").alias("_id"), "_a", "_b").agg(F.count("*").alias("times"))
    kept = [c for c in docs.columns if c.lower() not in {"times", "_a", "_b", "_id"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64("text").alias("_a"), F.xxhash64("text", F.lit("b")).alias("_b"))
    rows = rows.withColumn("_id", F.col("doc_id"))
    return rows.join(picked, ["_id", "_a", "_b"]).dropDuplicates(["_id", "_a", "_b"]).select(*[F.col(f"`{c}`") for c in kept], "times")


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}') AS w
  FROM documents),
dw AS MATERIALIZED (SELECT rid, unnest(w) AS word FROM d),
bw AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}')) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
named AS (
  SELECT word, list_reduce(
           list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: CAST(('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
           lambda c, e: xor(c // 256, t[CAST(xor(c % 256, e) + 1 AS INTEGER)])) AS c
  FROM vocabulary, crc),
bucket AS MATERIALIZED (SELECT word, xor(c, 4294967295) % 10000 AS b FROM named),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
totals AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS ds, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS dt),
gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ds + 10000) / ((s + 1.0::DOUBLE) * (dt + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b), totals),
weighed AS (SELECT rid, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY rid),
hashed AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         (CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u
  FROM d LEFT JOIN weighed USING (rid)),
scored AS (SELECT rid, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM hashed),
placed AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS r, (SELECT count(*) FROM scored WHERE n_features >= 20) AS n
  FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN placed USING (rid)
"""
