"""Links between fetched pages and sources, ledgers, range verdicts, and slices of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import urls


def linked(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """The source of each fetch: that of its explicit id, else the first of its URL key.

    fetches: fetch_id, source_id (or null), url; sources: source_id, url, place. Two equi-joins;
    sources of a key are reduced to the first before they are joined, so no fetch meets a crowd."""
    first = sources.withColumn("key", urls.dedup_key(F.col("url"))).filter("key is not null").groupBy("key").agg(F.min_by("source_id", F.struct("place", "source_id")).alias("by_key"))
    known = sources.select(F.col("source_id").alias("by_id")).distinct()
    return (
        fetches.withColumn("key", urls.dedup_key(F.col("url")))
        .join(known, F.col("source_id") == F.col("by_id"), "left")
        .join(first, "key", "left")
        .select("fetch_id", F.coalesce("by_id", "by_key").alias("source_id"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_key").isNotNull(), "url").alias("link"))
    )


def repeated(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one terminal attempt."""
    return ledger.filter("outcome in ('success', 'failed', 'zero_results')").groupBy(*keys).count().filter("count > 1").withColumnRenamed("count", "attempts")


def combined(verdicts: DataFrame, key: str) -> DataFrame:
    """One verdict for each key: affected over unknown over not affected."""
    rank = F.when(F.col("verdict") == "affected", 2).when(F.col("verdict") == "not_affected", 0).otherwise(1)
    best = F.max(rank)
    return verdicts.groupBy(key).agg(F.element_at(F.array(F.lit("not_affected"), F.lit("unknown"), F.lit("affected")), best + 1).alias("verdict"), F.count("*").alias("n_ranges"))


def recent(rows: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows from ``days`` before as_of on; later ones than as_of stay too."""
    return rows.filter(F.col(at) >= F.expr(f"timestamp '{as_of}' - interval {int(days)} days"))


def line_slice(text, first: int, last: int, max_chars: int):
    """Lines first to last (from 1), as many whole ones as fit into max_chars with their line ends."""
    lines = F.slice(F.split(text, "\n"), first, last - first + 1)
    sums = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("fits"), F.lit(0).alias("k")),
        lambda a, x: F.struct(
            (a["n"] + F.length(x) + 1).alias("n"),
            (a["fits"] & (a["n"] + F.length(x) + 1 <= max_chars + 1)).alias("fits"),
            (a["k"] + F.when(a["fits"] & (a["n"] + F.length(x) + 1 <= max_chars + 1), 1).otherwise(0)).alias("k"),
        ),
    )
    return F.array_join(F.slice(lines, F.lit(1), sums["k"]), "\n")


def paragraphs(docs: DataFrame, max_chars: int) -> DataFrame:
    """doc_id, chunk, text: lines packed in order into chunks of about max_chars; the running length
    is a window over one document's lines."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line != ''")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    packed = line.withColumn("chunk", F.floor(at / max_chars).cast("long"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return packed.groupBy("doc_id", "chunk").agg(F.array_join(parts, "\n").alias("text"))
