"""Rank fusion: hits of several providers become one list for each query.

Everything is keyed by query_id, so a query is a group of an aggregate or a window
partition; the aggregate combines on the map side, and windows see fused rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import urls

K = 60


def fuse(hits: DataFrame, k: int = K) -> DataFrame:
    """query_id, key, score, url, title, n_providers: reciprocal ranks summed over the hits of a
    key; url and title of the first hit by (provider, rank). Hits without a usable url are dropped."""
    first = F.struct("provider", "rank")
    return (
        hits.withColumn("key", urls.dedup_key(F.col("url")))
        .filter("key is not null")
        .groupBy("query_id", "key")
        .agg(
            F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
            F.min_by("url", first).alias("url"),
            F.min_by("title", first).alias("title"),
            F.count_distinct("provider").alias("n_providers"),
        )
    )


def unfused(hits: DataFrame, k: int = K) -> DataFrame:
    """Each hit on its own, scored alike."""
    return hits.select("query_id", "provider", "rank", "url", F.round(1.0 / (k + F.col("rank")), 12).alias("score"))


def in_domains(rows: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows whose host is below an included domain (if any are) and below no excluded one. A url
    without a host stays only if nothing is included."""
    host = F.coalesce(urls.host(F.col("url")), F.lit(""))
    below = lambda names: F.exists(F.array(*[F.lit(d.lower()) for d in names]), lambda d: urls.under(host, d))
    if include:
        rows = rows.filter(below(include))
    return rows.filter(~below(exclude)) if exclude else rows


def boosted(rows: DataFrame, boosts: list[tuple[str, float]]) -> DataFrame:
    """score raised by a tenth of the query's best score for each unit of the boosts that hold;
    boosts: (SQL condition, units)."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    units = sum((F.when(F.expr(c), F.lit(float(u))).otherwise(F.lit(0.0)) for c, u in boosts), F.lit(0.0))
    return rows.withColumn("score", F.round(F.col("score") + F.lit(0.1) * best * units, 12))


def top(rows: DataFrame, n: int) -> DataFrame:
    """The first n of each query by score, title and url, with their place."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("title"), F.asc("url"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
