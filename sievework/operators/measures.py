"""Judged retrieval metrics and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, judged: DataFrame, n: int = 5) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at n for each query.

    ranked: query_id, key, place; judged: query_id, key, grade (over 0: relevant)."""
    gain = lambda g, place: (F.pow(F.lit(2.0), g) - 1) / F.log2(place + F.lit(1.0))
    found = ranked.filter(F.col("place") <= n).join(judged, ["query_id", "key"], "left").groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("place"))).alias("first"),
        F.sum(F.coalesce(gain(F.col("grade"), F.col("place")), F.lit(0.0))).alias("dcg"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    ideal = judged.filter("grade > 0").withColumn("place", F.row_number().over(best)).groupBy("query_id").agg(
        F.count("*").alias("relevant"),
        F.sum(F.when(F.col("place") <= n, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("ideal"),
    )
    return found.join(ideal, "query_id").select(
        "query_id",
        F.round(F.col("hits") / n, 9).alias("precision"),
        F.round(F.col("hits") / F.least("relevant", F.lit(n)), 9).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.col("dcg") / F.col("ideal"), 9).alias("ndcg"),
    )


def wilson(hits, trials, z: float = 1.959963984540054):
    """(low, high): the 95 % interval of a share."""
    p = hits / trials
    middle, half = p + z * z / (2 * trials), z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return (middle - half) / (1 + z * z / trials), (middle + half) / (1 + z * z / trials)


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """For each provider: attempts by outcome, the share that completed with its 95 % interval, and times."""
    done = attempts.groupBy("provider").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "success").alias("succeeded"),
        F.count_if(F.col("outcome") == "zero_results").alias("zero_results"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    low, high = wilson(F.col("succeeded") + F.col("zero_results"), F.col("attempts"))
    return done.withColumns({"low": F.round(low, 9), "high": F.round(high, 9)})


def dimensions(states: DataFrame) -> DataFrame:
    """Of each query_id, from rows (query_id, role, state, truncation): distinct roles attempted,
    complete and indeterminate, dimensions by what they came to, and whether any failed or was cut."""
    kind = lambda *s: F.col("state").isin(*s)
    roles = lambda c: F.count_distinct(F.when(c, F.col("role")))
    cut = F.coalesce(F.col("truncation").isin("confirmed_by_engine", "confirmed_by_provider"), F.lit(False))
    failed = kind("failed", "interrupted")
    return states.groupBy("query_id").agg(
        F.count_distinct("role").alias("roles_attempted"),
        roles(kind("satisfied", "completed_no_match")).alias("roles_complete"),
        roles(failed | kind("skipped_by_policy", "capability_unavailable", "partial")).alias("roles_indeterminate"),
        F.count("*").alias("attempted"),
        F.count_if(kind("satisfied", "completed_no_match", "partial", "not_applicable")).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.count_if(kind("not_applicable")).alias("not_applicable"),
        F.bool_or(failed).alias("has_failures"),
        F.bool_or(kind("partial") | cut).alias("has_truncation"),
    )


def first_warnings(warnings: DataFrame) -> DataFrame:
    """The first by pos of the warnings of a query_id that share code and set of providers."""
    keyed = warnings.withColumn("key", F.array_sort("providers"))
    rest = F.struct("pos", *[F.col(c) for c in warnings.columns if c not in ("query_id", "code", "pos")])
    return keyed.groupBy("query_id", "code", "key").agg(F.min_by(rest, "pos").alias("w")).select("query_id", "code", "w.*")
