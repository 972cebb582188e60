"""Which findings of dependencies advisories affect: joins on package, ranges, known exploits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text, versions


def range_verdict(version: Column, fixed: Column, last_affected: Column, spec: Column) -> Column:
    """affected, not_affected or unknown of one range: a version among the fixed ones is not affected;
    then a list of last affected ones, where there is one, decides alone; then the range expression."""
    inside = versions.in_range(version, spec)
    return (
        F.when(version.isNull(), "unknown")
        .when(F.coalesce(F.array_contains(fixed, version), F.lit(False)), "not_affected")
        .when(F.coalesce(F.size(last_affected), F.lit(0)) > 0, F.when(F.array_contains(last_affected, version), "affected").otherwise("not_affected"))
        .otherwise(F.coalesce(F.element_at(F.create_map(F.lit(True), F.lit("affected"), F.lit(False), F.lit("not_affected")), inside), F.lit("unknown")))
    )


def applicable(findings: DataFrame, advisories: DataFrame, exploited: DataFrame) -> DataFrame:
    """finding_id, advisory_id, verdict, confidence, known_exploited: a row for each finding and
    advisory of its package.

    findings: finding_id, ecosystem, name, version; advisories: advisory_id (unique), ecosystem, name and
    ranges (fixed, last_affected, spec), all windows of an advisory in one row; exploited:
    advisory_id. Judging takes longest, so each distinct version is judged once against each distinct set of
    ranges, by whichever package and advisory it comes up; findings meet their advisories by equality on
    ecosystem and canonical name, and the verdicts by equality on version and set; which side is broadcast
    is left to the optimizer. Over the windows affected wins, then unknown; an advisory without ranges is unknown.
    Confidence is high for one window, medium for several, low for none."""
    keyed = lambda d: d.withColumn("package", text.package_name(F.col("ecosystem"), F.col("name"))).drop("name")
    known = exploited.select("advisory_id").distinct().withColumn("known_exploited", F.lit(True))
    each = F.transform("ranges", lambda r: range_verdict(F.col("version"), r["fixed"], r["last_affected"], r["spec"]))
    verdict = F.when(F.array_contains("each", "affected"), "affected").when(F.array_contains("each", "unknown") | (F.size("each") <= 0), "unknown").otherwise("not_affected")
    n = F.size("each")
    confidence = F.when(n == 1, "high").when(n > 1, "medium").otherwise("low")
    ranges = F.coalesce("ranges", F.array())
    told = keyed(advisories).withColumn("set", F.sha2(F.to_json(F.struct(ranges.alias("ranges"))), 256))
    sets = told.groupBy("set").agg(F.first("ranges").alias("ranges"))
    met = keyed(findings).join(told.join(known, "advisory_id", "left").drop("ranges"), ["ecosystem", "package"])
    judged = (
        met.select("version", "set").distinct().join(sets, "set")
        .withColumn("each", F.coalesce(each, F.array().cast("array<string>")))
        .select(F.col("version").alias("at"), F.col("set").alias("judged_set"), verdict.alias("verdict"), confidence.alias("confidence"))
    )
    out = met.join(judged, F.col("version").eqNullSafe(F.col("at")) & (F.col("set") == F.col("judged_set")))
    return out.select("finding_id", "advisory_id", "verdict", "confidence", F.coalesce("known_exploited", F.lit(False)).alias("known_exploited"))
