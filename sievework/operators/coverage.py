"""Which evidence roles a request's workflow needs, which were found, and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workflow, roles it requires, roles it recommends.
MODELS = {
    "api_comprehension": ("interface implementation", "docs usage_example test"),
    "repo_architecture": ("implementation architecture", "docs config manifest"),
    "error_investigation": ("issue implementation", "docs test"),
    "version_migration": ("release_note migration", "docs issue"),
    "security_review": ("advisory vendor_guidance", "implementation config manifest"),
    "dependency_evaluation": ("manifest", "docs release_note advisory"),
    "performance_investigation": ("benchmark", "implementation docs corroboration"),
    "comparative_research": ("docs implementation", "benchmark corroboration counterpoint"),
    "pre_change_evidence": ("implementation test", "docs config"),
    "post_change_review": ("test", "implementation docs config"),
    "generic": ("implementation", "docs"),
}
# Failures that hide a required role, and one that always does.
HIDING = ["provider_failed", "deadline", "capability_unavailable", "skipped_by_policy"]
UNAVAILABLE = ["capability_unavailable", "skipped_by_policy"]
INDETERMINATE = "role_indeterminate"


def needs(spark: SparkSession) -> DataFrame:
    """model, role, need: some fifty rows, whatever the data."""
    rows = [(m, r, need) for m, both in MODELS.items() for need, roles in zip(("required", "recommended"), both) for r in roles.split()]
    return spark.createDataFrame(rows, "model string, role string, need string")


def covered(requests: DataFrame, found: DataFrame, failures: DataFrame) -> DataFrame:
    """One row for each request: status, confidence (0.6 for the share of required roles found, 0.3 of
    recommended ones, 0.1 as no model has optional ones), and the missing roles of both kinds.

    requests: query_id, model; found: query_id, role; failures: query_id, role, kind. A request is
    indeterminate, not insufficient, where a failure may have hidden a required role. Roles found and
    failures are pre-aggregated to (query_id, role), so no hot request meets a wide join."""
    need = requests.join(F.broadcast(needs(requests.sparkSession)), "model")
    have = found.filter("role is not null").groupBy("query_id", "role").agg(F.lit(True).alias("has"))
    bad = failures.groupBy("query_id", "role").agg(
        F.max(F.col("kind").isin(HIDING)).alias("hidden"), F.max(F.col("kind").isin(UNAVAILABLE)).alias("unavailable")
    )
    whole = failures.filter(F.col("kind") == INDETERMINATE).groupBy("query_id").agg(F.lit(True).alias("unsure"))
    req, rec, has = F.col("need") == "required", F.col("need") == "recommended", F.coalesce("has", F.lit(False))
    missing = lambda which: F.array_sort(F.collect_list(F.when(which & ~has, F.col("role"))))
    out = (
        need.join(have, ["query_id", "role"], "left")
        .join(bad, ["query_id", "role"], "left")
        .groupBy("query_id", "model")
        .agg(
            missing(req).alias("missing_required"),
            missing(rec).alias("missing_recommended"),
            F.count_if(req).alias("n_req"),
            F.count_if(rec).alias("n_rec"),
            F.max(req & F.coalesce("unavailable", F.lit(False))).alias("unavailable"),
            F.max(req & F.coalesce("hidden", F.lit(False))).alias("hidden"),
        )
        .join(whole, "query_id", "left")
    )
    n_req, n_rec = F.size("missing_required"), F.size("missing_recommended")
    status = (
        F.when(F.coalesce("unsure", F.lit(False)) | F.col("unavailable"), "indeterminate")
        .when((n_req == 0) & (n_rec == 0), "sufficient")
        .when(n_req == 0, "usable_with_gaps")
        .when(F.col("hidden"), "indeterminate")
        .otherwise("insufficient")
    )
    share = 0.6 * (F.col("n_req") - n_req) / F.col("n_req") + 0.3 * (F.col("n_rec") - n_rec) / F.col("n_rec") + 0.1
    return out.select("query_id", "model", status.alias("status"), F.round(share, 9).alias("confidence"), "missing_required", "missing_recommended")


# The tool that fills a role best.
TOOLS = {
    "implementation": "repo_search", "interface": "web_search", "usage_example": "web_search", "test": "repo_search", "docs": "web_search", "issue": "repo_search",
    "release_note": "repo_search", "migration": "web_search", "advisory": "security_search", "vendor_guidance": "security_search", "benchmark": "research_search",
}


def next_actions(coverage: DataFrame, most: int = 5) -> DataFrame:
    """query_id, place, tool, role: the first ``most`` actions, for required roles before recommended ones."""
    tools = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    act = lambda c, rank: F.transform(c, lambda r: F.struct(F.lit(rank).alias("rank"), r.alias("role")))
    acts = F.slice(F.concat(act("missing_required", 0), act("missing_recommended", 1)), 1, most)
    return coverage.select("query_id", F.posexplode(acts).alias("place", "a")).select(
        "query_id", (F.col("place") + 1).alias("place"), F.coalesce(F.try_element_at(tools, F.col("a.role")), F.lit("web_search")).alias("tool"), F.col("a.role").alias("role")
    )
