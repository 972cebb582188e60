"""Which providers a request asks for what: routing, jobs, and what the providers came to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Providers that are preferred for an intent, in order.
PREFERRED = {
    "code": ["github_code", "gitlab_code", "gitea_code", "sourcegraph"],
    "issues": ["github_issues", "gitlab_issues", "gitea_issues", "firecrawl_developer"],
    "releases": ["github_releases", "gitlab_releases", "gitea_releases"],
    "security": ["osv", "github_advisory", "nvd"],
    "news": ["tavily", "brave_api"],
}


def routed(requests: DataFrame, providers: DataFrame, most: int = 2) -> DataFrame:
    """query_id, place, provider, disposition: what becomes of each provider that a request's intent prefers.

    requests: query_id, intent, selected (array); providers: provider, enabled, built, cooling, capable.
    The first reason that holds is told; of those that nothing speaks against, ``most`` are added."""
    preferred = F.create_map(*[x for i, ps in PREFERRED.items() for x in (F.lit(i), F.array(*[F.lit(p) for p in ps]))])
    asked = requests.select("query_id", "selected", F.posexplode(F.try_element_at(preferred, F.col("intent"))).alias("place", "provider"))
    met = asked.join(F.broadcast(providers), "provider", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.array_contains("selected", F.col("provider")), "already_selected")
        .when(no("enabled"), "not_enabled")
        .when(no("built"), "not_built")
        .when(~no("cooling"), "cooling_down")
        .when(no("capable"), "capability_missing")
    )
    free = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("query_id").orderBy("place"))
    told = met.withColumn("reason", reason).withColumn("free", free)
    return told.select("query_id", "place", "provider", F.coalesce("reason", F.when(F.col("free") <= most, "added").otherwise("cap_exceeded")).alias("disposition"))


def jobs(subqueries: DataFrame, providers: list[str], supported: DataFrame) -> DataFrame:
    """query_id, place, label, provider, disposition: every subquery for every provider, in the order
    in which they are sent. A subquery asks for roles; a provider supports all, some or none.

    Subqueries are dealt by request before they are multiplied, and what the few providers support goes to
    every task: a join on provider would have as many groups as there are providers.
    subqueries: query_id, priority, subquery_no, label, roles (array); supported: provider, role."""
    each = F.posexplode(F.array(*[F.lit(p) for p in providers])).alias("provider_no", "provider")
    sent = subqueries.repartition("query_id").withColumn("roles", F.array_distinct("roles")).select("*", each)
    able = F.broadcast(supported.groupBy("provider").agg(F.collect_set("role").alias("able")))
    met = sent.join(able, "provider", "left").withColumn("can", F.size(F.array_intersect("roles", F.coalesce("able", F.array().cast("array<string>")))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "subquery_no", "provider_no"))
    disposition = F.when(F.col("can") == F.size("roles"), "fully_supported").when(F.col("can") > 0, "partially_supported").otherwise("unsupported")
    return met.select("query_id", place.alias("place"), "label", "provider", disposition.alias("disposition"))


def provider_outcomes(asked: DataFrame, cards: DataFrame, failures: DataFrame) -> DataFrame:
    """query_id, provider, absence: what a provider came to where no calls are on record.

    asked: query_id, provider; cards: query_id, providers (array); failures: query_id, provider, class."""
    gave = cards.select("query_id", F.explode("providers").alias("provider")).distinct().withColumn("gave", F.lit(True))
    failed = failures.groupBy("query_id", "provider").agg(F.min_by("class", "pos").alias("class"))
    met = asked.join(gave, ["query_id", "provider"], "left").join(failed, ["query_id", "provider"], "left")
    absence = F.when(F.col("gave"), "not_applicable").when(F.col("class") == "timeout", "deadline_prevented_completion").when(F.col("class").isNotNull(), "provider_failed").otherwise("provider_skipped_by_policy")
    return met.select("query_id", "provider", absence.alias("absence"))


def lane_coverage(lanes: DataFrame) -> DataFrame:
    """query_id, planned, completed, cards; lanes: query_id, completed, cards."""
    return lanes.groupBy("query_id").agg(F.count("*").alias("planned"), F.count_if("completed").alias("completed"), F.sum("cards").alias("cards"))


def latencies(calls: DataFrame) -> DataFrame:
    """Of each provider: calls, successes, failures, mean and largest duration. calls: provider, outcome, duration_ms."""
    return calls.groupBy("provider").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") != "failed").alias("succeeded"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("longest_ms"),
    )


def boosted_by_hints(cards: DataFrame) -> DataFrame:
    """query_id, group, place, pos, score: cards of a group in the order of their scores, raised by what
    of the request's hints they hold. A unit is a tenth of the best score of the group.

    cards: query_id, group, pos, score, url, title, path, language, kind, provider, confidence,
    authority, strength and the hints owner, repo, hint_path, hint_file, hint_language, symbol."""
    has = lambda text, part: F.coalesce((F.lower(F.col(part)) != "") & F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(part))), F.lit(False))
    is_ = lambda c, *vs: F.coalesce(F.col(c).isin(*vs), F.lit(False))
    units = [
        (F.col("owner").isNotNull() & F.col("repo").isNotNull() & has("url", "owner") & has("url", "repo"), 1.5),
        (has("path", "hint_path"), 1.0),
        (has("path", "hint_file"), 1.0),
        (F.coalesce(F.lower("language") == F.col("hint_language"), F.lit(False)), 0.5),
        (has("title", "symbol"), 1.0),
        (F.lower(F.col("provider")).isin("github_issues", "github_releases"), 0.5),
        (is_("kind", "official_docs", "reference"), 1.0),
        (is_("kind", "package_registry", "release_notes", "tag", "security_advisory"), 0.5),
        (is_("confidence", "high"), 0.5),
        (is_("strength", "exact_code_span", "exact_identifier"), 0.5),
        (is_("authority", "official", "primary"), 0.3),
    ]
    total = sum((F.when(F.coalesce(c, F.lit(False)), u).otherwise(0.0) for c, u in units), F.lit(0.0))
    finite = F.when(~F.isnan("score") & ~F.abs("score").isin(float("inf")), F.col("score"))
    best = F.max(finite).over(Window.partitionBy("query_id", "group"))
    raised = F.when((F.col("best") > 0) & (F.col("units") > 0), F.coalesce("score", F.lit(0.0)) + F.col("units") * F.col("best") * 0.1).otherwise(F.col("score"))
    out = cards.withColumns({"units": total, "best": best}).withColumn("raised", F.round(raised, 9))
    place = F.row_number().over(Window.partitionBy("query_id", "group").orderBy(F.desc_nulls_last("raised"), "pos"))
    return out.select("query_id", "group", place.alias("place"), "pos", F.col("raised").alias("score"))


# Kinds of failure by the outcome of an attempt, and what is said of the provider.
FAILURES = {
    "failed": ("provider_failed", "failed"), "timed_out": ("deadline_prevented_completion", "timed out"), "rate_limited": ("provider_failed", "rate limited"),
    "interrupted_by_deadline": ("deadline_prevented_completion", "interrupted by global deadline"), "skipped_by_policy": ("provider_skipped_by_policy", "skipped by policy"),
    "skipped_capability_unavailable": ("provider_capability_unavailable", "lacks the requested capability"),
}
CLASSED = ["failed", "timed_out", "rate_limited"]


def failures(attempts: DataFrame) -> DataFrame:
    """attempt_id, kind, role, message: a row for each distinct role that an attempt was for, where it
    did not come to a result. attempts: attempt_id, provider, outcome, roles (array), class."""
    table = lambda k: F.create_map(*[F.lit(x) for o, v in FAILURES.items() for x in (o, v[k])])
    told = F.concat(F.when(F.col("outcome").isin(CLASSED) & F.col("class").isNotNull(), F.concat(F.lit("["), "class", F.lit("] "))).otherwise(""), F.lit("provider "), F.col("provider"), F.lit(" "), F.try_element_at(table(1), F.col("outcome")))
    roles = F.when(F.coalesce(F.size("roles"), F.lit(0)) > 0, F.array_distinct("roles")).otherwise(F.array(F.lit("unknown_or_weak_context")))
    return attempts.filter(F.col("outcome").isin(*FAILURES)).select("attempt_id", F.try_element_at(table(0), F.col("outcome")).alias("kind"), F.explode(roles).alias("role"), told.alias("message"))


def deadlines(jobs: DataFrame) -> DataFrame:
    """query_id, completed, partial, interrupted, skipped, exceeded: subqueries of a request by what they
    came to at its deadline: all jobs ended; none running and some not begun; else interrupted, partly
    completed if any job ended. jobs: query_id, subquery, state (ended, running or pending)."""
    each = jobs.groupBy("query_id", "subquery").agg(
        F.bool_and(F.col("state") == "ended").alias("whole"),
        F.bool_or(F.col("state") == "ended").alias("some"),
        F.bool_or(F.col("state") == "running").alias("runs"),
        F.bool_or(F.col("state") == "pending").alias("waits"),
    )
    skipped = ~F.col("whole") & F.col("waits") & ~F.col("runs")
    cut = ~F.col("whole") & ~skipped
    return each.groupBy("query_id").agg(
        F.count_if("whole").alias("completed"), F.count_if(cut & F.col("some")).alias("partial"), F.count_if(cut).alias("interrupted"), F.count_if(skipped).alias("skipped"), F.bool_or(~F.col("whole")).alias("exceeded")
    )
