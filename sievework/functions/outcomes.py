"""States, classes and codes of what calls of providers came to, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.sources import named

# The state of a dimension by the outcome of the attempt at it.
STATES = {
    "success_with_results": "satisfied", "success_zero_results": "completed_no_match", "failed": "failed", "timed_out": "failed", "rate_limited": "failed",
    "skipped_by_policy": "skipped_by_policy", "skipped_capability_unavailable": "capability_unavailable", "interrupted_by_deadline": "interrupted",
    "truncated_after_partial_success": "partial", "not_applicable": "not_applicable",
}
SUCCEEDED = ["success_with_results", "success_zero_results", "not_applicable", "truncated_after_partial_success"]
FAILED = ["failed", "timed_out", "rate_limited", "interrupted_by_deadline"]

# Classes of errors of a provider, codes of its warnings, and severities other than "warning".
ERRORS = {"timeout": "timeout", "parse_failed": "parse_error", "blocked": "blocked", "http": "network_error", "network_error": "network_error", "unsupported": "unknown"}
WARNING_CODES = {"timeout": "provider_timeout", "rate_limited": "provider_rate_limited"}
PREFIXES = {"intent_routing_capability_excluded": "intent_routing_excluded"}
KNOWN_CODES = (
    "safe_search_unenforced freshness_unenforced date_range_unenforced language_unenforced region_unenforced domain_filters_local"
    " native_code_search_unavailable native_issue_search_unavailable native_release_search_unavailable native_advisory_search_unavailable"
    " symbol_hint_no_native_provider repo_hints_not_enforced_natively issue_search_no_native_provider release_search_no_native_provider"
    " coding_profile_degraded profile_degraded profile_partial profile_provider_not_built profile_provider_unknown profile_provider_unavailable"
    " provider_cooldown generic_context_untrusted local_repo_match local_repo_dirty local_repo_state_unknown local_search_timeout local_search_truncated"
    " request_deadline_exceeded kev_match kev_absent_not_proof kev_lookup_failed kev_lookup_skipped severity_unavailable version_match_unavailable"
    " version_mismatch dependency_file_read_error dependency_parse_malformed dependency_format_unsupported dependency_parse_partial"
    " dependency_file_budget_exceeded dependency_finding_budget_exceeded weak_evidence_ignored_for_exact_applicability"
    " dependency_provenance_unverified_for_advisory request_ecosystem_unassessed applicability_not_exploitability package_security_no_advisories"
    " package_security_lookup_failed package_security_skipped package_resolution_fallback"
).split()
SEVERITIES = {
    "notice": "untrusted_external_content generic_context_untrusted applicability_not_exploitability".split(),
    "error": "prompt_injection_marker_detected card_injection_marker_detected provider_failed provider_timeout kev_match kev_lookup_failed package_security_lookup_failed".split(),
    "info": "local_repo_match package_resolution".split(),
}
# Spellings of severities of advisories and their ranks.
LEVELS = {
    "critical": "critical", "crit": "critical", "high": "high", "important": "high", "medium": "medium", "moderate": "medium", "med": "medium",
    "low": "low", "minor": "low",
}
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def dimension_state(outcome: Column, truncation: Column) -> Column:
    """The state an attempt leaves a dimension in; truncation that is confirmed makes it partial."""
    return F.when(F.coalesce(truncation.isin("confirmed_by_engine", "confirmed_by_provider"), F.lit(False)), "partial").otherwise(named(STATES, outcome))


def error_class(kind: Column, status: Column, reason: Column) -> Column:
    """The class of an error of a provider: its status code or reason may tell more than its kind."""
    return (
        F.when(kind == "bad_status", F.when(status == 429, "rate_limited").otherwise("http_status"))
        .when((kind == "network_error") & F.contains(reason, F.lit("panicked during dispatch")), "panic")
        .otherwise(named(ERRORS, kind, "unknown"))
    )


def skip_code(provider: Column, enabled: Column, configured: Column, needs_key: Column, has_searxng: Column) -> Column:
    """Why a known provider is passed over; null if it is not."""
    return (
        F.when(enabled & configured, None)
        .when(~enabled, "disabled_by_user")
        .when(provider == "local_workspace", "missing_local_backend")
        .when(needs_key, "missing_api_key")
        .when(F.contains(provider, F.lit("searxng")) & ~has_searxng, "missing_searxng_config")
        .otherwise("unknown")
    )


def warning(message: Column) -> Column:
    """struct(code, severity, text) of a message "code: text" or "[error class] text"; of any other the code is unknown_warning."""
    head = F.regexp_extract(message, r"(?s)^(.*?): ", 1)
    known = F.when(head.isin(KNOWN_CODES), head).otherwise(named(PREFIXES, head))
    klass = F.regexp_extract(message, r"(?s)^\[([^\]]*)\]", 1)
    bracket = message.rlike(r"(?s)^\[[^\]]*\]")
    code = F.coalesce(known, F.when(bracket, named(WARNING_CODES, klass, "provider_failed")), F.lit("unknown_warning"))
    text = F.when(known.isNotNull(), F.substring(message, F.length(head) + 3, F.length(message))).when(bracket, F.regexp_replace(message, r"(?s)^\[[^\]]*\]\s*", "")).otherwise(message)
    severity = F
    for name, codes in SEVERITIES.items():
        severity = severity.when(code.isin(codes), name)
    return F.struct(code.alias("code"), severity.otherwise("warning").alias("severity"), text.alias("text"))


def severity(name: Column) -> Column:
    """critical, high, medium, low or unknown."""
    return named(LEVELS, F.lower(name), "unknown")


def severity_rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), level), F.lit(0))


# The state of a dimension by why evidence is absent, where no state is on record.
ABSENCES = {
    "not_applicable": "other_absence", "no_matching_evidence_found": "completed_no_match", "provider_failed": "failed", "deadline_prevented_completion": "interrupted",
    "provider_skipped_by_policy": "skipped_by_policy", "provider_capability_unavailable": "capability_unavailable", "result_truncated_by_cap": "partial",
    "evidence_role_requested_but_not_found": "completed_no_match", "evidence_role_indeterminate_because_retrieval_failed": "failed", "evidence_role_not_requested": "not_applicable",
}


def effective_state(state: Column, absence: Column) -> Column:
    """The state of a dimension, else the one that its absence stands for."""
    return F.coalesce(state, named(ABSENCES, absence))
