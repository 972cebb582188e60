"""What kind of evidence a source is: research and security classes, tiers, groups and roles, as Column expressions.

A source has a kind (official_docs, package_registry, security_advisory, release_notes, news,
tutorial, forum, reference, issue_thread, pull_request, source_file, source_repository,
repository_root, source_directory, tag, commit or unknown), a URL, a title, a snippet and the
first of its providers. Rules stand in order, and the first that fits wins; texts are compared
in lower case, and a null text counts as empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of URLs and titles that tell a class.
PAPERS = ["arxiv.org", "acm.org", "ieee.org"]
INDEXES = ["doi.org", "semanticscholar.org", "openalex.org", "crossref.org"]
SPECS = ["ietf.org", "w3.org", "rfc-editor.org", ".rfc", "/rfc"]
COMMUNITY = ["stackoverflow.com", "reddit.com", "forum."]
DOCS = ["docs.rs", "doc.rust-lang.org", "developer.mozilla.org", "go.dev", "pkg.go.dev", "doc.python.org", "docs.python.org"]
REGISTRIES = ["crates.io", "npmjs.com", "pypi.org"]
ADVISORIES = ["osv.dev", "nvd.nist.gov", "github.com/advisories"]
PROPOSALS = ["rfc", "proposal", "design doc", "architecture decision", "adr"]
DOUBTS = ["drawback", "limitation", "tradeoff", "criticism"]
FORGES = ["github.com", "gitlab.com"]
CODE_KINDS = ["source_file", "source_repository", "repository_root", "source_directory", "tag", "commit"]

# Tiers of security sources in order, and what their URLs hold.
SECURITY_TIERS = {
    "primary_advisory": ["nvd.nist.gov", "osv.dev", "rustsec.org", "cve.mitre.org", "cwe.mitre.org"],
    "package_registry_advisory": ["github.com/advisories", "ghsa", "security.snyk.io"],
    "vendor_advisory": ["advisory"],
    "release_notes": ["release", "changelog"],
    "maintainer_discussion": [],
    "security_research": ["exploit", "poc", "proof-of-concept", "research", "analysis"],
    "community_discussion": ["stackoverflow.com", "stackexchange.com", "forum", "discourse", "reddit.com"],
    "news_or_blog": ["blog", "news", "medium.com", "dev.to"],
}
#: The order in which the best tier of several sources is chosen, and what is said of it.
BEST_TIERS = {
    "primary_advisory": "results include primary advisory sources",
    "package_registry_advisory": "results include package registry advisory sources",
    "vendor_advisory": "results include vendor advisory sources",
    "maintainer_discussion": "results include maintainer discussion sources",
    "release_notes": "results include release notes",
    "security_research": "results include security research sources",
    "community_discussion": "results include community discussion sources",
    "news_or_blog": "results include news or blog sources only",
}
LOW_TIER = "only low-tier sources found; results may lack advisory authority"
LOW_TIERS = ["community_discussion", "news_or_blog", "unknown"]

# What a class says of a source.
NOTES = {
    "official_docs": "official docs", "reference_docs": "reference documentation", "repository_source": "repository source", "maintainer_issue": "maintainer issue",
    "release_notes": "release notes", "benchmark": "benchmark data", "paper": "academic paper", "standard_spec": "standards specification",
    "security_advisory": "security advisory", "vendor_blog": "vendor blog", "engineering_blog": "engineering blog", "forum_thread": "community forum",
    "news_article": "news article", "unknown": "unclassified source",
}
SIGNAL_NOTES = {"maintained_current": "maintained", "commit_pinned": "commit-pinned", "primary_source": "primary source", "peer_reviewed": "peer-reviewed", "stale_source": "potentially stale"}
STALE_YEARS = range(2015, 2025)

# Roles of evidence.
KIND_ROLES = {
    "security_advisory": "authoritative_security_advisory", "official_docs": "official_documentation", "tutorial": "official_documentation",
    "package_registry": "manifest_or_dependency_metadata", "source_repository": "primary_implementation", "repository_root": "primary_implementation",
    "source_directory": "primary_implementation", "source_file": "primary_implementation", "commit": "primary_implementation",
    "issue_thread": "issue_or_incident_discussion", "pull_request": "pull_request_or_design_review", "release_notes": "release_note_or_changelog",
    "tag": "release_note_or_changelog", "reference": "interface_or_api_definition", "news": "community_discussion", "forum": "community_discussion",
}
FILE_ROLES = {
    "implementation": "primary_implementation", "generated": "primary_implementation", "test": "test_or_behavioral_specification", "example": "usage_example",
    "benchmark": "benchmark_or_performance_evidence", "configuration": "configuration_or_feature_gate", "build": "configuration_or_feature_gate",
    "ci": "configuration_or_feature_gate", "documentation": "official_documentation", "readme": "official_documentation", "changelog": "release_note_or_changelog",
    "migration": "migration_guidance", "manifest": "manifest_or_dependency_metadata", "lockfile": "manifest_or_dependency_metadata",
    "security_policy": "authoritative_security_advisory", "vendor": "unknown_or_weak_context", "unknown": "unknown_or_weak_context",
}
LABEL_ROLES = {
    "advisory": "authoritative_security_advisory", "security": "authoritative_security_advisory", "vendor": "vendor_security_guidance", "defensive": "configuration_or_feature_gate",
    "source": "primary_implementation", "code": "primary_implementation", "issues": "issue_or_incident_discussion", "releases": "release_note_or_changelog",
    "changelog": "release_note_or_changelog", "docs": "official_documentation", "documentation": "official_documentation", "examples": "usage_example",
    "registry": "manifest_or_dependency_metadata", "packages": "manifest_or_dependency_metadata", "benchmarks": "benchmark_or_performance_evidence",
    "research": "independent_corroboration", "academic": "independent_corroboration", "exact_phrase": "primary_implementation", "error_exact": "primary_implementation",
    "error_code": "issue_or_incident_discussion", "error_package": "manifest_or_dependency_metadata", "error_issues": "issue_or_incident_discussion",
    "error_releases": "release_note_or_changelog", "error_docs": "official_documentation",
}
WEAK = "unknown_or_weak_context"

# Kinds of a claim that a group of sources makes.
CLAIMS = {
    "benchmarks": "performance", "security_considerations": "security", "issue_threads": "maintenance", "release_notes": "maintenance",
    "community_discussion": "ecosystem", "recent_news": "ecosystem", "unknown": "unknown",
}


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def holds(text: Column, parts: list[str]) -> Column:
    """Whether a text contains any of the parts."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def named(values: dict[str, str], key: Column, other: Column | str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if other is None else F.coalesce(found, F.lit(other) if isinstance(other, str) else other)


def research_class(kind: Column, url: Column, title: Column, is_pull_request: Column) -> Column:
    u, t = low(url), low(title)
    benchmark = holds(u, ["benchmark"]) | holds(t, ["benchmark", "performance comparison"])
    return (
        F.when(kind == "official_docs", "official_docs")
        .when(kind == "package_registry", "reference_docs")
        .when(kind == "security_advisory", "security_advisory")
        .when(kind == "release_notes", "release_notes")
        .when(kind == "news", "news_article")
        .when((kind == "tutorial") & ~holds(u, ["dev.to", "medium.com"]) & holds(u, ["blog."]), "vendor_blog")
        .when(kind.isin("tutorial", "pull_request"), "engineering_blog")
        .when(kind == "forum", "forum_thread")
        .when(kind == "reference", F.when(holds(u, [*SPECS, "whatwg.org"]), "standard_spec").otherwise("reference_docs"))
        .when(kind == "issue_thread", F.when(F.coalesce(is_pull_request, F.lit(False)), "engineering_blog").otherwise("maintainer_issue"))
        .when(kind.isin(CODE_KINDS), "repository_source")
        .when(holds(u, PAPERS), "paper")
        .when(holds(u, SPECS), "standard_spec")
        .when(benchmark, "benchmark")
        .when(holds(u, COMMUNITY), "forum_thread")
        .when(holds(u, ["github.com/blog", "github.blog"]), "engineering_blog")
        .otherwise("unknown")
    )


def quality_signals(klass: Column, url: Column) -> Column:
    """Signals of a class, and of a commit or an old year in the URL, in order."""
    u = low(url)
    path = F.substring_index(u, "?", 1)
    pinned = (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) >= 4) & path.rlike("(?:^|/)[0-9a-f]{40}(?:/|$)")
    listed = lambda *xs: F.array(*[F.lit(x) for x in xs])
    own = (
        F.when(klass.isin("official_docs", "standard_spec"), listed("primary_source", "maintained_current"))
        .when(klass == "security_advisory", listed("primary_source", "version_specific"))
        .when(klass == "benchmark", listed("reproducible_benchmark"))
        .when(klass == "paper", listed("peer_reviewed"))
        .when(klass == "repository_source", F.when(pinned, listed("commit_pinned")).otherwise(listed("maintained_current")))
        .when(klass.isin("maintainer_issue", "engineering_blog"), listed("maintainer_authored"))
        .when(klass == "vendor_blog", listed("marketing_source"))
        .when(klass == "forum_thread", listed("secondary_source", "anecdotal_source"))
        .when(klass == "news_article", listed("secondary_source"))
        .otherwise(F.array().cast("array<string>"))
    )
    stale = holds(u, [f"/{y}/" for y in STALE_YEARS])
    return F.concat(own, F.when(stale, listed("stale_source")).otherwise(F.array().cast("array<string>")))


def evidence_notes(klass: Column, signals: Column) -> Column:
    said = [F.when(F.array_contains(signals, s), F.lit(n)) for s, n in SIGNAL_NOTES.items()]
    return F.array_compact(F.array(named(NOTES, klass), *said))


def evidence_tier(kind: Column, url: Column, title: Column, provider: Column) -> Column:
    """How good a source's evidence is for research."""
    u, t = low(url), low(title)
    forge = holds(u, FORGES)
    maintainer = F.when(forge | F.coalesce(provider.isin("github_code", "github_issues", "github_releases"), F.lit(False)), "maintainer_primary").otherwise("unknown")
    return (
        F.when(kind == "official_docs", "official_primary")
        .when(kind == "package_registry", "package_registry")
        .when(kind == "security_advisory", "security_advisory")
        .when(kind == "news", "news_or_press")
        .when(kind == "tutorial", "blog_or_tutorial")
        .when(kind == "forum", "community_discussion")
        .when(kind == "reference", "standards_or_specification")
        .when(kind == "release_notes", F.when(forge, "vendor_primary").otherwise("unknown"))
        .when(kind.isin(*CODE_KINDS, "issue_thread", "pull_request"), maintainer)
        .when(holds(u, PAPERS + INDEXES), "academic_or_formal")
        .when(holds(u, [*SPECS, "whatwg.org"]), "standards_or_specification")
        .when(holds(u, DOCS), "official_primary")
        .when(holds(u, REGISTRIES), "package_registry")
        .when(provider.eqNullSafe(F.lit("osv")) | holds(u, ADVISORIES), "security_advisory")
        .when(holds(u, ["benchmark"]) | holds(t, ["benchmark", "performance comparison"]), "benchmark_or_measurement")
        .when(holds(u, COMMUNITY), "community_discussion")
        .otherwise("unknown")
    )


def research_group(kind: Column, url: Column, title: Column, snippet: Column, is_pull_request: Column) -> Column:
    u, said = low(url), F.concat(low(title), F.lit(" "), low(snippet))
    return (
        F.when(kind == "official_docs", "official_docs")
        .when(kind == "package_registry", "unknown")
        .when(kind == "security_advisory", "security_considerations")
        .when(kind == "release_notes", "release_notes")
        .when(kind == "news", "recent_news")
        .when(kind.isin("tutorial", "forum"), "community_discussion")
        .when(kind == "reference", F.when(holds(u, ["ietf.org", "w3.org", "whatwg.org", ".rfc", "/rfc"]), "specifications").otherwise("official_docs"))
        .when(kind == "pull_request", "design_discussions")
        .when(kind == "issue_thread", F.when(F.coalesce(is_pull_request, F.lit(False)) | holds(said, PROPOSALS), "design_discussions").otherwise("issue_threads"))
        .when(kind.isin(CODE_KINDS), "reference_implementations")
        .when(holds(u, PAPERS + INDEXES), "academic_or_formal_sources")
        .when(holds(u, SPECS), "specifications")
        .when(holds(u, ["benchmark"]) | holds(said, ["benchmark", "performance"]), "benchmarks")
        .when(holds(said, DOUBTS), "counterpoints")
        .when(holds(u, COMMUNITY), "community_discussion")
        .otherwise("unknown")
    )


def security_tier(url: Column) -> Column:
    u = low(url)
    discussed = holds(u, FORGES) & holds(u, ["/issues/", "/pull/"])
    out = F
    for tier, parts in SECURITY_TIERS.items():
        out = out.when(discussed if tier == "maintainer_discussion" else holds(u, parts), tier)
    return out.otherwise("unknown")


def best_tier(tiers: Column) -> Column:
    """struct(tier, reasons) of an array of tiers: the best there is, and a warning where it is a low one."""
    best = F
    for tier in BEST_TIERS:
        best = best.when(F.array_contains(tiers, tier), tier)
    best = best.otherwise("unknown")
    return F.struct(best.alias("tier"), F.array_compact(F.array(named(BEST_TIERS, best), F.when(best.isin(LOW_TIERS), F.lit(LOW_TIER)))).alias("reasons"))


def security_group(kind: Column, url: Column) -> Column:
    u = low(url)
    return (
        F.when(holds(u, ["cisa.gov", "known-exploited-vulnerabilities"]), "kev_entries")
        .when(holds(u, ["osv.dev", "nvd.nist.gov", "github.com/advisories", "ghsa", "rustsec.org", "rust advisory"]), "authoritative_advisories")
        .when(holds(u, ["advisory", "/security/advisories"]) | F.coalesce(kind == "security_advisory", F.lit(False)), "vendor_advisories")
        .when(holds(u, ["/commit/", "/pull/", "release", "changelog"]), "patch_commits_or_releases")
        .when(holds(u, ["exploit", "proof-of-concept", "metasploit"]) | u.rlike("(?:^|[^a-z0-9])poc(?:[^a-z0-9]|$)"), "exploit_discussion")
        .when(holds(u, ["mitigation", "hardening", "defensive", "best-practice"]), "defensive_guidance")
        .when(holds(u, ["/issues/"]) & holds(u, FORGES), "package_advisories")
        .otherwise("general_context")
    )


def evidence_role(explicit: Column, file_role: Column, kind: Column) -> Column:
    """The role a source was given, else that of its file, else that of its kind."""
    return F.coalesce(explicit, named(FILE_ROLES, file_role), named(KIND_ROLES, kind), F.lit(WEAK))


def intended_role(provider: Column, label: Column) -> Column:
    """The role that a provider is asked for by a subquery of that label."""
    by_provider = (
        F.when((provider == "osv") | F.contains(provider, F.lit("advisory")), "authoritative_security_advisory")
        .when(F.contains(provider, F.lit("code")) | F.contains(provider, F.lit("repo")), "primary_implementation")
        .otherwise(WEAK)
    )
    return named(LABEL_ROLES, label, by_provider)


def claim_type(group: Column) -> Column:
    return named(CLAIMS, group, "architecture")
