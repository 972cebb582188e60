"""Queries over classes, tiers, groups and roles of sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import sources
from sievework.plans import cases
from sievework.plans.real import REAL

_SHA = "0123456789abcdef0123456789abcdef01234567"
#: kind, url, title, snippet, is_pull_request, provider; then research class, signals, tier, group, security group.
_SOURCES = [
    ("official_docs", "https://docs.rs/tokio", "Tokio", None, None, "searxng", "official_docs", "primary_source,maintained_current", "official_primary", "official_docs", "general_context"),
    ("package_registry", "https://crates.io/crates/serde", "serde", None, None, "crates_io", "reference_docs", "", "package_registry", "unknown", "general_context"),
    ("security_advisory", "https://vendor.example/sec/1", "SA-1", None, None, "brave", "security_advisory", "primary_source,version_specific", "security_advisory", "security_considerations", "vendor_advisories"),
    ("security_advisory", "https://osv.dev/vulnerability/x", "x", None, None, "osv", "security_advisory", "primary_source,version_specific", "security_advisory", "security_considerations", "authoritative_advisories"),
    ("release_notes", "https://github.com/a/b/releases/tag/v1", "v1", None, None, "github_releases", "release_notes", "", "vendor_primary", "release_notes", "patch_commits_or_releases"),
    ("release_notes", "https://a.example/2019/changelog", "v1", None, None, "brave", "release_notes", "stale_source", "unknown", "release_notes", "patch_commits_or_releases"),
    ("news", "https://arstechnica.com/2024/x", "News", None, None, "brave", "news_article", "secondary_source,stale_source", "news_or_press", "recent_news", "general_context"),
    ("news", "https://arstechnica.com/2025/x", "News", None, None, "brave", "news_article", "secondary_source", "news_or_press", "recent_news", "general_context"),
    ("tutorial", "https://dev.to/x", "How", None, None, "brave", "engineering_blog", "maintainer_authored", "blog_or_tutorial", "community_discussion", "general_context"),
    ("tutorial", "https://blog.rust-lang.org/x", "How", None, None, "brave", "vendor_blog", "marketing_source", "blog_or_tutorial", "community_discussion", "general_context"),
    ("tutorial", "https://blog.medium.com/x", "How", None, None, "brave", "engineering_blog", "maintainer_authored", "blog_or_tutorial", "community_discussion", "general_context"),
    ("tutorial", "https://learn.example/hardening", "How", None, None, "brave", "engineering_blog", "maintainer_authored", "blog_or_tutorial", "community_discussion", "defensive_guidance"),
    ("forum", "https://users.example/t/1", "Ask", None, None, "brave", "forum_thread", "secondary_source,anecdotal_source", "community_discussion", "community_discussion", "general_context"),
    ("reference", "https://www.IETF.org/x", "X", None, None, "brave", "standard_spec", "primary_source,maintained_current", "standards_or_specification", "specifications", "general_context"),
    ("reference", "https://rfc-editor.org/x", "X", None, None, "brave", "standard_spec", "primary_source,maintained_current", "standards_or_specification", "specifications", "general_context"),
    ("reference", "https://man7.org/x", "X", None, None, "brave", "reference_docs", "", "standards_or_specification", "official_docs", "general_context"),
    ("issue_thread", "https://github.com/a/b/issues/1", "Crash", "it fails", None, "github_issues", "maintainer_issue", "maintainer_authored", "maintainer_primary", "issue_threads", "package_advisories"),
    ("issue_thread", "https://github.com/a/b/pull/1", "Fix", "it works", True, "github_issues", "engineering_blog", "maintainer_authored", "maintainer_primary", "design_discussions", "patch_commits_or_releases"),
    ("issue_thread", "https://code.example/i/1", "Design doc", None, False, "github_issues", "maintainer_issue", "maintainer_authored", "maintainer_primary", "design_discussions", "general_context"),
    ("pull_request", "https://code.example/p/1", "Fix", None, None, "brave", "engineering_blog", "maintainer_authored", "unknown", "design_discussions", "general_context"),
    ("source_file", f"https://gitlab.com/a/b/-/blob/{_SHA}/x.rs", "x.rs", None, None, "brave", "repository_source", "commit_pinned", "maintainer_primary", "reference_implementations", "general_context"),
    ("commit", f"https://code.example/{_SHA}", "x", None, None, "brave", "repository_source", "maintained_current", "unknown", "reference_implementations", "general_context"),
    ("commit", f"https://code.example/a/{_SHA}?x=1", "x", None, None, "github_code", "repository_source", "commit_pinned", "maintainer_primary", "reference_implementations", "general_context"),
    ("tag", "https://code.example/a/2016/b", "x", None, None, None, "repository_source", "maintained_current,stale_source", "unknown", "reference_implementations", "general_context"),
    ("unknown", "https://arxiv.org/abs/1", "P", None, None, None, "paper", "peer_reviewed", "academic_or_formal", "academic_or_formal_sources", "general_context"),
    ("unknown", "https://doi.org/10", "P", None, None, None, "unknown", "", "academic_or_formal", "academic_or_formal_sources", "general_context"),
    ("unknown", "https://whatwg.org/x", "P", None, None, None, "unknown", "", "standards_or_specification", "unknown", "general_context"),
    ("unknown", "https://x.example/rfc9110", "P", None, None, None, "standard_spec", "primary_source,maintained_current", "standards_or_specification", "specifications", "general_context"),
    ("unknown", "https://pkg.go.dev/x", "P", None, None, None, "unknown", "", "official_primary", "unknown", "general_context"),
    ("unknown", "https://pypi.org/x", "P", "a drawback of it", None, None, "unknown", "", "package_registry", "counterpoints", "general_context"),
    ("unknown", "https://x.example/a", "P", None, None, "osv", "unknown", "", "security_advisory", "unknown", "general_context"),
    ("unknown", "https://x.example/a", "A performance comparison", None, None, None, "benchmark", "reproducible_benchmark", "benchmark_or_measurement", "benchmarks", "general_context"),
    ("unknown", "https://x.example/a", "A", "performance of it", None, None, "unknown", "", "unknown", "benchmarks", "general_context"),
    ("unknown", "https://stackoverflow.com/q/1", "Q", "limitations", None, None, "forum_thread", "secondary_source,anecdotal_source", "community_discussion", "counterpoints", "general_context"),
    ("unknown", "https://forum.x.example/t", "Q", None, None, None, "forum_thread", "secondary_source,anecdotal_source", "community_discussion", "community_discussion", "general_context"),
    ("unknown", "https://github.blog/x", None, None, None, None, "engineering_blog", "maintainer_authored", "unknown", "unknown", "general_context"),
    ("unknown", "https://www.cisa.gov/known-exploited-vulnerabilities-catalog", "KEV", None, None, None, "unknown", "", "unknown", "unknown", "kev_entries"),
    ("unknown", "https://x.example/GHSA-1", "A", None, None, None, "unknown", "", "unknown", "unknown", "authoritative_advisories"),
    ("unknown", "https://x.example/advisory/1", "A", None, None, None, "unknown", "", "unknown", "unknown", "vendor_advisories"),
    ("unknown", "https://x.example/a/POC", "A", None, None, None, "unknown", "", "unknown", "unknown", "exploit_discussion"),
    ("unknown", "https://x.example/epoch", "A", None, None, None, "unknown", "", "unknown", "unknown", "general_context"),
    ("unknown", None, None, None, None, None, "unknown", "", "unknown", "unknown", None),
]
_IN = cases.columns("kind url title snippet is_pr provider", _SOURCES)
_SOURCES_OUT = cases.columns("research_class signals tier research_group security_group", [r[6:] for r in _SOURCES])
_SOURCES_OUT["security_group"][-1] = "general_context"

#: url, security tier, role of that tier.
_TIERS = [
    ("https://nvd.nist.gov/vuln/CVE-1", "primary_advisory"), ("https://RUSTSEC.org/advisories/x", "primary_advisory"), ("https://github.com/advisories/GHSA-x", "package_registry_advisory"),
    ("https://security.snyk.io/v", "package_registry_advisory"), ("https://x.example/advisory", "vendor_advisory"), ("https://github.com/a/b/releases", "release_notes"),
    ("https://x.example/changelog", "release_notes"), ("https://github.com/a/b/issues/1", "maintainer_discussion"), ("https://gitlab.com/a/b/pull/1", "maintainer_discussion"),
    ("https://github.com/a/b", "unknown"), ("https://x.example/poc", "security_research"), ("https://x.example/analysis", "security_research"), ("https://stackexchange.com/q", "community_discussion"),
    ("https://discourse.x.example", "community_discussion"), ("https://x.example/blog", "news_or_blog"), ("https://dev.to/x", "news_or_blog"), ("https://x.example/", "unknown"), (None, "unknown"),
]

#: explicit role, role of the file, kind, role; provider, label, intended role.
_ROLES = [
    ("usage_example", "test", "news", "usage_example", "osv", "docs", "official_documentation"),
    (None, "test", "news", "test_or_behavioral_specification", "osv", "main", "authoritative_security_advisory"),
    (None, "ci", "source_file", "configuration_or_feature_gate", "github_advisory", "x", "authoritative_security_advisory"),
    (None, "vendor", "official_docs", "unknown_or_weak_context", "github_code", "x", "primary_implementation"),
    (None, "lockfile", None, "manifest_or_dependency_metadata", "my_repos", None, "primary_implementation"),
    (None, "security_policy", None, "authoritative_security_advisory", "brave", "error_code", "issue_or_incident_discussion"),
    (None, "migration", None, "migration_guidance", "brave", "error_exact", "primary_implementation"),
    (None, None, "tutorial", "official_documentation", "brave", "academic", "independent_corroboration"),
    (None, None, "tag", "release_note_or_changelog", "brave", "defensive", "configuration_or_feature_gate"),
    (None, None, "pull_request", "pull_request_or_design_review", "brave", "vendor", "vendor_security_guidance"),
    (None, None, "reference", "interface_or_api_definition", "brave", "packages", "manifest_or_dependency_metadata"),
    (None, None, "forum", "community_discussion", "brave", "benchmarks", "benchmark_or_performance_evidence"),
    (None, None, "issue_thread", "issue_or_incident_discussion", "brave", "examples", "usage_example"),
    (None, None, "unknown", "unknown_or_weak_context", "brave", "other", "unknown_or_weak_context"),
    (None, None, None, "unknown_or_weak_context", "brave", "changelog", "release_note_or_changelog"),
]
_ROLES_IN, _ROLES_OUT = cases.columns("explicit file_role kind", _ROLES) | cases.columns("provider label", [r[4:6] for r in _ROLES]), cases.columns("role", [r[3:4] for r in _ROLES]) | cases.columns("intended", [r[6:] for r in _ROLES])


def source_classes(spark, sf_dir):
    c = cases.given(spark, sf_dir, "pages", "page_id", _IN, {"is_pr": "boolean"})
    klass = sources.research_class(F.col("kind"), F.col("url"), F.col("title"), F.col("is_pr"))
    return c.select(
        "page_id",
        klass.alias("research_class"),
        F.array_join(sources.quality_signals(klass, F.col("url")), ",").alias("signals"),
        sources.evidence_tier(F.col("kind"), F.col("url"), F.col("title"), F.col("provider")).alias("tier"),
        sources.research_group(F.col("kind"), F.col("url"), F.col("title"), F.col("snippet"), F.col("is_pr")).alias("research_group"),
        sources.security_group(F.col("kind"), F.col("url")).alias("security_group"),
    )


def security_tiers(spark, sf_dir):
    return cases.given(spark, sf_dir, "pages", "page_id", {"url": [u for u, _ in _TIERS]}, real=REAL["security_tiers"][0]).select("page_id", sources.security_tier(F.col("url")).alias("tier"))


def best_tiers(spark, sf_dir):
    """The best tier of the sources of each of many requests, and what is said of it."""
    tiers = cases.given(spark, sf_dir, "pages", "page_id", {"url": [u for u, _ in _TIERS]}, real=REAL["security_tiers"][0]).withColumn("query_id", F.floor(F.col("page_id") * 7 / 3) % 97)
    best = tiers.groupBy("query_id").agg(sources.best_tier(F.collect_set(sources.security_tier(F.col("url")))).alias("best"))
    return best.select("query_id", "best.tier", F.array_join("best.reasons", "; ").alias("reasons"))


def source_notes(spark, sf_dir):
    """Notes of each source, and what kind of claim its group makes."""
    c = cases.given(spark, sf_dir, "pages", "page_id", _IN, {"is_pr": "boolean"})
    klass = sources.research_class(F.col("kind"), F.col("url"), F.col("title"), F.col("is_pr"))
    group = sources.research_group(F.col("kind"), F.col("url"), F.col("title"), F.col("snippet"), F.col("is_pr"))
    signals = sources.quality_signals(klass, F.col("url"))
    notes = F.array_join(sources.evidence_notes(klass, signals), ", ")
    return c.select("page_id", notes.alias("notes"), F.array_contains(signals, "primary_source").alias("is_primary"), F.array_contains(signals, "stale_source").alias("is_stale"), sources.claim_type(group).alias("claim"))


def evidence_roles(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", _ROLES_IN, {"kind": "string"}, real=REAL["evidence_roles"][0])
    return c.select("event_id", sources.evidence_role(F.col("explicit"), F.col("file_role"), F.col("kind")).alias("role"), sources.intended_role(F.col("provider"), F.col("label")).alias("intended"))


QUERIES = {"source_classes": source_classes, "security_tiers": security_tiers, "best_tiers": best_tiers, "source_notes": source_notes, "evidence_roles": evidence_roles}

_SAID = {
    "official_docs": "official docs, maintained, primary source", "reference_docs": "reference documentation", "security_advisory": "security advisory, primary source",
    "standard_spec": "standards specification, maintained, primary source", "paper": "academic paper, peer-reviewed", "benchmark": "benchmark data", "forum_thread": "community forum",
    "engineering_blog": "engineering blog", "vendor_blog": "vendor blog", "maintainer_issue": "maintainer issue", "unknown": "unclassified source",
}
_NOTES_OF = [
    {"release_notes": "release notes" + ", potentially stale" * ("stale" in s), "news_article": "news article" + ", potentially stale" * ("stale" in s),
     "repository_source": "repository source, " + ("commit-pinned" if "pinned" in s else "maintained") + ", potentially stale" * ("stale" in s)}.get(k) or _SAID[k]
    for k, s in zip(_SOURCES_OUT["research_class"], _SOURCES_OUT["signals"], strict=True)
]
_CLAIMED = {"benchmarks": "performance", "security_considerations": "security", "issue_threads": "maintenance", "release_notes": "maintenance", "community_discussion": "ecosystem", "recent_news": "ecosystem", "unknown": "unknown"}
ORACLES = {
    "source_classes": cases.expected("pages", "page_id", _SOURCES_OUT),
    "security_tiers": cases.expected("pages", "page_id", {"tier": [t for _, t in _TIERS]}, real=REAL["security_tiers"][1]),
    "best_tiers": f"""WITH t AS ({cases.expected("pages", "page_id", {"tier": [t for _, t in _TIERS]}, real=REAL["security_tiers"][1])}),
b AS (SELECT floor(page_id * 7 / 3)::BIGINT % 97 AS query_id, min(CASE tier WHEN 'primary_advisory' THEN 1 WHEN 'package_registry_advisory' THEN 2 WHEN 'vendor_advisory' THEN 3
  WHEN 'maintainer_discussion' THEN 4 WHEN 'release_notes' THEN 5 WHEN 'security_research' THEN 6 WHEN 'community_discussion' THEN 7 WHEN 'news_or_blog' THEN 8 ELSE 9 END) AS n FROM t GROUP BY 1)
SELECT query_id, ['primary_advisory', 'package_registry_advisory', 'vendor_advisory', 'maintainer_discussion', 'release_notes', 'security_research', 'community_discussion', 'news_or_blog', 'unknown'][n] AS tier,
  ['results include primary advisory sources', 'results include package registry advisory sources', 'results include vendor advisory sources', 'results include maintainer discussion sources', 'results include release notes',
   'results include security research sources', 'results include community discussion sources; ', 'results include news or blog sources only; ', ''][n]
  || CASE WHEN n >= 7 THEN 'only low-tier sources found; results may lack advisory authority' ELSE '' END AS reasons FROM b""",
    "source_notes": cases.expected(
        "pages",
        "page_id",
        {
            "notes": _NOTES_OF,
            "is_primary": ["primary" in s for s in _SOURCES_OUT["signals"]],
            "is_stale": ["stale" in s for s in _SOURCES_OUT["signals"]],
            "claim": [_CLAIMED.get(g, "architecture") for g in _SOURCES_OUT["research_group"]],
        },
    ),
    "evidence_roles": cases.expected("events", "event_id", _ROLES_OUT, real=REAL["evidence_roles"][1]),
}
