"""Queries over versions, intents, error texts and subqueries, with their DuckDB SQL.

Each row of a table gets one of a list of cases; the SQL gives what was worked out by hand for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import errors, intent, planning, queries, versions
from sievework.plans import cases
from sievework.plans.real import REAL

#: ecosystem, a, b, order of the two.
_VERSIONS = [
    ("npm", "1.0.0.0.0.0.1", "1.0.0.0.0.0.2", -1), ("npm", "1.2", "1.2.0.0.0.0.0.0", 0), ("npm", "1.18446744073709551615", "1.9223372036854775807", 1), ("npm", "1.18446744073709551616", "1", 0),
    ("crates_io", "vv1.0", "1.0+build.5", 0), ("crates_io", "V1.0", "1.0", -1), ("pypi", "2.0.0-beta", "2.0.0", -1), ("pypi", "2.0.0-beta", "2.0.0-alpha", 1), ("pypi", "1.0-", "1.0", -1),
    ("go", "v1.x.3", "1.3", 0), ("go", "none", "1", None), ("go", None, "1", None), ("go", "007.1", "7.1", 0), ("nuget", " 1.0 ", "1.0", 0), ("npm", "1.10", "1.9", 1),
    ("maven", "1.0-alpha", "1.0-beta", -1), ("maven", "1.0-rc", "1.0-SNAPSHOT", -1), ("maven", "1.0-SNAPSHOT", "1.0", -1), ("maven", "1.0.Final", "1.0", 0), ("maven", "1.0-GA", "1.0.RELEASE", 0),
    ("maven", "1.0-sp", "1.0", 1), ("maven", "1.0-jre", "1.0", 1), ("maven", "1.0-cr", "1.0-rc", -1), ("maven", "1.0_m-1", "1.0", 1), ("maven", "1.0.m", "1.0.b", 1), ("maven", "2", "2.0.0", 0),
    ("maven", "1..2", "1", 1), ("maven", "alpha", "1", None), ("maven", "", "1", None), ("maven", "1+2", "1.2", 0), ("maven", "33.0.0-jre", "33.0.0-android", 1),
    ("oci", "1.0", "1.0", 0), ("oci", "1.0", "2.0", None), ("github_actions", "v3", "v3", 0),
]
#: version, range, whether it is inside; then the same for Maven.
_RANGES = [
    ("1.0.0.0.0.0.1", "<1.0.0.0.0.0.2", True, True), ("1.0.0.0.0.0.2", "<1.0.0.0.0.0.2", False, False), ("1.5", ">=1.0, <2.0", True, True), ("1.5", ">=1.0,,<2.0", True, True), ("1.5", "1.5", True, True), ("1.5", "1.5,", None, None),
    ("1.5", ",", True, True), ("1.5", "  ", None, None), ("1.5", None, None, None), ("1.5", "<1, junk", False, False), ("1.5", "junk, <1", None, None), ("1.5", "!=1.5.0", False, False),
    ("1.0-sp", ">1.0", False, True), ("1.0-rc", "<1.0", True, True), ("1.0.Final", "=1.0", True, True), ("x", ">1", None, None), ("1.5", "= 1.5", True, True), ("1.5", "<= 1.5", True, True),
]

#: query, intent, confidence, reasons.
_INTENTS = [
    ("repo:tokio-rs/axum extractors", "code", "high", "repo_hint"), ("tokio-rs/axum extractors", "web", "low", "no_signal"), ("org:rust-lang async", "code", "high", "repo_hint"), ("owner:rust-lang async", "web", "low", "no_signal"),
    ("symbol:push path:src lang:go", "code", "high", "symbol_hint,path_hint,language_hint"), ("host:github file:x", "code", "high", "file_hint,host_hint"), ("std::mem::swap", "code", "high", "code_token"),
    ("call foo_bar now", "code", "high", "code_token"), ("why is getUserById slow", "code", "high", "code_token"), ("error[E0308]: mismatched", "code", "high", "compiler_error_code,error_vocabulary"),
    ("CS0103 here", "code", "high", "compiler_error_code"), ("TypeError in it", "code", "medium", "error_vocabulary"), ("at src/main.rs:10:5", "code", "high", "stack_frame"), ("thread 'main' panicked at x", "code", "medium", "panic_marker"),
    ("404 Not Found CVE-2021-44228", "code", "medium", "error_vocabulary"), ("CVE-2021-44228 exploit", "security", "high", "vulnerability_identifier,vulnerability_vocabulary"), ("is it vulnerable", "security", "medium", "vulnerability_vocabulary"),
    ("numpy>=1.20", "code", "high", "dependency_version"), ("left-pad@1.3.0", "code", "high", "dependency_version"), ("migrating off it", "releases", "medium", "migration_vocabulary"), ("tokio vs async-std", "web", "medium", "comparison_vocabulary"),
    ("versus the rest", "web", "medium", "comparison_vocabulary"), ("one versus two", "web", "medium", "comparison_vocabulary"), ("release notes", "releases", "medium", "release_vocabulary"), ("open bug", "issues", "medium", "issue_vocabulary"),
    ("getting started", "docs", "medium", "docs_vocabulary"), ("breaking news", "news", "medium", "news_vocabulary"), ("plain words", "web", "low", "no_signal"), ("", "web", "low", "no_signal"), (None, "web", "low", "no_signal"),
]

_TRACE = 'Traceback (most recent call last):\n  File "app.py", line 42, in main\n    result = data[key]\nKeyError: 1 is missing'
#: text, codes, tools, language, packages, frames, primary line.
_ERRORS = [
    ("error[E0277]: the trait bound is not met\n  --> src/main.rs:10:5", "rustc/E0277", "rustc", "rust", "", 0, "error[E0277]: the trait bound is not met"),
    ("error TS2345: bad argument, ts2345 again", "typescript/TS2345", "typescript", "typescript", "", 0, "error TS2345: bad argument, ts2345 again"),
    (_TRACE, "python/KeyError", "python", "python", "", 1, "KeyError: 1 is missing"),
    ("npm ERR! ERESOLVE could not install left-pad@1.3.0", "npm/ERESOLVE", "npm", "javascript", "left-pad", 0, "npm ERR! ERESOLVE could not install left-pad@1.3.0"),
    ("failed to select a version for crate `serde`", "cargo/cargo:failed to select a version", "cargo", "rust", "serde", 0, "failed to select a version for crate `serde`"),
    ("no matching package found: abc", "cargo/cargo:no matching package found", "cargo", "rust", "abc,found", 0, "no matching package found: abc"),
    ("404 Not Found from docker registry", "http/HTTP 404", "docker", None, "", 0, "404 Not Found from docker registry"),
    ("ld: symbol missing in yarn", "", "linker,yarn", "javascript", "", 0, "ld: symbol missing in yarn"),
    ("Requirement numpy is not met\n   at src/lib.rs:5", "", "", None, "numpy", 1, "Requirement numpy is not met"),
    ("short", "", "", None, "", 0, "short"),
    ("", "", "", None, "", 0, ""),
]

#: text, number of subqueries, all of them.
_SUBQUERIES = [
    ("error[E0277]: bad trait in package `foo`", "exact_phrase=\"error[E0277]: bad trait in package `foo`\"|error_code=E0277 rust|package_error=foo E0277|docs=E0277 rust docs documentation|issues=error[E0277]: bad trait in package `foo` issues github|releases=foo E0277 release notes changelog"),
    ("404 Not Found on it", 'exact_phrase="404 Not Found on it"|error_code=HTTP 404 http|issues=404 Not Found on it issues github'),
    ("E0001 E0002 E0003 E0004", 'exact_phrase="E0001 E0002 E0003 E0004"|error_code=E0001 rust|error_code=E0002 rust|error_code=E0003 rust|error_code=E0004 rust|docs=E0001 rust docs documentation|docs=E0002 rust docs documentation|docs=E0003 rust docs documentation'),
    ("", ""),
]

#: query, intent, generic query.
_GENERIC = [
    ("  plain words ", "web", "plain words"), (" cve ", "security", "cve"), ("repo:a/b parse path:src/x lang:Rust", "code", "parse a/b src/x rust github gitlab codeberg source repository"), ("host:github rust lang:rust", "code", "rust github github gitlab codeberg source repository"),
    ("github thing host:github", "code", "github thing github gitlab codeberg source repository"), ("org:acme crash symbol:Foo", "issues", "crash acme Foo issues discussions pull request github gitlab"), ("a/b org:acme", "releases", "a/b releases changelog migration tag github gitlab"),
    ("", "code", " github gitlab codeberg source repository"), ("symbol:x", "releases", "symbol:x releases changelog migration tag github gitlab"), ("file:mod.rs news host:unknown", "releases", "news mod.rs releases changelog migration tag github gitlab"),
]

#: query, ecosystem, package, subqueries.
_REPO = [
    ("router repo:a/b host:github lang:go", "go", "mux", "docs=router a/b mux docs documentation api reference pkg.go.dev|registry=router a/b mux go go module pkg.go.dev proxy.golang.org|source=router a/b go github gitlab source|examples=a/b router examples sample usage demo|issues=router a/b issues github|releases=router a/b mux releases changelog migration github"),
    ("hello", None, None, "docs=hello docs documentation api reference|registry=hello crates.io docs.rs pypi npm|source=hello github gitlab source|examples=hello examples sample usage demo|issues=hello issues discussions|releases=hello releases changelog migration"),
    ("symbol:Foo", "maven", None, "source=Foo github gitlab source"),
    ("lang:rust", "npm", None, "registry=rust crates.io docs.rs pypi npm"),
    ("", "oci", "nginx", "docs=nginx docs documentation api reference docs.docker.com ghcr.io|registry=nginx docker hub ghcr.io|releases=nginx releases changelog migration"),
    ("", None, None, ""),
]

#: kinds wanted, flags (primary, counterpoints, recent, security), kinds asked for, intents.
_RESEARCH = [
    ("", False, False, False, False, "primary_sources,official_docs,reference_implementations,design_discussions,security_considerations,counterpoints", "docs,docs,code,issues,security,web"),
    ("", None, True, True, True, "primary_sources,official_docs,reference_implementations,design_discussions,security_considerations,counterpoints,recent_news", "docs,docs,code,issues,security,web,news"),
    ("benchmarks", True, False, False, True, "benchmarks,primary_sources,security_considerations", "web,docs,security"),
    ("community_discussion,recent_news,release_notes,issue_threads,benchmarks,academic_or_formal_sources,specifications", True, True, False, True,
     "primary_sources,specifications,security_considerations,counterpoints,community_discussion,recent_news,release_notes,issue_threads", "docs,docs,security,web,web,news,releases,issues"),
]

#: workflow, targets, depth, names of the dimensions, number of subqueries, first and last.
_FLOWS = [
    ("architecture_decision", "", "standard", "Official Docs & Specs,Reference Implementations,Design Discussions,Benchmarks & Performance,Security & Failure Modes,Migration & Adoption,Counterpoints & Tradeoffs", 8, "q official documentation specification", "q drawbacks limitations tradeoffs alternatives"),
    ("architecture_decision", "", "quick", "Official Docs & Specs,Reference Implementations,Design Discussions", 4, "q official documentation specification", "q design discussion RFC proposal architecture"),
    ("api_evaluation", "", "quick", "Official API Documentation,Examples & Tutorials,Source Implementation,Issues & Known Pitfalls", 4, "q official API documentation reference", "q issues bugs known problems pitfalls"),
    ("library_comparison", "x,y", "deep", "Official Docs per Target,Benchmarks,Maintenance & Release Cadence,Security Advisories,Migration & Interoperability,Per-Target Deep Dives", 9, "x official documentation API reference", "y source code implementation github"),
    ("library_comparison", "x,y", "standard", "Official Docs per Target,Benchmarks,Maintenance & Release Cadence,Security Advisories,Migration & Interoperability", 7, "x official documentation API reference", "q migration interop compatibility"),
    ("library_comparison", "a,b,c,d,e", "quick", "Official Docs per Target", 4, "a official documentation API reference", "d official documentation API reference"),
    ("library_comparison", "a,b,c,d,e", "deep", "Official Docs per Target,Benchmarks,Maintenance & Release Cadence,Security Advisories,Migration & Interoperability", 10, "a official documentation API reference", "q migration interop compatibility"),
    ("migration_planning", "", "standard", "Migration Guides,Changelogs & Breaking Changes,Breaking-Change Issues,Before/After Examples,Security Changes", 5, "q migration guide upgrade path", "q security changes update advisory"),
    ("security_review", "", "quick", "Security Advisories,Threat Modeling,Hardening Guides,Issue Discussion", 4, "q security advisory CVE vulnerability", "q security issue vulnerability report"),
    ("performance_investigation", "", "quick", "Benchmarks,Profiling & Optimization,Performance Issues,Comparative Analysis", 4, "q benchmark performance latency throughput", "q performance comparison alternative"),
    ("ecosystem_survey", "", "deep", "Ecosystem Overview,Popular Libraries,Community Sentiment,Recent Developments,Security Landscape", 5, "q ecosystem overview landscape", "q security advisory ecosystem"),
    ("general", "", "standard", "Official Documentation,Implementation Evidence,Design Discussions,Security Considerations,Counterpoints", 5, "q official documentation reference", "q drawbacks limitations tradeoffs"),
]

#: asked, usual, most, filtered, n, warning, pool of 30.
_LIMITS = [
    (None, 10, 20, False, 10, None, 30), (0, 10, 20, False, 1, "Requested max_results=0 is below the minimum of 1; using 1.", 3), (50, 10, 20, False, 20, "Requested max_results=50 exceeded server cap=20; using 20.", 30),
    (None, 0, 20, True, 1, "Default max_results=0 is below the minimum of 1; using 1.", 6), (None, 40, 20, True, 20, "Default max_results=40 exceeded server cap=20; using 20.", 30), (5, 10, 20, True, 5, None, 30), (4, 10, 20, True, 4, None, 24), (40, 10, 60, True, 40, None, 40),
]


def version_orders(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("ecosystem a b", _VERSIONS), real=REAL["version_orders"][0])
    return c.select("p_partkey", versions.compare_in(F.col("ecosystem"), F.col("a"), F.col("b")).alias("order"))


def range_cases(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("v s", _RANGES), real=REAL["range_cases"][0])
    return c.select("p_partkey", versions.in_range(F.col("v"), F.col("s")).alias("inside"), versions.in_range(F.col("v"), F.col("s"), versions.compare_maven).alias("inside_maven"))


def intent_reasons(spark, sf_dir):
    i = cases.given(spark, sf_dir, "events", "event_id", {"q": [r[0] for r in _INTENTS]}, real=REAL["intent_reasons"][0]).select("event_id", intent.derive(F.col("q")).alias("i"))
    return i.select("event_id", "i.intent", "i.confidence", F.array_join("i.reasons", ",").alias("reasons"))


def error_contexts(spark, sf_dir):
    t = cases.given(spark, sf_dir, "part", "p_partkey", {"t": [r[0] for r in _ERRORS]}, real=REAL["error_contexts"][0]).withColumn("codes", errors.codes(F.col("t"))).withColumn("tools", errors.tools(F.col("t"), F.col("codes")))
    listed = lambda c: F.array_join(c, ",")
    return t.select(
        "p_partkey",
        listed(F.transform("codes", lambda c: F.concat(c["tool"], F.lit("/"), c["code"]))).alias("codes"),
        listed(F.filter("tools", lambda x: x != "http")).alias("tools"),
        errors.language(F.col("codes"), F.col("tools")).alias("language"),
        listed(errors.packages(F.col("t"))).alias("packages"),
        errors.n_frames(F.col("t")).alias("frames"),
        errors.primary_line(F.col("t")).alias("primary_line"),
    )


def _told(xs):
    return F.array_join(F.transform(xs, lambda x: F.concat(x["label"], F.lit("="), x["query"])), "|")


def error_subqueries(spark, sf_dir):
    return cases.given(spark, sf_dir, "part", "p_partkey", {"t": [r[0] for r in _SUBQUERIES]}, real=REAL["error_subqueries"][0]).select("p_partkey", _told(errors.subqueries(F.col("t"))).alias("subqueries"))


def generic_queries(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("q intent", _GENERIC), real=REAL["generic_queries"][0]).withColumn("h", queries.repo_hints(F.col("q")))
    return c.select("p_partkey", planning.generic_query(F.col("q"), F.col("intent"), F.col("h")).alias("query"))


def repo_subqueries(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("q ecosystem package", _REPO), {"ecosystem": "string", "package": "string"}, real=REAL["repo_subqueries"][0]).withColumn("h", queries.repo_hints(F.col("q")))
    return c.select("p_partkey", _told(planning.repo_subqueries(F.col("h"), F.col("ecosystem"), F.col("package"))).alias("subqueries"))


def research_plans(spark, sf_dir):
    """A row for each subquery of each request."""
    c = cases.given(spark, sf_dir, "supplier", "s_suppkey", cases.columns("w primary counter recent security", _RESEARCH), {"primary": "boolean"})
    wanted = F.filter(F.split("w", ","), lambda x: x != "")
    types = planning.research_types(wanted, F.col("primary"), F.col("counter"), F.col("recent"), F.col("security"))
    rows = c.select("s_suppkey", F.explode(planning.research_subqueries(F.concat(F.lit("topic "), F.col("s_suppkey")), types)).alias("r"))
    return rows.select("s_suppkey", "r.id", "r.source_type", "r.intent", F.substring_index("r.query", " ", 2).alias("topic"))


def research_dimensions(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("flow targets depth", _FLOWS))
    d = c.withColumn("d", planning.dimensions(F.col("flow"), F.lit("q"), F.filter(F.split("targets", ","), lambda x: x != ""), F.col("depth")))
    asked = F.flatten(F.transform("d", lambda x: x["queries"]))
    return d.select("p_partkey", F.array_join(F.transform("d", lambda x: x["name"]), ",").alias("names"), F.size(asked).cast("long").alias("n_queries"), F.get(asked, 0).alias("first"), F.element_at(asked, -1).alias("last"))


def result_limits(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("asked usual most filtered", _LIMITS), real=REAL["result_limits"][0])
    limit = planning.result_limit(F.col("asked"), F.col("usual"), F.col("most"))
    return c.withColumn("l", limit).select("p_partkey", F.col("l.n").cast("long").alias("n"), "l.warning", planning.pool_size(F.col("l.n"), F.lit(30), F.col("filtered")).cast("long").alias("pool"))


QUERIES = {
    "version_orders": version_orders,
    "range_cases": range_cases,
    "intent_reasons": intent_reasons,
    "error_contexts": error_contexts,
    "error_subqueries": error_subqueries,
    "generic_queries": generic_queries,
    "repo_subqueries": repo_subqueries,
    "research_plans": research_plans,
    "research_dimensions": research_dimensions,
    "result_limits": result_limits,
}
ORACLES = {
    "version_orders": cases.expected("part", "p_partkey", {"order": [r[3] for r in _VERSIONS]}, real=REAL["version_orders"][1]).replace("AS order", 'AS "order"'),
    "range_cases": cases.expected("part", "p_partkey", cases.columns("inside inside_maven", [r[2:] for r in _RANGES]), real=REAL["range_cases"][1]),
    "intent_reasons": cases.expected("events", "event_id", cases.columns("intent confidence reasons", [r[1:] for r in _INTENTS]), real=REAL["intent_reasons"][1]),
    "error_contexts": cases.expected("part", "p_partkey", cases.columns("codes tools language packages frames primary_line", [r[1:] for r in _ERRORS]), real=REAL["error_contexts"][1]),
    "error_subqueries": cases.expected("part", "p_partkey", {"subqueries": [r[1] for r in _SUBQUERIES]}, real=REAL["error_subqueries"][1]),
    "generic_queries": cases.expected("part", "p_partkey", {"query": [r[2] for r in _GENERIC]}, real=REAL["generic_queries"][1]),
    "repo_subqueries": cases.expected("part", "p_partkey", {"subqueries": [r[3] for r in _REPO]}, real=REAL["repo_subqueries"][1]),
    "research_plans": f"""WITH t AS ({cases.expected("supplier", "s_suppkey", cases.columns("types intents", [r[5:] for r in _RESEARCH]))})
SELECT s_suppkey, 'rq_' || (i - 1) AS id, string_split(types, ',')[i] AS source_type, string_split(intents, ',')[i] AS intent, 'topic ' || s_suppkey AS topic
FROM t, range(1, 9) r(i) WHERE i <= len(string_split(types, ','))""",
    "research_dimensions": cases.expected("part", "p_partkey", cases.columns("names n_queries first last", [r[3:] for r in _FLOWS])).replace("AS first", 'AS "first"').replace("AS last", 'AS "last"'),
    "result_limits": cases.expected("part", "p_partkey", cases.columns("n warning pool", [r[4:] for r in _LIMITS]), real=REAL["result_limits"][1]),
}
