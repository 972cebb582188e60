"""The subqueries that a query is split into: web, repository and research plans, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is added to a query that is after code, issues or releases.
GENERIC_ENDS = {
    "code": " github gitlab codeberg source repository",
    "issues": " issues discussions pull request github gitlab",
    "releases": " releases changelog migration tag github gitlab",
}
#: The hints that are added for each of them, in order.
GENERIC_HINTS = {"code": ["path", "file", "language", "symbol"], "issues": ["org", "symbol"], "releases": ["org", "file", "path"]}
HOST_WORDS = ["github", "gitlab", "codeberg"]

# Words about the documentation and the registry of an ecosystem.
DOCS_WORDS = {
    "go": ["pkg.go.dev"], "maven": ["javadoc.io", "maven central"], "nuget": ["learn.microsoft.com", "docs.microsoft.com"], "rubygems": ["rubydoc.info", "rubygems.org"],
    "packagist": ["packagist.org"], "oci": ["docs.docker.com", "ghcr.io"], "github_actions": ["docs.github.com"],
}
REGISTRY_WORDS = {
    "go": ["go module", "pkg.go.dev", "proxy.golang.org"], "maven": ["maven central", "javadoc.io"], "nuget": ["nuget.org", "nuget gallery"], "rubygems": ["rubygems.org"],
    "packagist": ["packagist.org", "composer"], "oci": ["docker hub", "ghcr.io"], "github_actions": ["github marketplace", "actions"],
}
OTHER_REGISTRY = ["crates.io", "docs.rs", "pypi", "npm"]
TARGETS = {
    "docs": ["official_docs"], "registry": ["package_registry"], "source": ["repository", "readme", "examples", "tests", "source_files"], "examples": ["examples"],
    "issues": ["issues", "pull_requests"], "releases": ["releases", "migration_notes", "changelog"],
}

# Kinds of sources that research asks for, in order of priority where there are too many,
# with the words that are added to the query and the intent.
SOURCE_TYPES = {
    "primary_sources": ("official docs source repository maintainer", "docs"),
    "official_docs": ("official documentation API reference guide", "docs"),
    "specifications": ("specification RFC standard protocol spec", "docs"),
    "reference_implementations": ("reference implementation github source code examples", "code"),
    "security_considerations": ("security considerations threat model vulnerability hardening", "security"),
    "design_discussions": ("design discussion proposal issue RFC discussion", "issues"),
    "counterpoints": ("drawbacks limitations tradeoffs criticism alternatives", "web"),
    "benchmarks": ("benchmark performance latency throughput comparison", "web"),
    "issue_threads": ("issue discussion bug regression pull request github gitlab", "issues"),
    "release_notes": ("release notes changelog migration breaking changes", "releases"),
    "academic_or_formal_sources": ("paper formal analysis arxiv conference proceedings", "docs"),
    "recent_news": ("recent update announcement news", "news"),
    "community_discussion": ("discussion forum reddit stack overflow users experience", "web"),
}
PRIORITY = list(SOURCE_TYPES)[:7]
DEFAULT_TYPES = ["primary_sources", "official_docs", "reference_implementations", "design_discussions", "security_considerations", "counterpoints"]

# Dimensions of research workflows: name, kinds of sources, words added to the query for each subquery.
DIMENSIONS = {
    "architecture_decision": [
        ("Official Docs & Specs", "primary_sources official_docs specifications", ["official documentation specification", "API reference guide"]),
        ("Reference Implementations", "reference_implementations", ["reference implementation github source code"]),
        ("Design Discussions", "design_discussions", ["design discussion RFC proposal architecture"]),
        ("Benchmarks & Performance", "benchmarks", ["benchmark performance latency throughput"]),
        ("Security & Failure Modes", "security_considerations", ["security considerations threat model vulnerability"]),
        ("Migration & Adoption", "release_notes", ["migration guide adoption breaking changes"]),
        ("Counterpoints & Tradeoffs", "counterpoints", ["drawbacks limitations tradeoffs alternatives"]),
    ],
    "api_evaluation": [
        ("Official API Documentation", "official_docs specifications", ["official API documentation reference"]),
        ("Examples & Tutorials", "community_discussion", ["tutorial example getting started guide"]),
        ("Source Implementation", "reference_implementations", ["source code implementation github"]),
        ("Issues & Known Pitfalls", "issue_threads", ["issues bugs known problems pitfalls"]),
        ("Version & Release Notes", "release_notes", ["release notes changelog version history"]),
        ("Security & Compatibility", "security_considerations", ["security compatibility deprecation advisory"]),
    ],
    "library_comparison": [
        ("Benchmarks", "benchmarks", ["benchmark performance comparison"]),
        ("Maintenance & Release Cadence", "release_notes issue_threads", ["release cadence maintenance activity", "issues bugs open problems"]),
        ("Security Advisories", "security_considerations", ["security advisory vulnerability"]),
        ("Migration & Interoperability", "release_notes", ["migration interop compatibility"]),
    ],
    "migration_planning": [
        ("Migration Guides", "release_notes", ["migration guide upgrade path"]),
        ("Changelogs & Breaking Changes", "release_notes", ["changelog breaking changes deprecation"]),
        ("Breaking-Change Issues", "issue_threads", ["breaking change issue migration problem"]),
        ("Before/After Examples", "reference_implementations community_discussion", ["migration example before after code"]),
        ("Security Changes", "security_considerations", ["security changes update advisory"]),
    ],
    "security_review": [
        ("Security Advisories", "security_considerations", ["security advisory CVE vulnerability"]),
        ("Threat Modeling", "security_considerations", ["threat model attack surface risk"]),
        ("Hardening Guides", "official_docs", ["security hardening configuration best practices"]),
        ("Issue Discussion", "issue_threads", ["security issue vulnerability report"]),
        ("Community Analysis", "community_discussion", ["security analysis community discussion"]),
    ],
    "performance_investigation": [
        ("Benchmarks", "benchmarks", ["benchmark performance latency throughput"]),
        ("Profiling & Optimization", "official_docs community_discussion", ["profiling optimization tuning guide"]),
        ("Performance Issues", "issue_threads", ["performance issue regression slow"]),
        ("Comparative Analysis", "benchmarks community_discussion", ["performance comparison alternative"]),
    ],
    "ecosystem_survey": [
        ("Ecosystem Overview", "official_docs", ["ecosystem overview landscape"]),
        ("Popular Libraries", "official_docs", ["popular library recommended"]),
        ("Community Sentiment", "community_discussion", ["community opinion experience comparison"]),
        ("Recent Developments", "recent_news release_notes", ["recent news update announcement"]),
        ("Security Landscape", "security_considerations", ["security advisory ecosystem"]),
    ],
    "general": [
        ("Official Documentation", "primary_sources official_docs", ["official documentation reference"]),
        ("Implementation Evidence", "reference_implementations", ["source code implementation github"]),
        ("Design Discussions", "design_discussions", ["design discussion RFC proposal"]),
        ("Security Considerations", "security_considerations", ["security considerations vulnerability"]),
        ("Counterpoints", "counterpoints", ["drawbacks limitations tradeoffs"]),
    ],
}
# Dimensions of a comparison that ask about each target, and subqueries by depth.
TARGET_DOCS = ("Official Docs per Target", "official_docs", "official documentation API reference")
TARGET_DIVES = ("Per-Target Deep Dives", "reference_implementations", "source code implementation github")
DEPTHS = {"quick": 4, "standard": 8, "deep": 12}


def _joined(*parts: Column) -> Column:
    """Parts with a space between, null and empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def _pair(hints: Column) -> Column:
    return F.concat(hints["owner"], F.lit("/"), hints["repo"])


def generic_query(query: Column, intent: Column, hints: Column) -> Column:
    """The query as it goes to providers without an own form: with hints put in as words and words of
    the intent added for code, issues and releases; trimmed for others."""
    rest = hints["residual"]

    def hint(name):
        h = hints[name]
        if name == "org":
            return F.when(hints["owner"].isNull() & hints["repo"].isNull(), h)
        return F.when(~F.contains(F.lower(rest) if name == "language" else rest, h), h)

    def built(kind):
        host = F.when(hints["host"].isin(HOST_WORDS) & ~F.contains(F.lower(rest), hints["host"]), hints["host"])
        parts = F.array_distinct(F.filter(F.array(rest, _pair(hints), *[hint(h) for h in GENERIC_HINTS[kind]], host), lambda p: F.coalesce(p, F.lit("")) != ""))
        return F.concat(F.when(F.size(parts) == 0, F.trim(query)).otherwise(F.array_join(parts, " ")), F.lit(GENERIC_ENDS[kind]))

    out = F
    for kind in GENERIC_ENDS:
        out = out.when(intent == kind, built(kind))
    return out.otherwise(F.trim(query))


def repo_subqueries(hints: Column, ecosystem: Column, package: Column | None = None) -> Column:
    """array of (label, query, targets): what is asked about a repository, in order. package is the
    name of a package that was resolved; a subquery without anything of its own is left out."""
    name = F.lit(None).cast("string") if package is None else package
    rest, pair, host = hints["residual"], _pair(hints), hints["host"]
    words = lambda table, other=(): F.array_join(F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]), ecosystem), F.array(*[F.lit(w) for w in other]).cast("array<string>")), " ")
    own = {
        "docs": (_joined(rest, pair, name), _joined(F.lit("docs documentation api reference"), words(DOCS_WORDS))),
        "registry": (_joined(rest, pair, name, hints["language"]), words(REGISTRY_WORDS, OTHER_REGISTRY)),
        "source": (_joined(rest, pair, hints["path"], hints["file"], hints["language"], hints["symbol"]), F.lit("github gitlab source")),
        "examples": (_joined(pair, rest), F.lit("examples sample usage demo")),
        "issues": (_joined(rest, pair), F.concat(F.lit("issues "), F.when(host.isin("github", "gitlab"), host).otherwise("discussions"))),
        "releases": (_joined(rest, pair, name), _joined(F.lit("releases changelog migration"), F.when(host.isin("github", "gitlab"), host))),
    }
    listed = [F.struct(F.lit(label).alias("label"), F.when(mine != "", F.concat(mine, F.lit(" "), more)).alias("query"), F.array(*[F.lit(t) for t in TARGETS[label]]).alias("targets")) for label, (mine, more) in own.items()]
    sourced = (rest != "") | pair.isNotNull() | hints["path"].isNotNull() | hints["file"].isNotNull() | hints["symbol"].isNotNull()
    return F.filter(F.array(*listed), lambda s: s["query"].isNotNull() & (sourced | (s["label"] != "source")))


def research_types(wanted: Column, primary: Column, counterpoints: Column, recent: Column, security: Column, most: int = 8) -> Column:
    """The kinds of sources that a research request asks for, those of priority first where there are too many."""
    own = F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(F.array(*[F.lit(t) for t in DEFAULT_TYPES]))
    for flag, kind in ((primary, "primary_sources"), (counterpoints, "counterpoints"), (recent, "recent_news"), (security, "security_considerations")):
        own = F.when(F.coalesce(flag, F.lit(False)) & ~F.array_contains(own, kind), F.array_append(own, kind)).otherwise(own)
    first = F.filter(F.array(*[F.lit(t) for t in PRIORITY]), lambda t: F.array_contains(own, t))
    return F.when(F.size(own) > most, F.slice(F.array_distinct(F.concat(first, own)), 1, most)).otherwise(own)


def research_subqueries(query: Column, types: Column) -> Column:
    """array of (id, source_type, query, intent) of kinds of sources."""
    table = lambda k: F.create_map(*[F.lit(x) for t, v in SOURCE_TYPES.items() for x in (t, v[k])])
    return F.transform(
        types,
        lambda t, i: F.struct(
            F.concat(F.lit("rq_"), i).alias("id"), t.alias("source_type"), F.concat(query, F.lit(" "), F.element_at(table(0), t)).alias("query"), F.element_at(table(1), t).alias("intent")
        ),
    )


def dimensions(workflow: Column, query: Column, targets: Column, depth: Column) -> Column:
    """array of (name, source_types, queries): the dimensions of a research workflow. Where they have
    more subqueries than the depth allows, the last ones go, and the first is cut if it is too long."""
    def one(name, kinds, queries):
        return F.struct(F.lit(name).alias("name"), F.array(*[F.lit(k) for k in kinds.split()]).alias("source_types"), queries.alias("queries"))

    asked = lambda ends: F.array(*[F.concat(query, F.lit(f" {e}")) for e in ends])
    about = lambda t, end: F.transform(t, lambda x: F.concat(x, F.lit(f" {end}")))
    out = F
    for flow, dims in DIMENSIONS.items():
        made = F.array(*[one(n, k, asked(ends)) for n, k, ends in dims])
        if flow == "library_comparison":
            made = F.concat(F.array(one(TARGET_DOCS[0], TARGET_DOCS[1], about(targets, TARGET_DOCS[2]))), made)
            made = F.when(F.size(targets) > 1, F.array_append(made, one(TARGET_DIVES[0], TARGET_DIVES[1], about(F.slice(targets, 1, 3), TARGET_DIVES[2])))).otherwise(made)
        out = out.when(workflow == flow, made)
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv]), depth), F.lit(DEPTHS["standard"]))

    def bounded(ds):
        upto = lambda i: F.aggregate(F.slice(ds, 1, i + 1), F.lit(0), lambda n, d: n + F.size(d["queries"]))
        kept = F.filter(ds, lambda d, i: (i == 0) | (upto(i) <= most))
        return F.transform(kept, lambda d, i: F.struct(d["name"].alias("name"), d["source_types"].alias("source_types"), F.slice(d["queries"], 1, F.when(i == 0, most).otherwise(F.size(d["queries"]))).alias("queries")))

    return F.get(F.transform(F.array(out), bounded), 0)


def pool_size(wanted: Column, most: Column, filtered: Column) -> Column:
    """How many candidates are asked for: three times the results wanted, twice that where domains
    are filtered, up to a limit or the results themselves."""
    top = F.greatest(most, wanted)
    base = F.least(wanted * 3, top)
    return F.when(filtered, F.least(base * 2, top)).otherwise(base)


def result_limit(asked: Column, usual: Column, most: Column) -> Column:
    """struct(n, warning): the results that are returned, and what is said if that is not what was asked."""
    want, name = F.coalesce(asked, usual), F.when(asked.isNull(), "Default").otherwise("Requested")
    n = F.least(F.greatest(want, F.lit(1)), most)
    said = F.when(want == 0, F.concat(name, F.lit(" max_results=0 is below the minimum of 1; using 1."))).when(
        want > most, F.concat(name, F.lit(" max_results="), want, F.lit(" exceeded server cap="), most, F.lit("; using "), n, F.lit("."))
    )
    return F.struct(n.alias("n"), said.alias("warning"))
