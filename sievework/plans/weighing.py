"""Queries over coverage, gaps, claims, conflicts, routing, jobs, breakers and focus, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import outcomes
from sievework.operators import dispatch, measures, research, state
from sievework.plans import cases
from sievework.plans.real import REAL
from sievework.session import table
from sievework.sources.derived import ATTEMPTS, attempts

_GROUPS = ["primary_sources", "official_docs", "reference_implementations", "benchmarks", "security_considerations", "counterpoints", "recent_news", "issue_threads", "community_discussion", "unknown"]
_CLASSES = ["official_docs", "forum_thread", "benchmark", "security_advisory", "news_article", "release_notes", "standard_spec", "engineering_blog", "reference_docs", "paper", "unknown"]
_FLOWS = ["architecture_decision", "api_evaluation", "library_comparison", "migration_planning", "security_review", "performance_investigation", "ecosystem_survey", "general"]
_ROLES = ["implementation", "test", "example", "manifest", "changelog", "security_policy", "vendor"]
_KINDS = ["official_docs", "release_notes", "security_advisory", "source_file", "tag", "unknown"]
_CONF, _AUTH, _STRONG = ["high", "medium", "low", "unknown"], ["primary", "official", "maintainer", "community", "unknown"], ["exact_code_span", "exact_identifier", "partial", "weak", "weak"]

# Cards of requests: what an order's lines make of them.
_CARD = {
    "query_id": "l_orderkey", "pos": "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey", "group": cases.dealt("(l_orderkey * 3 + l_partkey % 4)", _GROUPS), "group_no": "(l_orderkey * 3 + l_partkey % 4) % 10", "class": cases.dealt("l_suppkey", _CLASSES),
    "confidence": cases.dealt("l_partkey", _CONF), "authority": cases.dealt("l_suppkey", _AUTH), "strength": cases.dealt("(l_partkey + l_linenumber)", _STRONG), "role": cases.dealt("l_partkey", _ROLES), "kind": cases.dealt("l_suppkey", _KINDS),
}
# Line numbers repeat within an order of the table; with the part and the supplier they do not.
_POS = "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey"
_Q = lambda c: '"group"' if c == "group" else c
_CARDS_SQL = "c AS (SELECT " + ", ".join(f"{v} AS {_Q(k)}" for k, v in _CARD.items()) + " FROM lineitem)"


def cards(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS `{k}`" for k, v in _CARD.items()])


def covered(spark, sf_dir):
    return research.coverage(cards(spark, sf_dir))


def research_gaps(spark, sf_dir):
    asked = covered(spark, sf_dir).withColumns({"workflow": F.expr(cases.dealt("query_id", _FLOWS)), "wants_counterpoints": F.expr("query_id % 3 = 0"), "n_providers": F.expr("query_id % 4")})
    return research.gaps(asked)


def bundle_gaps(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    made = t.selectExpr("l_orderkey AS query_id", f"{_POS} AS source", f"{_CARD['role']} AS role", f"{_CARD['kind']} AS source_kind", "CASE WHEN l_orderkey % 3 = 0 OR l_suppkey % 5 > 0 THEN 'external_untrusted' ELSE 'local_trusted' END AS trust", "l_partkey % 3 > 0 AS dull")
    fetches = t.filter("l_partkey % 2 = 0").selectExpr("l_orderkey AS query_id", f"{_POS} AS source", "l_partkey % 10 > 0 AS fetched")
    return research.bundle_gaps(made, fetches).withColumn("source", F.coalesce("source", F.lit(-1)))


_FITS = [
    ("npm", "1.0", None, None, None, "compatible"), ("npm", None, None, None, None, "unverified"), ("npm", "1.0", "git", None, None, "incompatible"), ("npm", "1.0", "registry", "https://registry.npmjs.org/x", None, "compatible"),
    ("npm", "1.0", "registry", "https://npm.acme.io/x", None, "unverified"), ("crates_io", "1.0", None, "registry+https://github.com/rust-lang/crates.io-index", None, "compatible"), ("crates_io", "1.0", None, "GIT+https://x", None, "incompatible"), ("crates_io", "1.0", None, None, None, "unverified"),
    ("go", "1.0", None, None, "a/vendor/modules.txt", "compatible"), ("go", "1.0", None, "replace => ../x", "a/vendor/modules.txt", "incompatible"), ("go", "1.0", None, None, None, "unverified"), ("pypi", "1.0", None, "https://pypi.org/simple", None, "compatible"),
    ("rubygems", "1.0", None, "remote: https://rubygems.org/", None, "compatible"), ("maven", "1.0", None, None, None, "unverified"), ("pypi", "1.0", "workspace", "", None, "incompatible"), ("pypi", "1.0", None, "Source Path x", None, "incompatible"),
]


def provenance_fits(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("eco v ref prov path", _FITS))
    return c.select("p_partkey", research.provenance_fit(F.col("eco"), F.col("v"), F.col("ref"), F.col("prov"), F.col("path")).alias("fit"))


def distinct_advisories(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS query_id", f"{_POS} AS pos", "array(concat('cve-', l_partkey % 5), concat('ghsa-', l_suppkey % 7)) AS ids")
    return research.distinct_advisories(made)


_WINDOWS = [("<1.0|>=2.0, <2.3", "1.0|>=3|1.0", "x", "npm"), ("", "1.0|2.0", "", "npm"), ("", "", "1.1", "npm"), ("", ">2", "", "npm"), ("<1.0", "", "", None), ("<5", "<4", "4.9", "go")]


def advisory_windows(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("a p v eco", _WINDOWS))
    split = lambda x: F.filter(F.split(x, r"\|"), lambda s: s != "")
    made = c.select(F.col("p_partkey").alias("advisory_id"), F.col("eco").alias("ecosystem"), F.when(F.col("p_partkey") % 13 > 0, F.lit("pkg")).alias("package"), split("a").alias("affected"), split("p").alias("patched"), split("v").alias("vulnerable"))
    return research.windows_of(made)




def focus_picks(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "cast(turn AS bigint) AS pos", "cast(greatest((conv_id * 7 + turn * 5) % 11 - 3, 0) AS double) AS score", "cast((conv_id * 31 + turn * 170) % 400 AS bigint) AS n_chars")
    return research.focused(made, 3, 500)


_PROVIDERS = {"github_code": (True, True, False, True), "gitlab_code": (True, False, False, True), "gitea_code": (True, True, True, True), "sourcegraph": (True, True, False, True), "github_issues": (True, True, False, True), "gitlab_issues": (True, True, False, True),
              "gitea_issues": (True, True, False, True), "firecrawl_developer": (False, True, False, True), "github_releases": (True, True, False, False), "gitlab_releases": (True, True, False, True), "osv": (True, True, False, True), "github_advisory": (True, True, False, True), "nvd": (True, True, False, True), "tavily": (True, True, False, True)}
_SELECTED = ["github_code", "osv", "none", "gitea_issues"]
_INTENTS = ["code", "issues", "releases", "security", "news", "web"]


def routed(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS query_id", f"{cases.dealt('o_orderkey', _INTENTS)} AS intent", f"array({cases.dealt('(o_orderkey * 5 % 7)', _SELECTED)}) AS selected")
    known = spark.createDataFrame([(p, *v) for p, v in _PROVIDERS.items()], "provider string, enabled boolean, built boolean, cooling boolean, capable boolean")
    return dispatch.routed(asked, known)


_SUPPORTED = [("a", "docs"), ("a", "code"), ("b", "code"), ("b", "issues"), ("c", "docs")]


def dispatch_jobs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    sub = t.selectExpr("l_orderkey AS query_id", "l_partkey % 3 AS priority", f"{_POS} AS subquery_no", f"concat('s', {_POS}) AS label", "array(CASE l_partkey % 2 WHEN 0 THEN 'docs' ELSE 'code' END, CASE l_suppkey % 3 WHEN 0 THEN 'issues' WHEN 1 THEN 'code' ELSE 'docs' END) AS roles")
    return dispatch.jobs(sub, ["a", "b", "c", "d"], spark.createDataFrame(_SUPPORTED, "provider string, role string"))


def provider_outcomes(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(*[F.lit(p) for p in "abc"])).alias("provider"))
    t = table(spark, sf_dir, "lineitem")
    got = t.filter("l_suppkey % 2 = 0").selectExpr("l_orderkey AS query_id", "array(CASE l_partkey % 3 WHEN 0 THEN 'a' ELSE 'b' END) AS providers")
    failed = t.filter("l_suppkey % 2 = 1").selectExpr("l_orderkey AS query_id", "CASE l_partkey % 3 WHEN 0 THEN 'b' ELSE 'c' END AS provider", "CASE l_partkey % 2 WHEN 0 THEN 'timeout' ELSE 'blocked' END AS class", f"{_POS} AS pos")
    return dispatch.provider_outcomes(asked, got, failed)


_OUTCOME = cases.dealt("event_id", ["retryable", "rate_limited", "retryable", "retryable", "rate_limited", "retryable", "success", "retryable", "not_retryable"])


def circuits(spark, sf_dir):
    made = table(spark, sf_dir, "events").selectExpr("user_id % 10 AS origin", "event_id AS call_id", "ts", f"{_OUTCOME} AS outcome")
    return state.circuits(made, threshold=4).select("call_id", "failures", "longest_delay_ms", F.date_format("open_until", "yyyy-MM-dd HH:mm:ss").alias("open_until"))


_HINTS = ["'acme' AS owner", "'tool' AS repo", "'src' AS hint_path", "'main.rs' AS hint_file", "'rust' AS hint_language", "'parse' AS symbol"]
_BOOST = {
    "query_id": "l_orderkey", "group": "l_partkey % 2", "pos": "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey", "score": "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_partkey % 50 / 100.0 END", "url": "CASE l_partkey % 3 WHEN 0 THEN 'https://x/Acme/Tool' ELSE 'https://x/acme' END",
    "title": "CASE l_suppkey % 3 WHEN 0 THEN 'How to Parse' ELSE 'x' END", "path": "CASE l_partkey % 4 WHEN 0 THEN 'Src/main.rs' WHEN 1 THEN 'src/x' ELSE NULL END", "language": "CASE l_suppkey % 2 WHEN 0 THEN 'Rust' ELSE 'go' END",
    "kind": cases.dealt("l_suppkey", _KINDS), "provider": "CASE l_partkey % 5 WHEN 0 THEN 'github_issues' ELSE 'brave' END", "confidence": _CARD["confidence"], "authority": _CARD["authority"], "strength": _CARD["strength"],
}


def hint_boosts(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").selectExpr(*[f"{'cast(' + v + ' AS double)' if k == 'score' else v} AS `{k}`" for k, v in _BOOST.items()], *_HINTS)
    return dispatch.boosted_by_hints(made)


def wilson(spark, sf_dir):
    """The interval of the share of hits of each provider."""
    c = attempts(spark, sf_dir).groupBy("provider").agg(F.count_if(F.col("outcome") == "success").alias("hits"), F.count("*").alias("n"))
    low, high = measures.wilson(F.col("hits"), F.col("n"))
    return c.select("provider", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_TRIES = cases.dealt("event_id", ["failed", "timed_out", "rate_limited", "interrupted_by_deadline", "skipped_by_policy", "skipped_capability_unavailable", "success_with_results", "not_applicable"])


def attempt_failures(spark, sf_dir):
    made = table(spark, sf_dir, "events").selectExpr("event_id AS attempt_id", "concat('p', user_id % 8) AS provider", f"{_TRIES} AS outcome", "CASE event_id % 3 WHEN 0 THEN array('a', 'b', 'a') WHEN 1 THEN array('b') ELSE array() END AS roles", "CASE user_id % 2 WHEN 0 THEN 'blocked' END AS class")
    return dispatch.failures(made.withColumn("roles", F.col("roles").cast("array<string>")))


_STATE = "CASE WHEN l_suppkey % 5 < 3 THEN 'ended' WHEN l_partkey % 2 = 0 THEN 'running' ELSE 'pending' END"
#: state on record, why evidence is absent, state.
_STATES = [
    ("partial", "provider_failed", "partial"), (None, "not_applicable", "other_absence"), (None, "no_matching_evidence_found", "completed_no_match"), (None, "provider_failed", "failed"), (None, "deadline_prevented_completion", "interrupted"), (None, "provider_skipped_by_policy", "skipped_by_policy"),
    (None, "provider_capability_unavailable", "capability_unavailable"), (None, "result_truncated_by_cap", "partial"), (None, "evidence_role_requested_but_not_found", "completed_no_match"), (None, "evidence_role_indeterminate_because_retrieval_failed", "failed"), (None, "evidence_role_not_requested", "not_applicable"),
]


def effective_states(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("state absence", _STATES), real=REAL["effective_states"][0])
    return c.select("event_id", outcomes.effective_state(F.col("state"), F.col("absence")).alias("state"))


QUERIES = {
    "attempt_failures": attempt_failures, "effective_states": effective_states,
    "deadline_counts": lambda s, d: dispatch.deadlines(table(s, d, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber % 3 AS subquery", f"{_STATE} AS state")),
    "research_coverage": covered, "research_gaps": research_gaps, "research_claims": lambda s, d: research.claims(cards(s, d)), "research_conflicts": lambda s, d: research.conflicts(cards(s, d)),
    "role_summary": lambda s, d: research.role_summary(cards(s, d)), "group_quality": lambda s, d: research.group_quality(cards(s, d)), "bundle_gaps": bundle_gaps, "provenance_fits": provenance_fits, "distinct_advisories": distinct_advisories,
    "advisory_windows": advisory_windows, "focus_picks": focus_picks, "routed_providers": routed, "dispatch_jobs": dispatch_jobs, "provider_outcomes": provider_outcomes,
    "lane_coverage": lambda s, d: dispatch.lane_coverage(table(s, d, "lineitem").selectExpr("l_orderkey AS query_id", "l_suppkey % 3 > 0 AS completed", "l_partkey % 9 AS cards")),
    "provider_latencies": lambda s, d: dispatch.latencies(attempts(s, d)), "origin_circuits": circuits, "hint_boosts": hint_boosts, "success_intervals": wilson,
}

_n = lambda gs: f"count(*) FILTER (\"group\" IN ({', '.join(repr(g) for g in gs)}))"
_COVER = f"""v AS (SELECT query_id, {_n(["primary_sources", "official_docs"])} AS "primary", {_n(["reference_implementations"])} AS implementation, {_n(["benchmarks"])} AS benchmarks,
  {_n(["security_considerations"])} AS security, {_n(["counterpoints"])} AS counterpoints, {_n(["recent_news"])} AS recent FROM c GROUP BY query_id)"""
_G = """g AS (SELECT query_id, "group", group_no, count(*) AS n_sources, count(*) FILTER (class IN ('official_docs', 'security_advisory', 'paper', 'standard_spec')) AS n_primary, bool_or(confidence = 'high') AS sure, bool_or(authority IN ('primary', 'official', 'maintainer')) AS first_hand,
  bool_or(class = 'benchmark') AS measured, bool_or(class = 'security_advisory') AS advised, bool_or(class = 'release_notes') AS released, bool_or(class IN ('official_docs', 'reference_docs')) AS documented,
  bool_or(class IN ('official_docs', 'standard_spec', 'security_advisory')) AS best, bool_or(class IN ('forum_thread', 'news_article')) AS worst FROM c GROUP BY query_id, "group", group_no)"""
_TYPE = """CASE "group" WHEN 'benchmarks' THEN 'performance' WHEN 'security_considerations' THEN 'security' WHEN 'issue_threads' THEN 'maintenance' WHEN 'release_notes' THEN 'maintenance' WHEN 'community_discussion' THEN 'ecosystem' WHEN 'recent_news' THEN 'ecosystem' WHEN 'unknown' THEN 'unknown' ELSE 'architecture' END"""
_z = 1.959963984540054
ORACLES = {
    "attempt_failures": f"""WITH a AS (SELECT event_id, 'p' || user_id % 8 AS p, {_TRIES} AS o, CASE event_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b'] ELSE ['unknown_or_weak_context'] END AS rs, CASE user_id % 2 WHEN 0 THEN '[blocked] ' ELSE '' END AS c FROM events)
SELECT event_id AS attempt_id, CASE o WHEN 'failed' THEN 'provider_failed' WHEN 'timed_out' THEN 'deadline_prevented_completion' WHEN 'rate_limited' THEN 'provider_failed' WHEN 'interrupted_by_deadline' THEN 'deadline_prevented_completion' WHEN 'skipped_by_policy' THEN 'provider_skipped_by_policy' ELSE 'provider_capability_unavailable' END AS kind,
  unnest(rs) AS role, CASE o WHEN 'failed' THEN c || 'provider ' || p || ' failed' WHEN 'timed_out' THEN c || 'provider ' || p || ' timed out' WHEN 'rate_limited' THEN c || 'provider ' || p || ' rate limited' WHEN 'interrupted_by_deadline' THEN 'provider ' || p || ' interrupted by global deadline'
  WHEN 'skipped_by_policy' THEN 'provider ' || p || ' skipped by policy' ELSE 'provider ' || p || ' lacks the requested capability' END AS message FROM a WHERE o NOT IN ('success_with_results', 'not_applicable')""",
    "effective_states": cases.expected("events", "event_id", {"state": [r[2] for r in _STATES]}, real=REAL["effective_states"][1]),
    "deadline_counts": f"""WITH j AS (SELECT l_orderkey AS q, l_linenumber % 3 AS s, {_STATE} AS state FROM lineitem), e AS (SELECT q, s, bool_and(state = 'ended') AS whole, bool_or(state = 'ended') AS part, bool_or(state = 'running') AS runs, bool_or(state = 'pending') AS waits FROM j GROUP BY q, s)
SELECT q AS query_id, count(*) FILTER (whole) AS completed, count(*) FILTER (NOT whole AND (runs OR NOT waits) AND part) AS "partial", count(*) FILTER (NOT whole AND (runs OR NOT waits)) AS interrupted, count(*) FILTER (NOT whole AND waits AND NOT runs) AS skipped, bool_or(NOT whole) AS exceeded FROM e GROUP BY q""",
    "research_coverage": f"WITH {_CARDS_SQL}, {_COVER} SELECT * FROM v",
    "research_gaps": f"""WITH {_CARDS_SQL}, {_COVER}, w AS (SELECT *, {cases.dealt("query_id", _FLOWS)} AS f FROM v),
k AS (SELECT query_id, list_filter([CASE WHEN "primary" = 0 AND f IN ('architecture_decision', 'api_evaluation', 'security_review') THEN 'no_primary_sources' END, CASE WHEN recent = 0 AND f IN ('ecosystem_survey', 'performance_investigation') THEN 'no_recent_sources' END,
  CASE WHEN counterpoints = 0 AND query_id % 3 = 0 THEN 'no_counterpoints' END, CASE WHEN implementation = 0 AND f IN ('architecture_decision', 'api_evaluation', 'library_comparison') THEN 'no_implementation_evidence' END,
  CASE WHEN benchmarks = 0 AND f IN ('performance_investigation', 'library_comparison') THEN 'no_benchmarks' END, CASE WHEN security = 0 AND f = 'security_review' THEN 'no_security_discussion' END, CASE WHEN "primary" = 0 AND f = 'migration_planning' THEN 'no_migration_docs' END,
  CASE WHEN query_id % 4 <= 1 THEN 'provider_coverage_limited' END], lambda x: x IS NOT NULL) AS ks FROM w)
SELECT query_id, unnest(range(0, len(ks))) AS place, unnest(ks) AS kind FROM k""",
    "research_claims": f"""WITH {_CARDS_SQL}, {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_no, "group") AS place, {_TYPE} AS type FROM g WHERE n_sources >= 2)
SELECT query_id, place, "group", type, CASE WHEN sure THEN 'high' WHEN first_hand THEN 'medium' ELSE 'unknown' END AS confidence, n_sources, n_primary,
  array_to_string(list_filter([CASE WHEN type = 'performance' AND NOT measured THEN 'benchmark data' END, CASE WHEN type = 'security' AND NOT advised THEN 'security advisory' END, CASE WHEN type = 'maintenance' AND NOT released THEN 'release notes' END, CASE WHEN NOT documented THEN 'official documentation' END], lambda x: x IS NOT NULL), ', ') AS missing
FROM r WHERE place <= 10""",
    "research_conflicts": f"""WITH {_CARDS_SQL}, {_G}, k AS (SELECT query_id, 0 AS o, group_no, 'counterpoints' AS kind, "group" FROM g WHERE "group" = 'counterpoints' UNION ALL SELECT query_id, 1, group_no, 'quality', "group" FROM g WHERE n_sources >= 2 AND best AND worst)
SELECT query_id, place, kind, "group" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, group_no, "group") AS place FROM k) WHERE place <= 5""",
    "role_summary": f"""WITH {_CARDS_SQL}, n AS (SELECT query_id, role, count(*) AS n FROM c GROUP BY query_id, role) SELECT query_id, role, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, role) AS place FROM n QUALIFY place <= 30""",
    "group_quality": f"""WITH {_CARDS_SQL}, q AS (SELECT query_id, "group", count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence IN ('low', 'unknown')) AS low, count(*) FILTER (authority IN ('primary', 'official', 'maintainer')) AS "primary", count(*) FILTER (strength IN ('exact_code_span', 'exact_identifier')) AS exact, count(*) AS n FROM c GROUP BY query_id, "group")
SELECT query_id, "group", high, low, "primary", exact, array_to_string(list_filter([CASE WHEN low > 0 AND low = n THEN 'all results have low or unknown confidence' END, CASE WHEN n > 3 AND exact = 0 THEN 'no exact evidence matches in group' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM q""",
    "bundle_gaps": f"""WITH s AS (SELECT l_orderkey AS query_id, {_POS} AS source, {_CARD["role"]} AS role, {_CARD["kind"]} AS kind, NOT (l_orderkey % 3 = 0 OR l_suppkey % 5 > 0) AS local, l_partkey % 3 > 0 AS dull FROM lineitem),
f AS (SELECT l_orderkey AS query_id, {_POS} AS source, l_partkey % 10 > 0 AS fetched FROM lineitem WHERE l_partkey % 2 = 0),
u AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = s.query_id AND f.source = s.source)),
r AS (SELECT query_id, list(role) AS rs, list(kind) AS ks, bool_and(NOT local) AS ext, bool_or(local) AS has, bool_and(NOT local OR dull) AS dull FROM s GROUP BY query_id)
SELECT query_id, 'source_unfetched' AS kind, source FROM u UNION ALL SELECT query_id, 'local_source_unfetched', source FROM u WHERE local UNION ALL SELECT query_id, 'fetch_failed', source FROM f WHERE NOT fetched
UNION ALL SELECT query_id, 'local_generated_or_vendor_only', -1 FROM r WHERE has AND dull UNION ALL SELECT query_id, 'all_results_external_untrusted', -1 FROM r WHERE ext
UNION ALL SELECT query_id, 'missing_tests', -1 FROM r WHERE list_contains(rs, 'implementation') AND NOT list_contains(rs, 'test') UNION ALL SELECT query_id, 'missing_examples', -1 FROM r WHERE list_contains(rs, 'implementation') AND NOT list_contains(rs, 'example')
UNION ALL SELECT query_id, 'missing_manifest', -1 FROM r WHERE list_contains(rs, 'implementation') AND NOT list_contains(rs, 'manifest') UNION ALL SELECT query_id, 'missing_changelog', -1 FROM r WHERE list_has_any(ks, ['release_notes', 'tag', 'commit']) AND NOT list_contains(rs, 'changelog')
UNION ALL SELECT query_id, 'missing_security_policy', -1 FROM r WHERE list_contains(ks, 'security_advisory') AND NOT list_contains(rs, 'security_policy')""",
    "provenance_fits": cases.expected("part", "p_partkey", {"fit": [r[5] for r in _FITS]}),
    "distinct_advisories": f"""WITH RECURSIVE o AS (SELECT l_orderkey AS query_id, {_POS} AS pos, ['cve-' || l_partkey % 5, 'ghsa-' || l_suppkey % 7] AS ids, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_POS}) AS n FROM lineitem),
s AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS seen, 0::BIGINT AS pos, false AS ok FROM o UNION ALL SELECT s.query_id, o.n, CASE WHEN list_has_any(seen, ids) THEN seen ELSE list_concat(seen, ids) END, o.pos, NOT list_has_any(seen, ids) FROM s JOIN o ON o.query_id = s.query_id AND o.n = s.n + 1)
SELECT query_id, pos FROM s WHERE ok""",
    "advisory_windows": """WITH w(k, place, spec, fixed) AS (VALUES (0, 0, '<1.0', '1.0'), (0, 1, '>=2.0, <2.3', '1.0'), (1, 0, NULL, '1.0,2.0'), (2, 0, NULL, ''), (5, 0, '<5', ''))
SELECT p_partkey AS advisory_id, place, spec, fixed FROM part JOIN w ON p_partkey % 6 = k WHERE p_partkey % 13 > 0""",
    "focus_picks": """WITH RECURSIVE t AS (SELECT conv_id AS doc_id, turn::BIGINT AS pos, greatest((conv_id * 7 + turn * 5) % 11 - 3, 0) AS score, ((conv_id * 31 + turn * 170) % 400)::BIGINT AS n_chars FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM t WHERE score > 0),
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, []::BIGINT[] AS p, false AS z FROM o
  UNION ALL SELECT doc_id, n, CASE WHEN len(b) < 3 AND up AND NOT list_contains(b, pos + 1) THEN list_append(b, pos + 1) ELSE b END, false FROM (SELECT *, CASE WHEN len(a) < 3 AND down AND NOT list_contains(a, pos - 1) THEN list_append(a, pos - 1) ELSE a END AS b FROM
    (SELECT s.doc_id, o.n, o.pos, CASE WHEN len(s.p) < 3 AND NOT list_contains(s.p, o.pos) THEN list_append(s.p, o.pos) ELSE s.p END AS a, EXISTS (SELECT 1 FROM t x WHERE x.doc_id = o.doc_id AND x.pos = o.pos - 1 AND x.score > 0) AS down, EXISTS (SELECT 1 FROM t x WHERE x.doc_id = o.doc_id AND x.pos = o.pos + 1 AND x.score > 0) AS up
     FROM s JOIN o ON o.doc_id = s.doc_id AND o.n = s.n + 1 WHERE len(s.p) < 3))),
e AS (SELECT doc_id, arg_max(p, n) AS p FROM s GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS cand FROM o GROUP BY doc_id),
r AS (SELECT t.doc_id, t.pos, t.n_chars, len(e.p) < m.cand AS fewer, coalesce(sum(t.n_chars) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN e USING (doc_id) JOIN m USING (doc_id) WHERE list_contains(e.p, t.pos)),
k AS (SELECT *, before = 0 AND n_chars > 500 AS cut, (before = 0 AND n_chars > 500) OR before + n_chars <= 500 AS ok FROM r),
f AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS all_ok, bool_or(NOT ok OR cut) OVER (PARTITION BY doc_id) AS bad FROM k)
SELECT doc_id, pos, least(n_chars, 500) AS n_chars, fewer OR bad AS truncated FROM f WHERE all_ok""",
    "routed_providers": f"""WITH p(intent, place, provider) AS (VALUES ('code', 0, 'github_code'), ('code', 1, 'gitlab_code'), ('code', 2, 'gitea_code'), ('code', 3, 'sourcegraph'), ('issues', 0, 'github_issues'), ('issues', 1, 'gitlab_issues'), ('issues', 2, 'gitea_issues'), ('issues', 3, 'firecrawl_developer'),
  ('releases', 0, 'github_releases'), ('releases', 1, 'gitlab_releases'), ('releases', 2, 'gitea_releases'), ('security', 0, 'osv'), ('security', 1, 'github_advisory'), ('security', 2, 'nvd'), ('news', 0, 'tavily'), ('news', 1, 'brave_api')),
q AS (SELECT o_orderkey AS query_id, {cases.dealt("o_orderkey", _INTENTS)} AS intent, {cases.dealt("(o_orderkey * 5 % 7)", _SELECTED)} AS sel FROM orders),
r AS (SELECT query_id, place, provider, CASE WHEN provider = sel THEN 'already_selected' WHEN provider IN ('firecrawl_developer', 'gitea_releases', 'brave_api') THEN 'not_enabled' WHEN provider = 'gitlab_code' THEN 'not_built' WHEN provider = 'gitea_code' THEN 'cooling_down' WHEN provider = 'github_releases' THEN 'capability_missing' END AS why FROM q JOIN p USING (intent))
SELECT query_id, place, provider, coalesce(why, CASE WHEN count(*) FILTER (why IS NULL) OVER (PARTITION BY query_id ORDER BY place) <= 2 THEN 'added' ELSE 'cap_exceeded' END) AS disposition FROM r""",
    "dispatch_jobs": f"""WITH s AS (SELECT l_orderkey AS query_id, l_partkey % 3 AS priority, {_POS} AS no, CASE l_partkey % 2 WHEN 0 THEN 'docs' ELSE 'code' END AS r1, CASE l_suppkey % 3 WHEN 0 THEN 'issues' WHEN 1 THEN 'code' ELSE 'docs' END AS r2 FROM lineitem),
p(pno, provider, able) AS (VALUES (0, 'a', ['docs', 'code']), (1, 'b', ['code', 'issues']), (2, 'c', ['docs']), (3, 'd', []::VARCHAR[]))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY priority, no, pno) AS place, 's' || no AS label, provider, CASE WHEN list_contains(able, r1) AND list_contains(able, r2) THEN 'fully_supported' WHEN list_contains(able, r1) OR list_contains(able, r2) THEN 'partially_supported' ELSE 'unsupported' END AS disposition FROM s, p""",
    "provider_outcomes": f"""WITH g AS (SELECT DISTINCT l_orderkey AS q, CASE l_partkey % 3 WHEN 0 THEN 'a' ELSE 'b' END AS p FROM lineitem WHERE l_suppkey % 2 = 0),
f AS (SELECT l_orderkey AS q, CASE l_partkey % 3 WHEN 0 THEN 'b' ELSE 'c' END AS p, arg_min(CASE l_partkey % 2 WHEN 0 THEN 'timeout' ELSE 'blocked' END, {_POS}) AS c FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1, 2)
SELECT o_orderkey AS query_id, provider, CASE WHEN g.q IS NOT NULL THEN 'not_applicable' WHEN f.c = 'timeout' THEN 'deadline_prevented_completion' WHEN f.q IS NOT NULL THEN 'provider_failed' ELSE 'provider_skipped_by_policy' END AS absence
FROM orders CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(provider) LEFT JOIN g ON g.q = o_orderkey AND g.p = provider LEFT JOIN f ON f.q = o_orderkey AND f.p = provider""",
    "lane_coverage": "SELECT l_orderkey AS query_id, count(*) AS planned, count(*) FILTER (l_suppkey % 3 > 0) AS completed, sum(l_partkey % 9)::BIGINT AS cards FROM lineitem GROUP BY 1",
    "provider_latencies": f"WITH {ATTEMPTS} SELECT provider, count(*) AS calls, count(*) FILTER (outcome <> 'failed') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS longest_ms FROM attempts GROUP BY provider",
    "origin_circuits": f"""WITH e AS (SELECT user_id % 10 AS origin, event_id AS call_id, ts, {_OUTCOME} AS outcome FROM events), i AS (SELECT *, outcome IN ('retryable', 'rate_limited') AS again, sum((outcome NOT IN ('retryable', 'rate_limited'))::INT) OVER (PARTITION BY origin ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS isle FROM e),
n AS (SELECT *, sum(again::INT) OVER (PARTITION BY origin, isle ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM i)
SELECT call_id, n AS failures, CASE WHEN again THEN least(250 * (1 << least(n, 6)::INT), 10000)::BIGINT END AS longest_delay_ms, CASE WHEN again AND n >= 4 THEN strftime(ts + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') END AS open_until FROM n""",
    "hint_boosts": f"""WITH c AS (SELECT {", ".join(f"{v}{'::DOUBLE' if k == 'x' else ''} AS {_Q(k)}" for k, v in _BOOST.items())} FROM lineitem),
u AS (SELECT *, max(score::DOUBLE) OVER (PARTITION BY query_id, "group") AS best, CASE WHEN lower(url) LIKE '%tool%' THEN 1.5 ELSE 0 END + CASE WHEN lower(path) LIKE '%src%' THEN 1 ELSE 0 END + CASE WHEN lower(path) LIKE '%main.rs%' THEN 1 ELSE 0 END + CASE WHEN lower(language) = 'rust' THEN 0.5 ELSE 0 END
  + CASE WHEN lower(title) LIKE '%parse%' THEN 1 ELSE 0 END + CASE WHEN provider = 'github_issues' THEN 0.5 ELSE 0 END + CASE kind WHEN 'official_docs' THEN 1 WHEN 'release_notes' THEN 0.5 WHEN 'security_advisory' THEN 0.5 WHEN 'tag' THEN 0.5 ELSE 0 END + CASE WHEN confidence = 'high' THEN 0.5 ELSE 0 END
  + CASE WHEN strength LIKE 'exact%' THEN 0.5 ELSE 0 END + CASE WHEN authority IN ('official', 'primary') THEN 0.3 ELSE 0 END AS units FROM c),
r AS (SELECT *, round(CASE WHEN best > 0 AND units > 0 THEN coalesce(score, 0)::DOUBLE + units::DOUBLE * best * 0.1::DOUBLE ELSE score::DOUBLE END, 9) AS raised FROM u)
SELECT query_id, "group", row_number() OVER (PARTITION BY query_id, "group" ORDER BY raised DESC NULLS LAST, pos) AS place, pos, raised AS score FROM r""",
    "success_intervals": f"""WITH {ATTEMPTS}, c AS (SELECT provider, count(*) FILTER (outcome = 'success')::DOUBLE AS h, count(*)::DOUBLE AS n FROM attempts GROUP BY provider), p AS (SELECT *, h / n AS p, {_z}::DOUBLE AS z FROM c)
SELECT provider, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM p""",
}
