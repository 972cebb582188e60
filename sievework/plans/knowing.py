"""Queries over identifiers, outcomes, warnings, files, links and remotes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import ids, local, outcomes, queries
from sievework.operators import measures
from sievework.plans import cases
from sievework.plans.real import REAL
from sievework.session import table

#: URL and its canonical form.
_URLS = [
    ("HTTP://WWW.Example.com:80/A/B//?b=2&a=1#x", "http://example.com/A/B?b=2&a=1"), ("https://example.com", "https://example.com/"), ("https://example.com?q=/x/", "https://example.com?q=/x"), ("https://Example.com?Q=x", "https://example.com/?Q=x"),
    ("https://User:Pw@WWW.example.com:443/", "https://User:Pw@example.com/"), ("https://example.com:8443/a/", "https://example.com:8443/a"), ("https://example.com/%7euser/%2f%41", "https://example.com/~user/%2FA"),
    ("https://example.com/a b/ü?ü=%c3%bc x", "https://example.com/a%20b/%C3%BC?%C3%BC=%C3%BC x"), ("https://example.com/a+b/(c)", "https://example.com/a%2Bb/%28c%29"), ("ftp://example.com:80/x#", "ftp://example.com:80/x"),
    ("  a/b/?x=1#f ", "a/b?x=1"), ("/", "/"), ("https://www.example.com/100%", "https://example.com/100%25"), (None, None),
]

#: outcome, truncation, state; kind, status, reason, class.
_OUTCOMES = [
    ("success_with_results", "none", "satisfied"), ("success_with_results", "confirmed_by_provider", "partial"), ("success_with_results", "limit_reached_unknown", "satisfied"), ("failed", "confirmed_by_engine", "partial"),
    ("success_zero_results", None, "completed_no_match"), ("timed_out", "none", "failed"), ("rate_limited", "none", "failed"), ("skipped_by_policy", "none", "skipped_by_policy"), ("skipped_capability_unavailable", "none", "capability_unavailable"),
    ("interrupted_by_deadline", "none", "interrupted"), ("truncated_after_partial_success", "none", "partial"), ("not_applicable", "none", "not_applicable"),
]
_ERRORS = [
    ("timeout", None, None, "timeout"), ("bad_status", 429, None, "rate_limited"), ("bad_status", 503, None, "http_status"), ("parse_failed", None, None, "parse_error"), ("blocked", None, None, "blocked"),
    ("network_error", None, "engine panicked during dispatch", "panic"), ("network_error", None, "reset", "network_error"), ("network_error", None, None, "network_error"), ("http", 200, None, "network_error"), ("unsupported", None, None, "unknown"), ("other", None, None, "unknown"),
]
#: provider, enabled, configured, needs a key, searxng is configured, code.
_SKIPS = [
    ("brave", True, True, True, False, None), ("brave", False, True, True, False, "disabled_by_user"), ("local_workspace", True, False, True, False, "missing_local_backend"), ("exa", True, False, True, False, "missing_api_key"),
    ("my_searxng", True, False, False, False, "missing_searxng_config"), ("my_searxng", True, False, False, True, "unknown"), ("brave", True, False, False, False, "unknown"),
]
#: message, code, severity, text.
_WARNINGS = [
    ("profile_partial: two of three: ok", "profile_partial", "warning", "two of three: ok"), ("intent_routing_capability_excluded: x", "intent_routing_excluded", "warning", "x"), ("kev_match: CVE-1", "kev_match", "error", "CVE-1"),
    ("local_repo_match: here", "local_repo_match", "info", "here"), ("generic_context_untrusted: x", "generic_context_untrusted", "notice", "x"), ("[timeout] after 5 s", "provider_timeout", "error", "after 5 s"), ("[rate_limited]  wait", "provider_rate_limited", "warning", "wait"),
    ("[http_status] 503: down", "provider_failed", "error", "503: down"), ("odd: text", "unknown_warning", "warning", "odd: text"), ("[open", "unknown_warning", "warning", "[open"), ("", "unknown_warning", "warning", ""), ("kev_match:no space", "unknown_warning", "warning", "kev_match:no space"),
]
_LEVELS = [("CRITICAL", "critical", 4), ("crit", "critical", 4), ("Important", "high", 3), ("moderate", "medium", 2), ("med", "medium", 2), ("minor", "low", 1), ("none", "unknown", 0), (None, "unknown", 0)]

#: page, link, kind.
_LINKS = [
    ("https://a.example/x?q=1", "https://a.example/x?q=1#top", "same_page_anchor"), ("https://a.example/x?q=1", "https://a.example/x?q=2", "same_domain"), ("https://a.example/x", "https://b.example/f.PDF?x", "pdf"), ("https://a.example/x", "https://b.example/f.jpeg", "image"),
    ("https://a.example/x", "https://b.example/f.tsx", "source_code"), ("https://a.example/x", "https://b.example/f.tar", "download"), ("https://a.example/x", "https://b.example/blog/feed", "feed"), ("https://a.example/x", "https://github.com/a/b/issues/1", "issue"),
    ("https://a.example/x", "https://gitlab.com/a/b/-/merge_requests/2", "pull_request"), ("https://a.example/x", "https://github.com/a/b/releases/tag/v1", "release"), ("https://a.example/x", "https://b.example/issues/1", "external"), ("https://a.example/x", "https://b.example/security/x", "security_advisory"),
    ("https://a.example/x", "https://docs.rs/api/x", "api_reference"), ("https://a.example/x", "https://foo.readthedocs.io/x", "documentation"), ("https://a.example/x", "https://b.example/guide/x", "documentation"), ("https://a.example/x", "https://b.example/guides", "external"), ("https://a.example", "https://a.example/", "same_page_anchor"),
]
#: remote, kind, host, owner, repo.
_REMOTES = [
    ("https://github.com/owner/repo.git", "github", "github.com", "owner", "repo"), ("git@github.com:owner/repo.git", "github", "github.com", "owner", "repo"), ("ssh://git@gitlab.com:22/group/sub/repo.git", "gitlab", "gitlab.com", "group/sub", "repo"),
    ("git://codeberg.org/o/r/", "codeberg", "codeberg.org", "o", "r"), ("https://gitlab.acme.io/o/r", "gitlab", "gitlab.acme.io", "o", "r"), ("forgejo.acme.io:o/r", "gitea", "forgejo.acme.io", "o", "r"), ("https://code.acme.io/o/r", "unknown", "code.acme.io", "o", "r"),
    ("https://github.com/owner", None, None, None, None), ("file:///tmp/x", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None),
]
#: title, start of the body, kind.
_PAGES = [
    ("Just a moment...", "", "verification"), (None, "ANUBIS_CHALLENGE", "anubis"), ("x", "see captcha/challenge", "altcha"), ("Access Denied", "", "interactive"), ("x", "<div class='g-recaptcha'>", "interactive"), ("x", "Checking your browser", "verification"), ("plain", "plain", None), (None, None, None),
]
#: time as given, in UTC.
_TIMES = [
    ("2024-02-29T12:30:00Z", "2024-02-29 12:30:00"), ("2024-02-29t12:30:00.5+02:00", "2024-02-29 10:30:00"), (" 2024-01-02 ", "2024-01-02 00:00:00"), ("2024-13-01", None), ("2024-02-29T12:30:00", None), ("yesterday", None), ("", None), (None, None), ("2023-02-29", None),
]
#: path, size, whether it is indexed.
_FILES = [
    ("src/main.rs", 10, True), ("src/.hidden/a.rs", 10, False), (".github/x.yml", 10, False), ("a/node_modules/x.js", 10, False), ("a/targets/x.js", 10, True), ("logo.PNG", 10, False), ("a.tar.gz", 10, False), ("big.txt", 2000, False), ("Makefile", 1000, True), (".env", 1, False), ("x.min.js", 5, True),
]
#: path, language, role, score for "main.rs parse".
_SCORED = [
    ("src/main.rs", "rust", "implementation", 20.0 + 5 + 10), ("main.rs parse", "rust", "implementation", 100.0 + 40 + 5 + 10), ("src/parse/main.rs", "rust", "test", 40.0 + 5 + 5), ("README.md", None, "readme", 12.0), ("parse.lock", None, "lockfile", 20.0 - 150), ("docs/parse.md", "markdown", "documentation", 20.0 + 5 + 8), ("x.py", "python", "vendor", 0.0),
]
_DOMAINS = [("Example.COM ", True), ("https://a.b", False), ("a..b", False), ("-a.b", False), ("a.b:80", False), ("*.a", False), ("x-y.z", True), ("", False), ("a b", False), ("a" * 64 + ".b", False), (".".join(["a" * 63] * 4), False), ("a/b", False)]


def canonical_urls(spark, sf_dir):
    return cases.given(spark, sf_dir, "pages", "page_id", {"u": [u for u, _ in _URLS]}, real=REAL["canonical_urls"][0]).select("page_id", ids.canonical_url(F.col("u")).alias("url"))


def stable_ids(spark, sf_dir):
    """Identifiers of sources, documents, chunks, spans, places, queries and plans."""
    p = table(spark, sf_dir, "pages").withColumn("title", F.expr("nullif(concat('Page ', page_id % 7), 'Page 3')"))
    doc = ids.document_id(F.col("url"), F.col("title"), F.lit("html"), namespace="x")
    n = F.col("page_id").cast("long")
    return p.select(
        "page_id",
        ids.source_id(F.lit("brave"), F.col("url"), F.col("title"), F.lit("unknown"), namespace="x").alias("source"),
        ids.chunk_id(doc, n, F.lit("A/B"), namespace="x").alias("chunk"),
        ids.span_id(F.lit("loc"), F.nullif(n % 3, F.lit(1)), n, F.col("title"), namespace="x").alias("span"),
        ids.locator_id(F.lit("GitHub"), F.lit("Acme"), F.lit("Tool.git"), F.lit(None), F.concat(F.lit("/Src/"), n, F.lit("/")), namespace="x").alias("place"),
        ids.query_fingerprint(F.col("url"), namespace="x").alias("query"),
        ids.plan_key("web_fetch", ids._prefixed(F.col("url")), ids.place_number(n), namespace="x").alias("plan"),
    )


def dimension_states(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("outcome truncation", _OUTCOMES), real=REAL["dimension_states"][0])
    return c.select("event_id", outcomes.dimension_state(F.col("outcome"), F.col("truncation")).alias("state"))


def dimension_summary(spark, sf_dir):
    """Roles seen, complete and indeterminate of each request, and counts of its dimensions."""
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("outcome truncation", _OUTCOMES)).selectExpr("event_id % 101 AS query_id", "event_id * 7 % 5 AS role", "outcome", "truncation")
    return measures.dimensions(c.withColumn("state", outcomes.dimension_state(F.col("outcome"), F.col("truncation"))))


def error_classes(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("kind status reason", _ERRORS), real=REAL["error_classes"][0])
    return c.select("event_id", outcomes.error_class(F.col("kind"), F.col("status"), F.col("reason")).alias("class"))


def skip_codes(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("provider enabled configured needs_key has_searxng", _SKIPS))
    return c.select("event_id", outcomes.skip_code(*[F.col(x) for x in "provider enabled configured needs_key has_searxng".split()]).alias("code"))


def warning_codes(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", {"m": [r[0] for r in _WARNINGS]})
    return c.select("event_id", outcomes.warning(F.col("m")).alias("w")).select("event_id", "w.*")


def distinct_warnings(spark, sf_dir):
    """The first of the warnings of a request that share code and providers."""
    c = cases.given(spark, sf_dir, "events", "event_id", {"m": [r[0] for r in _WARNINGS]}).withColumn("w", outcomes.warning(F.col("m")))
    made = c.select(F.expr("event_id % 53").alias("query_id"), F.col("event_id").alias("pos"), "w.code", F.expr("array(concat('p', event_id % 2), concat('p', event_id % 3))").alias("providers"))
    return measures.first_warnings(made).select("query_id", "pos", "code")


def severities(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", {"s": [r[0] for r in _LEVELS]}, real=REAL["severities"][0])
    return c.withColumn("level", outcomes.severity(F.col("s"))).select("p_partkey", "level", outcomes.severity_rank(F.col("level")).alias("rank"))


def link_kinds(spark, sf_dir):
    return cases.given(spark, sf_dir, "pages", "page_id", cases.columns("page link", _LINKS), real=REAL["link_kinds"][0]).select("page_id", local.link_kind(F.col("page"), F.col("link")).alias("kind"))


def remotes(spark, sf_dir):
    return cases.given(spark, sf_dir, "part", "p_partkey", {"u": [r[0] for r in _REMOTES]}, real=REAL["remotes"][0]).select("p_partkey", local.remote(F.col("u")).alias("r")).select("p_partkey", "r.kind", "r.host", "r.owner", "r.repo")


def challenges(spark, sf_dir):
    c = cases.given(spark, sf_dir, "pages", "page_id", cases.columns("t b", _PAGES), real=REAL["challenges"][0])
    return c.select("page_id", local.challenge(F.col("t"), F.col("b")).alias("kind"))


def timestamps(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", {"t": [t for t, _ in _TIMES]}, real=REAL["timestamps"][0])
    return c.select("p_partkey", F.date_format(local.timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def file_scores(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("path size", _FILES) | cases.columns("p language role", _SCORED))
    score = local.file_score(F.col("p"), F.lit("main.rs parse"), F.array(F.lit("main.rs"), F.lit("parse")), F.col("language"), F.col("role"))
    return c.select("p_partkey", local.eligible(F.col("path"), F.col("size"), 1000).alias("indexed"), score.alias("score"))


def domain_checks(spark, sf_dir):
    return cases.given(spark, sf_dir, "part", "p_partkey", {"d": [d for d, _ in _DOMAINS]}, real=REAL["domain_checks"][0]).select("p_partkey", queries.domain(F.col("d")).isNotNull().alias("valid"))


QUERIES = {
    "canonical_urls": canonical_urls, "stable_ids": stable_ids, "dimension_states": dimension_states, "dimension_summary": dimension_summary, "error_classes": error_classes, "skip_codes": skip_codes,
    "warning_codes": warning_codes, "distinct_warnings": distinct_warnings, "severities": severities, "link_kinds": link_kinds, "remotes": remotes, "challenges": challenges, "timestamps": timestamps,
    "file_scores": file_scores, "domain_checks": domain_checks,
}

# A hash in DuckDB: the bytes of a hexadecimal text, folded.
_HASH = "printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({h}), 2), lambda i: ((strpos('0123456789ABCDEF', substr({h}, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({h}, i + 1, 1)) - 1)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)"
_F = "rpad(printf('%02X', octet_length(encode(coalesce({x}, ''))) % 256) || printf('%02X', octet_length(encode(coalesce({x}, ''))) // 256), 8, '0') || hex(encode(coalesce({x}, '')))"
_N4, _N8 = "printf('%02X%02X0000', {n} % 256, {n} // 256)", "printf('%02X%02X000000000000', {n} % 256, {n} // 256)"
_head = lambda entity: hex_of("x\0" + entity + "\0")


def hex_of(text: str) -> str:
    return "'" + text.encode().hex().upper() + "'"


_CANON = cases.dealt("page_id", [c for _, c in _URLS])
_CANON_PAGE = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\\?|$)', '\\1')"
_f = lambda x: _F.format(x=x)
_TITLE = "nullif('Page ' || page_id % 7, 'Page 3')"
_N_STATES = "CASE state WHEN 'failed' THEN 1 WHEN 'interrupted' THEN 1 ELSE 0 END"
ORACLES = {
    "canonical_urls": cases.expected("pages", "page_id", {"url": [c for _, c in _URLS]}, real=REAL["canonical_urls"][1]),
    "stable_ids": f"""WITH p AS (SELECT page_id, url, {_TITLE} AS title, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site, regexp_replace(url, '#.*$', '') AS bare FROM pages),
c AS (SELECT *, replace(site, '://www.', '://') || CASE WHEN regexp_replace(string_split(substr(bare, length(site) + 1), '?')[1], '/+$', '') = '' THEN '/' ELSE regexp_replace(string_split(substr(bare, length(site) + 1), '?')[1], '/+$', '') END || regexp_extract(bare, '\\?.*$', 0) AS canon FROM p),
d AS (SELECT *, {_head("source")} || {_f("'brave'")} || {_f("canon")} || {_f("title")} || {_f("'unknown'")} AS h1, {_head("doc")} || {_f("canon")} || {_f("title")} || {_f("'html'")} AS h2,
  {_head("code_span")} || {_f("'loc'")} || CASE page_id % 3 WHEN 1 THEN '00000000' WHEN 0 THEN 'FFFFFFFF' ELSE '02000000' END || CASE WHEN page_id = 0 THEN 'FFFFFFFF' ELSE {_N4.format(n="page_id")} END || {_f("title")} AS h4,
  {_head("locator")} || {_f("'github'")} || {_f("'acme'")} || {_f("'tool'")} || {_f("''")} || {_f("'src/' || page_id")} AS h5, {hex_of("x-query" + chr(0))} || hex(encode(url)) AS h6,
  {_head("request_plan")} || {_f("'web_fetch'")} || {_f("url")} || {_N8.format(n="page_id")} AS h7 FROM c),
e AS (SELECT *, {_head("chunk")} || {_f("'doc_' || " + _HASH.format(h="h2"))} || {_N8.format(n="page_id")} || {_f("'A/B'")} AS h3 FROM d)
SELECT page_id, 'src_' || {_HASH.format(h="h1")} AS source, 'chunk_' || {_HASH.format(h="h3")} AS chunk, 'span_' || {_HASH.format(h="h4")} AS span, 'loc_' || {_HASH.format(h="h5")} AS place, 'fp_' || {_HASH.format(h="h6")} AS query, {_HASH.format(h="h7")} AS plan FROM e""",
    "dimension_states": cases.expected("events", "event_id", {"state": [r[2] for r in _OUTCOMES]}, real=REAL["dimension_states"][1]),
    "dimension_summary": f"""WITH s AS (SELECT event_id % 101 AS query_id, event_id * 7 % 5 AS role, {cases.dealt("event_id", [r[2] for r in _OUTCOMES])} AS state, {cases.dealt("event_id", [r[1] for r in _OUTCOMES])} AS cut FROM events)
SELECT query_id, count(DISTINCT role) AS roles_attempted, count(DISTINCT role) FILTER (state IN ('satisfied', 'completed_no_match')) AS roles_complete,
  count(DISTINCT role) FILTER (state IN ('failed', 'skipped_by_policy', 'capability_unavailable', 'interrupted', 'partial')) AS roles_indeterminate, count(*) AS attempted,
  count(*) FILTER (state IN ('satisfied', 'completed_no_match', 'partial', 'not_applicable')) AS completed, count(*) FILTER (state IN ('failed', 'interrupted')) AS failed, count(*) FILTER (state = 'not_applicable') AS not_applicable,
  bool_or(state IN ('failed', 'interrupted')) AS has_failures, bool_or(state = 'partial' OR coalesce(cut IN ('confirmed_by_engine', 'confirmed_by_provider'), false)) AS has_truncation FROM s GROUP BY query_id""",
    "error_classes": cases.expected("events", "event_id", {"class": [r[3] for r in _ERRORS]}, real=REAL["error_classes"][1]),
    "skip_codes": cases.expected("events", "event_id", {"code": [r[5] for r in _SKIPS]}),
    "warning_codes": cases.expected("events", "event_id", cases.columns("code severity text", [r[1:] for r in _WARNINGS])),
    "distinct_warnings": f"""SELECT query_id, pos, code FROM (SELECT event_id % 53 AS query_id, event_id AS pos, {cases.dealt("event_id", [r[1] for r in _WARNINGS])} AS code,
  least(event_id % 2, event_id % 3) AS a, greatest(event_id % 2, event_id % 3) AS b FROM events) QUALIFY row_number() OVER (PARTITION BY query_id, code, a, b ORDER BY pos) = 1""",
    "severities": cases.expected("part", "p_partkey", cases.columns("level rank", [r[1:] for r in _LEVELS]), real=REAL["severities"][1]).replace("AS rank", 'AS "rank"'),
    "link_kinds": cases.expected("pages", "page_id", {"kind": [r[2] for r in _LINKS]}, real=REAL["link_kinds"][1]),
    "remotes": cases.expected("part", "p_partkey", cases.columns("kind host owner repo", [r[1:] for r in _REMOTES]), real=REAL["remotes"][1]),
    "challenges": cases.expected("pages", "page_id", {"kind": [r[2] for r in _PAGES]}, real=REAL["challenges"][1]),
    "timestamps": cases.expected("part", "p_partkey", {"at": [r[1] for r in _TIMES]}, real=REAL["timestamps"][1]).replace("AS at", 'AS "at"'),
    "file_scores": cases.expected("part", "p_partkey", {"indexed": [r[2] for r in _FILES]}).replace(" FROM part", f", CAST({cases.dealt('p_partkey', [r[3] for r in _SCORED])} AS DOUBLE) AS score FROM part"),
    "domain_checks": cases.expected("part", "p_partkey", {"valid": [v for _, v in _DOMAINS]}, real=REAL["domain_checks"][1]),
}
