"""Queries over landmarks, request checks, trust, languages, remedies, references, hints, pages and budgets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import landmarks, local
from sievework.operators import dependencies, filing
from sievework.plans import cases
from sievework.plans.real import REAL
from sievework.session import table

_MARKS = [
    ("README", "readme", "readme_file"), ("docs/Readme.rst", "readme", "readme_file"), ("a/SECURITY.md", "security", "security_policy"), ("CONTRIBUTING", "contributing", "contributing_guide"), ("HISTORY.rst", "changelog", "changelog_file"), ("LICENSE-MIT", "license", "license_file"), ("copying.txt", "license", "license_file"),
    (".github/workflows/ci.yml", "ci_config", "github_actions_workflow"), ("a/.github/workflows/ci.yml", "unknown", None), (".gitlab-ci.yml", "ci_config", "gitlab_ci_config"), (".travis.yml", "ci_config", "travis_ci_config"), ("x/.travis.yml", "unknown", None), ("a/Dockerfile.dev", "dockerfile", "dockerfile"), ("compose.yaml", "dockerfile", "docker_compose"),
    ("a/Cargo.lock", "lockfile", "lockfile"), ("go.sum", "lockfile", "lockfile"), ("a/go.sum", "unknown", None), ("a/Cargo.toml", "manifest", "rust_manifest"), ("x.gemspec", "manifest", "ruby_manifest"), ("build.gradle.kts", "manifest", "jvm_manifest"), ("requirements.in", "manifest", "python_requirements"), (".vscode/a/b.json", "editor_config", "vscode_config"),
    (".gitignore", "git_ignore", "gitignore"), ("GNUmakefile", "build_script", "makefile"), ("build.rs", "build_script", "build_script"), ("a/build.rs", "unknown", None), ("docs/guide/x.md", "documentation", "documentation_directory"), ("readmes.md", "unknown", None), ("src/main.rs", "unknown", None),
]
_DIRS = [("src", "source_root"), ("SRC", "source_root"), ("a/src", "unknown"), ("demos", "examples"), ("__tests__", "tests"), ("wiki", "docs"), (".github/workflows", "ci_config"), (".github", "ci_config"), ("cfg", "config"), ("advisories", "security"), (".m2", "generated"), ("db/migrate", "migrations"), ("other", "unknown")]

#: query, results, start, end, fresh, include, exclude, language, excerpts, faults.
_ASKED = [
    ("q", None, None, None, None, "", "", None, None, ""), (" ", 0, None, None, "any", "", "", "en", 3, "query_empty,no_results_asked"), ("x" * 513, 1, None, None, None, "", "", None, None, "query_too_long"), ("q", 1, "2024-01-02", "2024-01-01", "any", "", "", None, None, "dates_reversed"),
    ("q", 1, "2024-01-01", "2024-02-30", "any", "", "", None, None, "date_invalid"), ("q", 1, "2024-01-01", " 2024-01-01", "week", "", "", None, None, "dates_and_freshness"), ("q", 1, "2024-01-01", None, "week", "", "", None, None, ""), ("q", 1, None, None, None, "a.com|b_c", "", None, None, "domain_invalid"),
    ("q", 1, None, None, None, "A.com", "b.com|a.com ", None, None, "domain_in_both"), ("q", 1, None, None, None, "", "*.x", "e", 4, "domain_invalid,language_invalid,too_many_excerpts"), ("q", 1, None, None, None, "", "", "pt-BR", 0, ""), ("q", 1, None, None, None, "", "", "1x", 0, "language_invalid"), (None, 1, None, None, None, "", "", "en-", 0, "query_empty,language_invalid"),
]
_ASKED_IN = cases.columns("q n s e f inc exc lang x", _ASKED)

_VERDICTS = cases.dealt("l_partkey", ["affected", "affected", "unknown", "insufficient_evidence", "not_affected"])


def important_paths(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", {"p": [r[0] for r in _MARKS], "d": [r[0] for r in _DIRS]}, real=REAL["important_paths"][0])
    return c.withColumn("m", landmarks.important_file(F.col("p"))).select("p_partkey", "m.kind", "m.reason", landmarks.important_folder(F.col("d"))["kind"].alias("folder"))


def request_faults(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", _ASKED_IN)
    split = lambda x: F.filter(F.split(x, r"\|"), lambda d: d != "")
    found = landmarks.faults(*[F.col(x) for x in "q n s e f".split()], split("inc"), split("exc"), F.col("lang"), F.col("x"))
    return c.select("event_id", F.array_join(found, ",").alias("faults"))


def trust_summary(spark, sf_dir):
    return filing.trust(table(spark, sf_dir, "events").selectExpr("user_id AS query_id", "CASE event_id % 4 WHEN 0 THEN 'local_trusted' ELSE 'external_untrusted' END AS trust", "event_id % 9 = 0 AS sanitized", "event_id % 11 = 0 AS truncated", "event_id % 2 = 0 AS framed", "event_id % 5 AS removed", "event_id % 7 AS injections"))


def language_shares(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS repo", f"{cases.dealt('l_partkey', ['rust', 'python', None, 'go', 'c'])} AS language", "l_partkey * 7 AS size")
    return filing.languages(t)


def verdicts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10000000000 + l_partkey * 100000 + l_linenumber * 10000 + l_suppkey AS finding_id", "concat('p', l_partkey % 97) AS package", f"{_VERDICTS} AS verdict", "CASE WHEN l_suppkey % 2 = 0 THEN array(concat(l_suppkey, '.1'), '9') ELSE array() END AS fixed")
    return t.withColumn("fixed", F.col("fixed").cast("array<string>"))


def word_references(spark, sf_dir):
    t = table(spark, sf_dir, "documents").withColumn("symbol", F.regexp_extract(F.coalesce("text", F.lit("")), r"([A-Za-z]{4,})", 1)).filter("symbol <> ''")
    return filing.references(t, t.select("symbol").distinct(), 3).select("doc_id", "symbol", "line", F.length("said").alias("n_chars"))


_TESTS = ["tests/core_test.rs", "src/core.rs", "lib/test_core.py", "src/inner/helper.rs", "docs/core.md", "a/tests/x.go", "src/x.spec.ts", "spec/other.rb"]
_BODIES = ["#[test]", "", "def test_x():", "nothing", None]


def test_hints(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS repo", f"{cases.dealt('p_partkey', ['src/core.rs', 'src/ab.rs', 'core.tar.gz'])} AS source", f"{cases.dealt('(p_partkey * 5)', _BODIES)} AS text")
    pairs = t.withColumn("test", F.explode(F.array(*[F.lit(x) for x in _TESTS])))
    return filing.test_hints(pairs)


def group_pages(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS query_id", "l_partkey AS group_no", "concat('g', l_partkey, '-', l_suppkey, '-', l_linenumber) AS `group`")
    return filing.paged(made, 2)


def finding_budgets(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS request", "l_suppkey % 3 AS file", "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS pos")
    return filing.budgeted(made, 2, 4)


def local_shares(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS pos", "l_suppkey % 3 AS k")
    return filing.with_local(t.filter("k = 0"), t.filter("k > 0"), 4)


_LOCKS = [("a/package-lock.json", "{", "malformed"), ("a/package-lock.json", '{"packages": {}}', "read"), ("x/readme.md", "x", "unsupported"), ("go.sum", "  \n", "empty"), ("Cargo.lock", 'name = "x"', "read"), ("composer.lock", "[1", "malformed")]


def dependency_statuses(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("p content", _LOCKS))
    return dependencies.statuses(c.selectExpr("concat(p_partkey, '/', p) AS path", "content"))


_CLONES = ["git@github.com:Acme/Tool.git", "https://gitlab.com/acme/tool", "https://github.com/acme/other", "nothing"]


def local_repos(spark, sf_dir):
    """Checkouts that are the repository that a request is about, by host, owner and name."""
    c = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{cases.dealt('p_partkey', _CLONES)} AS url").withColumn("r", local.remote(F.col("url")))
    asked = spark.createDataFrame([("github.com", "acme", "tool"), ("gitlab.com", "acme", "tool")], "host string, owner string, repo string")
    mine = c.select("p_partkey", F.lower("r.host").alias("host"), F.lower("r.owner").alias("owner"), F.lower("r.repo").alias("repo"))
    return mine.join(F.broadcast(asked), ["host", "owner", "repo"]).select("p_partkey", "host")


QUERIES = {
    "important_paths": important_paths, "request_faults": request_faults, "trust_summary": trust_summary, "language_shares": language_shares, "remedies": lambda s, d: filing.remedies(verdicts(s, d)), "verdict_counts": lambda s, d: filing.verdict_counts(verdicts(s, d)),
    "word_references": word_references, "test_hints": test_hints, "group_pages": group_pages, "finding_budgets": finding_budgets, "local_shares": local_shares, "dependency_statuses": dependency_statuses, "local_repos": local_repos,
}

_ID = "l_orderkey * 10000000000 + l_partkey * 100000 + l_linenumber * 10000 + l_suppkey"
_POS = "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey"
ORACLES = {
    "important_paths": cases.expected("part", "p_partkey", cases.columns("kind reason", [r[1:] for r in _MARKS]), real=REAL["important_paths"][1]).replace(" FROM part", f", {cases.dealt('p_partkey', [r[1] for r in _DIRS], real=REAL['important_paths'][1]['folder'])} AS folder FROM part"),
    "request_faults": cases.expected("events", "event_id", {"faults": [r[9] for r in _ASKED]}),
    "trust_summary": """SELECT user_id AS query_id, count(*) FILTER (event_id % 4 > 0) AS external, count(*) FILTER (event_id % 4 = 0) AS local, sum(event_id % 7)::BIGINT AS injections, sum(event_id % 5)::BIGINT AS removed,
  bool_or(event_id % 9 = 0) AS sanitized, bool_or(event_id % 11 = 0) AS truncated, bool_or(event_id % 2 = 0) AS framed FROM events GROUP BY user_id""",
    "language_shares": f"""WITH f AS (SELECT l_suppkey AS repo, {cases.dealt('l_partkey', ['rust', 'python', None, 'go', 'c'])} AS language, l_partkey * 7 AS size FROM lineitem), g AS (SELECT repo, language, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM f WHERE language IS NOT NULL GROUP BY repo, language)
SELECT *, round(bytes::DOUBLE / sum(bytes) OVER (PARTITION BY repo), 9) AS share FROM g""",
    "remedies": f"""SELECT {_ID} AS finding_id, CASE WHEN v = 'affected' AND l_suppkey % 2 = 0 THEN 'upgrade' ELSE 'manual_review' END AS action, CASE WHEN v = 'affected' AND l_suppkey % 2 = 0 THEN 'Upgrade p' || l_partkey % 97 || ' to version ' || l_suppkey || '.1 or later'
  ELSE 'Manual review required for p' || l_partkey % 97 || ' - ' || CASE v WHEN 'affected' THEN 'no fixed version available in advisory metadata' WHEN 'unknown' THEN 'applicability could not be determined' ELSE 'insufficient version/dependency data to assess' END END AS what FROM (SELECT *, {_VERDICTS} AS v FROM lineitem) WHERE v <> 'not_affected'""",
    "verdict_counts": f"SELECT 'p' || l_partkey % 97 AS package, count(*) FILTER (v = 'affected') AS affected, count(*) FILTER (v = 'not_affected') AS not_affected, count(*) FILTER (v = 'unknown') AS \"unknown\", count(*) FILTER (v = 'insufficient_evidence') AS insufficient_evidence FROM (SELECT *, {_VERDICTS} AS v FROM lineitem) GROUP BY 1",
    "word_references": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '([A-Za-z]{4,})', 1) AS symbol FROM documents), l AS (SELECT doc_id, symbol, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d WHERE symbol <> '')
SELECT doc_id, symbol, line, length(substr(trim(x), 1, 500)) AS n_chars FROM l WHERE regexp_matches(x, '(^|[^A-Za-z0-9_])' || symbol || '([^A-Za-z0-9_]|$)') QUALIFY row_number() OVER (PARTITION BY doc_id, symbol ORDER BY line) <= 3""",
    "test_hints": f"""WITH p AS (SELECT p_partkey AS repo, {cases.dealt('p_partkey', ['src/core.rs', 'src/ab.rs', 'core.tar.gz'])} AS source, {cases.dealt('(p_partkey * 5)', ['t', '', 't', '', ''])} = 't' AS syn FROM part),
t(test, by_path, core) AS (VALUES ('tests/core_test.rs', true, true), ('src/core.rs', false, true), ('lib/test_core.py', true, true), ('src/inner/helper.rs', false, false), ('docs/core.md', false, true), ('a/tests/x.go', true, false), ('src/x.spec.ts', true, false), ('spec/other.rb', false, false)),
m AS (SELECT *, core AND source = 'src/core.rs' AS named FROM p, t WHERE source <> test),
n AS (SELECT *, NOT syn AND NOT by_path AND NOT named AND source LIKE 'src/%' AND test LIKE 'src/%' AS pack FROM m),
r AS (SELECT repo, source, test, CASE WHEN syn THEN 1 WHEN by_path THEN 2 WHEN named THEN 3 WHEN pack THEN 4 END AS c, array_to_string(list_filter([CASE WHEN named THEN 'name_reference' END, CASE WHEN pack THEN 'package_boundary' END, CASE WHEN by_path THEN 'path_convention' END, CASE WHEN syn THEN 'syntax_test_item' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n)
SELECT repo, source, test, ['syntax', 'path', 'name_reference', 'package'][c] AS confidence, reasons, row_number() OVER (PARTITION BY repo, source ORDER BY c, test) AS place FROM r WHERE c IS NOT NULL""",
    "group_pages": """SELECT l_orderkey AS query_id, l_partkey AS group_no, concat('g', l_partkey, '-', l_suppkey, '-', l_linenumber) AS "group", (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, concat('g', l_partkey, '-', l_suppkey, '-', l_linenumber)) - 1) // 2 AS page,
  (count(*) OVER (PARTITION BY l_orderkey) + 1) // 2 AS pages FROM lineitem""",
    "finding_budgets": f"""WITH f AS (SELECT l_orderkey AS request, l_suppkey % 3 AS file, {_POS} AS pos FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY request, file ORDER BY pos) AS k, count(*) OVER (PARTITION BY request, file) AS n FROM f)
SELECT request, file, pos, n > 2 AS cut FROM k WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY request ORDER BY file, pos) <= 4""",
    "local_shares": f"""WITH t AS (SELECT l_orderkey AS query_id, {_POS} AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'local' ELSE 'remote' END AS origin FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, origin ORDER BY pos) AS k FROM t),
r AS (SELECT query_id, pos, origin, row_number() OVER (PARTITION BY query_id ORDER BY origin, pos) AS place FROM k WHERE origin = 'remote' OR k <= 2) SELECT * FROM r WHERE place <= 4""",
    "dependency_statuses": f"SELECT p_partkey || '/' || {cases.dealt('p_partkey', [r[0] for r in _LOCKS])} AS path, {cases.dealt('p_partkey', [r[2] for r in _LOCKS])} AS status FROM part",
    "local_repos": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'github.com' ELSE 'gitlab.com' END AS host FROM part WHERE p_partkey % 4 < 2",
}
