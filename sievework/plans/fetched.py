"""Queries over suggested fetches, merged metadata, folders and references, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import fetching
from sievework.session import table
from sievework.sources import derived

_GROUPS = ["official_docs", "source_files", "issues", "tests", "changelog", "other"]
_ROLES = ["implementation", "test", "configuration", "changelog", "readme"]


def _pick(values: list, key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: SQL of both engines: cards of a request, one for each line of an order; links and files named by ship mode and comment.
_CARD = {
    "query_id": "l_suppkey", "pos": "(l_orderkey * 8 + l_linenumber) * 10000000 + CAST(round(l_extendedprice * 100) AS bigint) % 10000000", "kind": "CASE l_partkey % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'source_file' END", "grp": _pick(_GROUPS, "(l_partkey + l_linenumber)"),
    "role": f"CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE {_pick(_ROLES, 'l_partkey')} END", "score": "CAST(floor(l_quantity) AS bigint) % 29", "url": "concat('https://', lower(l_returnflag), l_partkey % 3, '.example.org/', l_orderkey % 50)",
    "raw_permalink": "CASE WHEN l_partkey % 11 = 0 THEN concat('https://raw.example.net:8080/', l_orderkey % 7) END", "browser_url": "CASE WHEN l_partkey % 4 = 1 THEN concat('https://CODE.example.com/', l_orderkey % 9) END",
    "host": "CASE l_linenumber % 4 WHEN 0 THEN 'gitlab' WHEN 1 THEN 'codeberg' WHEN 2 THEN 'github' END", "owner": "CASE WHEN l_partkey % 13 > 0 THEN concat('o', l_partkey % 3) END", "repo": "concat('r', l_partkey % 2)",
    "ref": "CASE WHEN l_orderkey % 3 > 0 THEN 'v1' END", "path": "CASE WHEN l_linenumber % 6 = 0 THEN 'top.rs' ELSE concat('src/', lower(l_linestatus), '/f', l_partkey, '.rs') END",
}


def suggested_fetches(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in _CARD.items()]).withColumnRenamed("grp", "group")
    return fetching.suggested(cards.withColumns({"raw_url": F.lit(None).cast("string"), "permalink": F.lit(None).cast("string")}))


_KEY = "regexp_replace(url, '[?#].*$', '')"
#: SQL of both engines: what one provider's row of an address knows.
_META = {
    "key": _KEY, "o": "rank * 10 + CAST(substr(provider, 2) AS int)", "kind": "CASE WHEN (rank + length(provider || title)) % 3 = 0 THEN NULL WHEN (rank + length(title)) % 5 = 1 THEN 'release' ELSE 'issue' END",
    "state": "CASE WHEN rank % 4 = 0 THEN concat('s', rank) END", "owner": "CASE WHEN provider = 'p3' THEN substr(title, 1, 4) END", "number": "CASE WHEN rank % 3 = 1 THEN rank END",
}


def merged(spark, sf_dir):
    hits = derived.hits(spark, sf_dir)
    labels = F.expr("filter(array(substr(title, 1, 2), provider, substr(title, 1, 2), CASE WHEN rank % 2 = 0 THEN 'even' END), x -> x IS NOT NULL)").alias("labels")
    rows = hits.selectExpr("query_id", *[f"{v} AS {k}" for k, v in _META.items()], "title", "provider", "rank").select("*", labels)
    got = fetching.merged_metadata(rows, ["query_id", "key"], "o", "kind", ["state", "owner", "number"], ["labels"])
    return got.select("query_id", "key", "kind", "state", "owner", "number", F.array_join("labels", ",").alias("labels"))


_HOST, _PATH = "regexp_extract(url, '://([^/?#]*)', 1)", "regexp_extract(url, '://[^/?#]*/([^?#]*)', 1)"


def folders(spark, sf_dir):
    """Pages as files of a tree for each host's top name, with their lengths as sizes."""
    entries = table(spark, sf_dir, "pages").selectExpr(f"regexp_extract({_HOST}, '([^.]*)$', 1) AS repo", f"concat({_HOST}, '/', {_PATH}, '/', length(html) % 5, '/', page_id) AS path", "length(html) AS size")
    return fetching.folder_totals(entries, most_deep=5)


#: SQL of both engines: a page's place as 'ref/path', and references that some pages name.
_SPEC = f"concat({_PATH}, '/', substr(regexp_extract(html, '<title>([^<]*)', 1), 1, 3), '/', page_id % 4)"
_REF = f"CASE WHEN page_id % 3 = 0 THEN regexp_replace({_PATH}, '/[^/]*$', '') ELSE {_PATH} END"


def references(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = pages.selectExpr("page_id", f"{_HOST} AS repo", f"CASE WHEN page_id % 9 = 4 THEN NULL ELSE {_SPEC} END AS spec")
    refs = pages.filter("page_id % 2 = 0").selectExpr(f"{_HOST} AS repo", f"{_REF} AS ref")
    return fetching.told_apart(asked, refs).select("page_id", "ref", "path")


def _raw(path: str) -> str:
    shapes = {"gitlab": "'https://gitlab.com/' || owner || '/' || repo || '/-/raw/' || r || '/'", "codeberg": "'https://codeberg.org/' || owner || '/' || repo || '/raw/branch/' || r || '/'"}
    return "CASE host " + " ".join(f"WHEN '{h}' THEN {s} || {path}" for h, s in shapes.items()) + f" ELSE 'https://raw.githubusercontent.com/' || owner || '/' || repo || '/' || r || '/' || {path} END"


_FILE = "string_split(path, '/')[-1]"
QUERIES = {"suggested_fetches": suggested_fetches, "merged_metadata": merged, "folder_totals": folders, "resolved_references": references}
ORACLES = {
    "suggested_fetches": f"""WITH RECURSIVE c AS (SELECT *, coalesce(raw_permalink, browser_url, url) AS link FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _CARD.items())} FROM lineitem)),
x AS (SELECT *, lower(regexp_extract(link, '://([^/:]*)', 1)) AS domain, first(host IS NOT NULL AND owner IS NOT NULL AND ref IS NOT NULL) OVER (PARTITION BY query_id, link ORDER BY pos) AS located, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS n FROM c),
w(query_id, n, took, ds, gs, k) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], 0 FROM x
  UNION ALL SELECT query_id, n, CASE WHEN ok THEN n ELSE 0 END, CASE WHEN ok THEN list_append(ds, domain) ELSE ds END, CASE WHEN ok THEN list_append(gs, grp) ELSE gs END, k + ok::INT FROM (
    SELECT w.query_id, x.n, ds, gs, k, x.domain, x.grp, k < 8 AND len(list_filter(ds, lambda y: y = x.domain)) < 2 AND len(list_filter(gs, lambda y: y = x.grp)) < 2 AS ok FROM w JOIN x ON x.query_id = w.query_id AND x.n = w.n + 1 WHERE k < 8)),
p AS (SELECT query_id, n, k AS place, len(list_filter(ds, lambda y: y = ds[-1])) AS nd, len(list_filter(gs, lambda y: y = gs[-1])) AS ng FROM w WHERE took > 0),
best AS (SELECT p.query_id, place, link AS url, CASE grp WHEN 'official_docs' THEN 'official_docs' WHEN 'source_files' THEN 'source_evidence' WHEN 'issues' THEN 'issue_context' WHEN 'tests' THEN 'test_evidence' WHEN 'changelog' THEN 'changelog_source' ELSE 'suggested_evidence' END AS reason, grp AS "group",
  CASE WHEN located AND row_number() OVER (PARTITION BY p.query_id, link ORDER BY place) = 1 THEN 'repo_fetch' ELSE 'web_fetch' END AS tool, CASE WHEN grp IN ('official_docs', 'changelog') OR kind = 'docs' THEN 'markdown' END AS mode, CASE WHEN nd = 1 AND ng = 1 THEN 1.0 WHEN nd <= 2 AND ng <= 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS gain, score::DOUBLE AS score, pos
  FROM p JOIN x USING (query_id, n)),
f AS (SELECT *, coalesce(ref, 'main') AS r FROM c WHERE owner IS NOT NULL),
o AS (SELECT query_id, pos, 0 AS k, {_raw("'tests/' || " + _FILE)} AS url, 'nearby_test_candidate' AS reason, 'tests' AS g, 'repo_fetch' AS tool, NULL::VARCHAR AS mode FROM f WHERE role = 'implementation' AND contains(path, '/')
  UNION ALL SELECT query_id, pos, 1, {_raw("'examples/' || " + _FILE)}, 'example_candidate', 'examples', 'repo_fetch', NULL::VARCHAR FROM f WHERE role = 'implementation' AND contains(path, '/')
  UNION ALL SELECT query_id, pos, 2, {_raw("'Cargo.toml'")}, 'manifest_context', 'repository', 'repo_fetch', NULL::VARCHAR FROM f WHERE role IN ('implementation', 'configuration')
  UNION ALL SELECT query_id, pos, 0, {_raw("'src/' || " + _FILE)}, 'implementation_candidate', 'source_files', 'repo_fetch', NULL::VARCHAR FROM f WHERE role = 'test' AND contains(path, '/')
  UNION ALL SELECT query_id, pos, 0, url, 'changelog_source', 'changelog', 'web_fetch', 'markdown' FROM f WHERE role = 'changelog'),
oo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, k) AS n FROM o QUALIFY n <= 8)
SELECT query_id, CAST(place AS INT) AS place, url, reason, "group", tool, mode, gain, score, pos FROM best
UNION ALL SELECT query_id, CAST(n + coalesce((SELECT max(place) FROM p WHERE p.query_id = oo.query_id), 0) AS INT), url, reason, g, tool, mode, NULL, NULL, pos FROM oo""",
    "merged_metadata": f"""WITH {derived.HITS}, r AS (SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in _META.items())}, list_filter([substr(title, 1, 2), provider, substr(title, 1, 2), CASE WHEN rank % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS labels FROM hits),
k AS (SELECT query_id, key, arg_min(kind, o) FILTER (WHERE kind IS NOT NULL) AS kind FROM r GROUP BY ALL),
f AS (SELECT k.query_id, k.key, k.kind, arg_min(state, o) FILTER (WHERE state IS NOT NULL) AS state, arg_min(owner, o) FILTER (WHERE owner IS NOT NULL) AS owner, arg_min(number, o) FILTER (WHERE number IS NOT NULL) AS number FROM k LEFT JOIN r ON r.query_id = k.query_id AND r.key = k.key AND r.kind = k.kind GROUP BY ALL),
e AS (SELECT query_id, key, kind, label, min(o * 10 + i) AS at_ FROM (SELECT query_id, key, kind, o, unnest(labels) AS label, unnest(range(len(labels))) AS i FROM r WHERE kind IS NOT NULL) GROUP BY ALL),
l AS (SELECT query_id, key, kind, string_agg(label, ',' ORDER BY at_) AS labels FROM e GROUP BY ALL)
SELECT f.query_id, f.key, f.kind, state, owner, number, coalesce(labels, CASE WHEN f.kind IS NOT NULL THEN '' END) AS labels FROM f LEFT JOIN l ON l.query_id = f.query_id AND l.key = f.key AND l.kind = f.kind""",
    "folder_totals": f"""WITH e AS (SELECT regexp_extract({_HOST}, '([^.]*)$', 1) AS repo, list_filter(string_split(concat({_HOST}, '/', {_PATH}, '/', length(html) % 5, '/', page_id), '/'), lambda x: x <> '') AS p, length(html) AS size FROM pages),
u AS (SELECT repo, unnest(range(0, len(p))) AS depth, p, size FROM e WHERE len(p) <= 5),
t AS (SELECT repo, depth, p[:depth] AS f, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM u GROUP BY ALL),
s AS (SELECT a.repo, a.depth, a.f, count(*) AS n FROM t a JOIN t b ON b.repo = a.repo AND b.depth > a.depth AND b.f[:a.depth] = a.f GROUP BY ALL)
SELECT t.repo, array_to_string(t.f, '/') AS folder, CAST(t.depth AS INT) AS depth, n_files, n_bytes, coalesce(n, 0) AS n_folders FROM t LEFT JOIN s ON s.repo = t.repo AND s.depth = t.depth AND s.f = t.f""",
    "resolved_references": f"""WITH a AS (SELECT page_id, {_HOST} AS repo, trim(CASE WHEN page_id % 9 = 4 THEN NULL ELSE {_SPEC} END, '/') AS spec FROM pages), r AS (SELECT DISTINCT {_HOST} AS repo, {_REF} AS ref FROM pages WHERE page_id % 2 = 0),
m AS (SELECT a.page_id, a.spec, arg_max(ref, length(ref)) AS ref FROM a LEFT JOIN r ON r.repo = a.repo AND r.ref <> '' AND (a.spec = r.ref OR starts_with(a.spec, r.ref || '/')) GROUP BY ALL),
g AS (SELECT page_id, spec, coalesce(ref, CASE WHEN contains(spec, '/') THEN regexp_extract(spec, '^[^/]*') END) AS ref FROM m)
SELECT page_id, ref, CASE WHEN ref IS NOT NULL THEN nullif(spec[length(ref) + 2:], '') END AS path FROM g""",
}
