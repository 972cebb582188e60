"""Queries over error texts, hints, packages, Markdown, code, pages and scores, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import queries as q
from sievework.operators import blocks, ranking
from sievework.plans.classify import _case, _q
from sievework.session import table

_ERRORS = [
    "error[E0308]: mismatched types in src/main.rs and tokio::spawn::x\nnote: crate `serde` e0308",
    'Traceback\n  File "/app/a.py", line 10, in run\nValueError TS2345',
    "token = abcdefghijklmnop1234 at 0xdeadbeef01\n404 Not Found\n503 Service Unavailable",
    "id 123e4567-e89b-12d3-a456-426614174000 failed, package `left pad`\nlib/x.ts",
]
_HINTED = [
    ("repo:tokio-rs/axum extract lang:Rust", "tokio-rs|axum||||rust|||extract"),
    ("serde-rs/json path:src/lib.rs parse  error", "serde-rs|json||src/lib.rs|||||parse error"),
    ('org:rust-lang file:mod.rs symbol:"Vec::push" host:GitHub', "||rust-lang||mod.rs||Vec::push|github|"),
    ("a/b c/d", "a|b|||||||c/d"),
    ("repo:nope words", "||||||||repo:nope words"),
    ("", "||||||||"),
]
_DOMAINS = {"Example.COM ": "example.com", "https://a.b": None, "a..b": None, "-a.b": None, "a.b:80": None, "*.a": None, "x-y.z": "x-y.z", "": None, "a b": None, "é.fr": None}
_ALIASES = [a for e in q.ECOSYSTEMS.values() for a in e[0]]
_CARDS = ["user_id AS query_id", "event_id AS pos", "cast(event_id * 37 % 101 AS double) AS score"]
_TITLES = ["Error E0308 explained", "mismatched TYPES in match", "Release 1.2", "e0308 mismatched types"]
_CARD_KINDS = ["docs", "issue", "release", "reference", "news"]
_MODES, _KINDS, _ROLES = [*ranking.KINDS, "other"], ["docs", "issue", "release", "source_file", "advisory", "registry"], ["implementation", "changelog", "benchmark", "test", "vendor"]
_FROM, _SURE = list(ranking.PROVENANCE), [*ranking.CONFIDENCE]
_QK = ["docs", "registry", "advisory", "issue", "release", "news", "tutorial"]


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def error_pieces(spark, sf_dir):
    t = F.expr(f"concat({_case('doc_id', _ERRORS, _q(''))}, chr(10), coalesce(text, ''))")
    p = table(spark, sf_dir, "documents").select("doc_id", q.error_parts(t).alias("p"), F.length(q.redacted(t)).cast("long").alias("n_redacted"))
    lists = ["codes", "statuses", "packages", "files", "modules", "frames"]
    return p.select("doc_id", "n_redacted", *[F.array_join(F.array_sort(f"p.{x}"), ",").alias(x) for x in lists], F.col("p.primary").alias("primary_line"))


def repo_hints(spark, sf_dir):
    h = q.repo_hints(F.expr(_pick("p_partkey", [a for a, _ in _HINTED])))
    names = "owner repo org path file language symbol host residual".split()
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array(*[h[n] for n in names]), "|", "").alias("hints"))


def package_urls(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"upper({_pick('p_partkey', _ALIASES)}) AS alias", "concat('@s c/p+', p_partkey, '/..') AS name", f"{_pick('p_partkey', list(_DOMAINS))} AS d")
    e = q.ecosystem(F.col("alias"))
    return part.select("p_partkey", e.alias("ecosystem"), q.advisory_name(e).alias("advisory_name"), q.package_url(e, F.col("name")).alias("url"), q.domain(F.col("d")).alias("domain"))


_MARK = "CASE WHEN i % 9 = 0 THEN concat(repeat('#', 1 + cast(floor(i / 9) AS int) % 3), ' ', x) WHEN i % 9 = 4 THEN concat('- ', x) WHEN i % 9 = 5 THEN concat('> ', x) WHEN i % 18 IN (6, 8) THEN '```' ELSE x END"


def marked(spark, sf_dir):
    """Documents as Markdown: headings, lists, quotes and fences put in by line number."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"array_join(transform(split(text, '\\n'), (x, i) -> {_MARK}), '\\n') AS text")


def heading_paths(spark, sf_dir):
    return blocks.heading_paths(blocks.markdown_blocks(marked(spark, sf_dir))).withColumn("path", F.array_join("path", " > "))


_CODE = "CASE i % 5 WHEN 0 THEN concat('def f', i, '(x):') WHEN 2 THEN concat('    class C', i, ':') WHEN 3 THEN '        pass' ELSE x END"


def code_symbols(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("doc_id AS file", "CASE WHEN doc_id % 4 = 3 THEN 'cobol' ELSE 'python' END AS language", f"array_join(transform(split(text, '\\n'), (x, i) -> {_CODE}), '\\n') AS content")
    return blocks.symbols(files)


def candidate_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{_pick('event_id', _MODES)} AS mode", f"{_pick('(event_id * 7)', _KINDS)} AS kind", f"{_pick('(event_id * 3)', _ROLES)} AS role", f"{_pick('(event_id * 2)', _FROM)} AS provenance",
        f"{_pick('(event_id * 11)', _SURE)} AS confidence", "CASE event_id % 3 WHEN 0 THEN array('path', 'symbol') WHEN 1 THEN array('error', 'error', 'version') END AS context",
    )
    return e.select("event_id", ranking.candidate_score(*[F.col(c) for c in ("mode", "kind", "role", "provenance", "confidence", "context")]).cast("long").alias("score"))


def error_boosts(spark, sf_dir):
    cards = table(spark, sf_dir, "events").selectExpr(*_CARDS, f"{_pick('event_id', _TITLES)} AS title", "CASE WHEN event_id % 7 = 0 THEN 'see E0308' END AS snippet", f"{_pick('(event_id * 3)', _CARD_KINDS)} AS kind", "'mismatched types' AS phrase", "array('E0308', 'E0001') AS codes")
    return ranking.error_boosted(cards).select("query_id", "pos", "place", "score", "kind")


def card_quality(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_pick('p_partkey', _QK)} AS kind", "CASE p_partkey % 3 WHEN 0 THEN array('github_code', 'x') WHEN 1 THEN array('brave') END AS providers", *[f"p_size % {n} = 0 AS {c}" for n, c in ((7, "code"), (5, "record"), (3, "snippet"), (11, "exact"))])
    got = p.select("p_partkey", ranking.quality(*[F.col(c) for c in ("kind", "providers", "code", "record", "snippet", "exact")]).alias("q"))
    return got.select("p_partkey", "q.authority", "q.strength", F.array_join("q.doubts", ",").alias("doubts"))


QUERIES = {
    "error_pieces": error_pieces,
    "repo_hints": repo_hints,
    "package_urls": package_urls,
    "heading_paths": heading_paths,
    "packed_chunks": lambda spark, d: blocks.chunks(marked(spark, d), 600, 8),
    "code_symbols": code_symbols,
    "page_parts": lambda spark, d: table(spark, d, "pages").select("page_id", blocks.page_parts(F.col("html")).alias("p")).select("page_id", "p.*"),
    "candidate_scores": candidate_scores,
    "error_boosts": error_boosts,
    "card_quality": card_quality,
}

_ALL = lambda p, k=1: f"array_to_string(list_sort(list_distinct(regexp_extract_all(t, {_q(p)}, {k}))), ',')"
_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_MD = f"md AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, k: {_MARK.replace('i ', '(k - 1) ').replace('(i', '((k - 1)')})) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_SKIP = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _tag in [*blocks.SKIPPED, "head", "title"]:
    _SKIP = f"regexp_replace({_SKIP}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_FOLD = "trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _pts(d: dict, key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in d.items()) + " ELSE 0 END)"


_flat = lambda t: {f"{m}/{k}": v for m, d in t.items() for k, v in d.items()}
_LV = ", ".join(f"last_value(CASE WHEN level BETWEEN 1 AND {n} THEN {{'l': level, 't': text}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h{n}" for n in range(1, 4))
ORACLES = {
    "error_pieces": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, {_q(q.CODES)}, 1), lambda x: upper(x)))), ',') AS codes, {_ALL(q.HTTP_STATUS)} AS statuses, {_ALL(q.CARGO_PACKAGE)} AS packages,
  {_ALL(q.SOURCE_FILE)} AS files, {_ALL(q.MODULE_PATH)} AS modules, {_ALL(q.PYTHON_FRAME, 0)} AS frames, coalesce(list_filter({_LINES}, lambda x: regexp_matches(x, {_q(q.PRIMARY)}))[1], {_LINES}[1]) AS primary_line,
  length(regexp_replace(regexp_replace(regexp_replace(t, {_q(q.SECRET)}, '<secret>', 'g'), {_q(q.UUID)}, '<uuid>', 'g'), {_q(q.ADDRESS)}, '<address>', 'g')) AS n_redacted
FROM (SELECT doc_id, concat({_case('doc_id', _ERRORS, _q(''))}, chr(10), coalesce(text, '')) AS t FROM documents)""",
    "repo_hints": f"SELECT p_partkey, {_pick('p_partkey', [b for _, b in _HINTED])} AS hints FROM part",
    "package_urls": f"""SELECT p_partkey, e AS ecosystem, CASE e {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in q.ECOSYSTEMS.items())} END AS advisory_name,
  CASE e {" ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in q.ECOSYSTEMS.items())} END || '%40s%20c/p%2B' || p_partkey || '/%2E%2E' AS url, nullif({_pick("p_partkey", [v or '' for v in _DOMAINS.values()])}, '') AS domain
FROM (SELECT p_partkey, {_pick("p_partkey", [e for e, v in q.ECOSYSTEMS.items() for _ in v[0]])} AS e FROM part)""",
    "heading_paths": f"""WITH {_MD}, f AS (SELECT *, trim(line) LIKE '```%' AS fence, sum((trim(line) LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM md),
b AS (SELECT doc_id, pos, line, CASE WHEN inside THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\s*([-*+]|[0-9]+[.)])\\s') THEN 'list_item' WHEN regexp_matches(line, '^\\s*>') THEN 'quote'
  WHEN regexp_matches(line, '^\\s*[|].*[|]\\s*$') THEN 'table_row' ELSE 'text' END AS kind FROM f WHERE NOT fence AND trim(line) <> ''),
t AS (SELECT doc_id, pos, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level, CASE kind WHEN 'heading' THEN trim(regexp_replace(line, '^#+\\s+', '')) WHEN 'list_item' THEN regexp_replace(line, '^\\s*([-*+]|[0-9]+[.)])\\s+', '')
  WHEN 'quote' THEN regexp_replace(line, '^\\s*>\\s?', '') ELSE line END AS text FROM b),
h AS (SELECT *, {_LV} FROM t)
SELECT doc_id, pos, kind, level, text, array_to_string(list_filter([CASE WHEN h1.l = 1 THEN h1.t END, CASE WHEN h2.l = 2 THEN h2.t END, CASE WHEN h3.l = 3 THEN h3.t END], lambda x: x IS NOT NULL), ' > ') AS path FROM h""",
    "packed_chunks": f"""WITH RECURSIVE {_MD}, o AS (SELECT *, length(line) AS len, regexp_matches(line, '^#{{1,6}}\\s') AS head, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM md WHERE trim(line) <> ''),
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, -1 AS chunk, 0::BIGINT AS used, 0 AS held, '' AS line FROM o
  UNION ALL SELECT doc_id, n, CASE WHEN new THEN chunk + 1 ELSE chunk END, CASE WHEN new THEN len ELSE used + len END, CASE WHEN new THEN 1 ELSE held + 1 END, line
  FROM (SELECT s.doc_id, o.n, chunk, used, held, o.line, len, held = 0 OR head OR used + len > 600 OR held >= 8 AS new FROM s JOIN o ON o.doc_id = s.doc_id AND o.n = s.n + 1))
SELECT doc_id, chunk, count(*) AS n_blocks, string_agg(line, chr(10) ORDER BY n) AS text FROM s WHERE n > 0 GROUP BY doc_id, chunk""",
    "code_symbols": """WITH l AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 4 <> 3),
p AS (SELECT file, n, unnest(range(n)) AS i FROM l)
SELECT file, CASE i % 5 WHEN 0 THEN 'def' ELSE 'class' END AS symbol_kind, CASE i % 5 WHEN 0 THEN 'f' ELSE 'C' END || i AS name, i + 1 AS first, least(CASE i % 5 WHEN 0 THEN i + 5 ELSE i + 3 END, n) AS last FROM p WHERE i % 5 IN (0, 2)""",
    "page_parts": f"""SELECT page_id, {_FOLD.format(c="regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(coalesce(html, ''), '(?is)<meta\\s+name=["\\x27]description["\\x27]\\s+content=["\\x27](.*?)["\\x27]', 1) AS description,
  least(len(list_distinct(regexp_extract_all(b, '(?i)<a\\s[^>]*href=["\\x27]([^"\\x27]+)["\\x27]', 1))), 100) AS n_links, {_FOLD.format(c="regexp_replace(b, '<[^>]*>', ' ', 'g')")} AS text FROM (SELECT page_id, html, {_SKIP} AS b FROM pages)""",
    "candidate_scores": f"""SELECT event_id, {_pts(_flat(ranking.KINDS), "m || '/' || kind")} + {_pts(_flat(ranking.ROLES), "m || '/' || role")} + {_pts(ranking.PROVENANCE, "pv")} + {_pts(ranking.CONFIDENCE, "cf")}
  + CASE event_id % 3 WHEN 0 THEN 8 + CASE WHEN kind = 'source_file' THEN 10 ELSE 0 END WHEN 1 THEN 15 ELSE 0 END + CASE WHEN kind = 'source_file' AND cf = 'unknown' THEN -5 ELSE 0 END AS score
FROM (SELECT event_id, {_pick("event_id", [*ranking.KINDS, "normal"])} AS m, {_pick("(event_id * 7)", _KINDS)} AS kind, {_pick("(event_id * 3)", _ROLES)} AS role, {_pick("(event_id * 2)", _FROM)} AS pv, {_pick("(event_id * 11)", _SURE)} AS cf FROM events)""",
    "error_boosts": f"""WITH c AS (SELECT {", ".join(_CARDS)}, {_pick("(event_id * 3)", _CARD_KINDS)} AS kind, event_id % 4 IN (1, 3) AS ph, event_id % 4 IN (0, 3) OR event_id % 7 = 0 AS code FROM events),
b AS (SELECT query_id, pos, kind, round(score + 0.1::DOUBLE * max(score) OVER (PARTITION BY query_id) * (CASE WHEN ph THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN code THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN code AND kind IN ('docs', 'reference') THEN 1 ELSE 0 END
  + CASE WHEN kind = 'docs' THEN 1 ELSE 0 END + CASE WHEN kind IN ('issue', 'release') THEN 0.5::DOUBLE ELSE 0 END), 12) AS score FROM c)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM b""",
    "card_quality": f"""SELECT p_partkey, authority, CASE WHEN p_size % 7 = 0 THEN 'exact_code_span' WHEN p_size % 11 = 0 THEN 'exact_identifier' WHEN p_size % 5 = 0 THEN 'structured_metadata' WHEN p_size % 3 = 0 THEN 'snippet_only' ELSE 'url_only' END AS strength,
  concat_ws(',', CASE WHEN authority = 'unknown' THEN 'low_authority' END, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 3 <> 0 THEN 'no_snippet' END) AS doubts
FROM (SELECT *, CASE k WHEN 'docs' THEN 'official' WHEN 'registry' THEN 'package_registry' WHEN 'advisory' THEN 'primary' WHEN 'issue' THEN CASE WHEN p_partkey % 3 = 0 THEN 'maintainer' ELSE 'community' END
  WHEN 'release' THEN CASE WHEN p_partkey % 3 = 0 THEN 'maintainer' ELSE 'unknown' END WHEN 'news' THEN 'news_or_blog' ELSE 'community' END AS authority FROM (SELECT *, {_pick("p_partkey", _QK)} AS k FROM part))""",
}
