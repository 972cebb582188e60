"""Queries over spans and blocks of code, with their DuckDB SQL.

The texts of documents become code line by line: each line of a text goes into a comment, a
string or an expression of a function."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import spans
from sievework.session import table

#: SQL of both engines: line i (from 0) of a document's code, from line x of its text.
_RUST = """CASE i % 6 WHEN 0 THEN concat('fn f', i, '_', doc_id % 7, '() {') WHEN 1 THEN concat('    // } ', x) WHEN 2 THEN concat('    if a { b("', substr(x, 1, 20), CASE WHEN i % 4 = 0 THEN ' {' ELSE '' END, '");')
  WHEN 3 THEN '    }' WHEN 4 THEN '}' ELSE '#[inline]' END"""
_PYTHON = """CASE i % 6 WHEN 0 THEN concat('def f', i, '_', doc_id % 7, '():') WHEN 1 THEN concat('    x = "', substr(x, 1, 20), '"') WHEN 2 THEN '    if x:' WHEN 3 THEN concat('        # ', x) WHEN 4 THEN '  ' ELSE '@kept' END"""
_LINE = f"CASE WHEN doc_id % 2 = 0 THEN {_RUST} ELSE {_PYTHON} END"
#: request, symbol, text, first, last, expand, most.
_ASKED = [
    ("'s'", "concat('f', 6 * (doc_id % 3), '_', doc_id % 7)", "NULL", "NULL", "NULL", "true", "CASE WHEN doc_id % 5 = 0 THEN 3 END"),
    ("'r'", "NULL", "NULL", "2 + doc_id % 5", "6 + doc_id % 9", "doc_id % 3 > 0", "NULL"),
    ("'t'", "'nowhere'", "'the '", "NULL", "NULL", "true", "CAST(doc_id % 8 AS int)"),
    ("'w'", "NULL", "NULL", "NULL", "NULL", "false", "30"),
]


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    code = f"array_join(transform(split(text, '\n'), (x, i) -> {_LINE}), '\n')"
    return docs.selectExpr("doc_id AS file", "CASE WHEN doc_id % 2 = 0 THEN 'Rust' ELSE 'py' END AS language", f"{code} AS content")


def code_spans(spark, sf_dir):
    files = _files(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    names = "request symbol text first last expand most".split()
    rows = ", ".join("struct(" + ", ".join(f"{v} AS {n}" for n, v in zip(names, (f"concat({a[0]}, doc_id)", *[f"CAST({v} AS {k})" for v, k in zip(a[1:], "string string int int boolean int".split(), strict=True)]), strict=True)) + ")" for a in _ASKED)
    asked = docs.selectExpr("doc_id AS file", f"explode(array({rows})) AS a").select("file", "a.*")
    return spans.spans(files, asked)


def code_blocks(spark, sf_dir):
    return spans.block_tree(_files(spark, sf_dir)).withColumnRenamed("file", "doc_id")


_LINES = f"""d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS MATERIALIZED (SELECT doc_id, i, len(ls) AS total, {_LINE} AS t FROM (SELECT doc_id, ls, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d))"""
_MARKS = """tok AS (SELECT doc_id, i, unnest(ts) AS tok, unnest(range(len(ts))) AS p FROM (SELECT doc_id, i, regexp_extract_all(t || chr(10), '[{}\\n]') AS ts FROM LINES)),
marks AS MATERIALIZED (SELECT doc_id, tok, i, i + (tok = chr(10))::INT AS next, row_number() OVER w AS idx, sum(CASE tok WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w AS depth FROM tok
  WINDOW w AS (PARTITION BY doc_id ORDER BY i, p ROWS UNBOUNDED PRECEDING) UNION ALL SELECT doc_id, chr(10), 0, 0, 0, 0 FROM d)"""
_REQUESTS = " UNION ALL ".join(f"SELECT doc_id, {a[0]} || doc_id AS request, {a[1]}::VARCHAR AS symbol, {a[2]}::VARCHAR AS needle, {a[3]} AS lo, {a[4]} AS hi, {a[5]} AS expand, {a[6]} AS most FROM d" for a in _ASKED)
QUERIES = {"code_spans": code_spans, "code_blocks": code_blocks}
ORACLES = {
    "code_spans": rf"""WITH {_LINES}, {_MARKS.replace('LINES', "l WHERE doc_id % 2 = 0")},
m AS MATERIALIZED (SELECT doc_id, i, total, t, trim(t) <> '' AS solid, length(regexp_extract(t, '^ *')) AS ind, regexp_matches(trim(t), '^[@#]') AS deco, regexp_matches(trim(t), '^(def|async|class) ') AS opens,
  regexp_extract(CASE WHEN NOT regexp_matches(ltrim(t), '^//($|[^/!])') THEN t ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 'fn\s+(\w+)' ELSE 'def\s+(\w+)' END, 1) AS named FROM l),
q AS (SELECT r.*, len(ls) AS total FROM ({_REQUESTS}) r JOIN d USING (doc_id)),
plain AS (SELECT request, 'explicit_range' AS selection, least(lo, total) - 1 AS s, least(greatest(hi, least(lo, total)), total) - 1 AS e, 'exact' AS confidence, NULL AS kind, NULL::INT AS most FROM q WHERE lo IS NOT NULL AND NOT expand),
hit AS (SELECT q.request, min(i) AS line FROM q JOIN m ON m.doc_id = q.doc_id AND named = symbol GROUP BY 1),
seen AS (SELECT q.request, any_value(q.total) AS total, any_value(q.most) AS most, min(i) AS line FROM q JOIN m ON m.doc_id = q.doc_id WHERE needle IS NOT NULL AND contains(lower(t), needle) AND request NOT IN (SELECT request FROM hit) GROUP BY 1),
texts AS (SELECT request, 'match_text', greatest(line - least(coalesce(most, 10), 20) // 2, 0), least(line + least(coalesce(most, 10), 20) // 2, total - 1), 'strong', NULL, most FROM seen),
whole AS (SELECT request, 'whole_file', 0, total - 1, 'unknown', NULL, most FROM q WHERE lo IS NULL AND symbol IS NULL AND needle IS NULL),
asked AS (SELECT doc_id, request, greatest(least((lo + hi) // 2 - 1, total - 1), 0) AS spot, 'expanded_range' AS selection, 'strong' AS confidence, NULL AS kind, most, total FROM q WHERE lo IS NOT NULL AND expand
  UNION ALL SELECT doc_id, request, line, 'symbol_definition', 'exact', 'function', most, total FROM q JOIN hit USING (request)),
b1 AS (SELECT a.doc_id, a.request, any_value(total) AS total, coalesce(max_by(k.next, k.idx), any_value(a.spot)) AS s FROM asked a JOIN marks e ON e.doc_id = a.doc_id AND e.tok = chr(10) AND e.next = a.spot + 1
  LEFT JOIN marks k ON k.doc_id = a.doc_id AND k.depth = e.depth - 1 AND k.idx <= e.idx WHERE a.doc_id % 2 = 0 GROUP BY ALL),
b2 AS (SELECT b1.doc_id, b1.request, s, CASE min_by(k.tok, k.idx) WHEN '}}' THEN min_by(k.i, k.idx) WHEN chr(10) THEN any_value(s) ELSE any_value(total) - 1 END AS e FROM b1 JOIN marks b ON b.doc_id = b1.doc_id AND b.tok = chr(10) AND b.next = s
  LEFT JOIN marks k ON k.doc_id = b1.doc_id AND k.depth = b.depth AND k.idx > b.idx AND k.tok <> '{{' GROUP BY ALL),
p0 AS (SELECT a.doc_id, a.request, a.spot, a.total, m.ind AS base FROM asked a JOIN m ON m.doc_id = a.doc_id AND m.i = a.spot WHERE a.doc_id % 2 = 1),
p1 AS (SELECT p0.*, max_by(m.i, m.i) FILTER (WHERE m.i < spot AND solid AND ind <= base AND NOT deco) AS stop, max_by(m.ind = base AND m.opens, m.i) FILTER (WHERE m.i < spot AND solid AND ind <= base AND NOT deco) AS own,
  min(m.i) FILTER (WHERE m.i < spot AND deco) AS first_deco, min(m.i) FILTER (WHERE m.i > spot AND solid AND ind <= base) AS nxt FROM p0 JOIN m USING (doc_id) GROUP BY p0.doc_id, request, spot, p0.total, base),
p2 AS (SELECT p1.doc_id, request, CASE WHEN stop IS NULL THEN coalesce(first_deco, spot) WHEN own THEN stop ELSE stop + 1 END AS s, greatest(any_value(spot), coalesce(max(m.i) FILTER (WHERE solid AND (nxt IS NULL OR m.i < nxt)), any_value(spot))) AS e FROM p1 JOIN m USING (doc_id) GROUP BY ALL),
both_ AS (SELECT * FROM b2 UNION ALL SELECT * FROM p2),
up AS (SELECT b.doc_id, request, s, e, coalesce(max(m.i) FILTER (WHERE m.i < s AND NOT CASE WHEN b.doc_id % 2 = 0 THEN regexp_matches(trim(t), '^(#!?\[|///|//!)') ELSE deco END) + 1, 0) AS top FROM both_ b LEFT JOIN m USING (doc_id) GROUP BY ALL),
blocks AS (SELECT request, selection, least(top, s) AS s, e, confidence, kind, most FROM up JOIN asked USING (request)),
every AS (SELECT * FROM texts UNION ALL SELECT * FROM whole UNION ALL SELECT * FROM blocks)
SELECT request, selection, CAST(s + 1 AS INT) AS "first", CAST(CASE WHEN e - s + 1 > most THEN s + greatest(most, 1) ELSE e + 1 END AS INT) AS "last", kind AS symbol_kind, confidence, coalesce(e - s + 1 > most, false) AS cut
FROM (SELECT * FROM plain UNION ALL SELECT * FROM every)""",
    "code_blocks": rf"""WITH {_LINES},
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(t, CASE WHEN doc_id % 2 = 0 THEN '"[^"]*"|//.*' ELSE '"[^"]*"|#.*' END, '', 'g'), '^$', '') AS t FROM l), {_MARKS.replace('LINES', 'c')},
o AS (SELECT doc_id, idx, i, depth FROM marks WHERE tok = '{{'),
s AS (SELECT o.doc_id, o.idx, min_by(m.i, m.idx) AS shut FROM o LEFT JOIN marks m ON m.doc_id = o.doc_id AND m.idx > o.idx AND m.tok = '}}' AND m.depth = o.depth - 1 GROUP BY ALL),
u AS (SELECT o.doc_id, o.idx, max(p.idx) AS parent FROM o LEFT JOIN o p ON p.doc_id = o.doc_id AND p.idx < o.idx AND p.depth = o.depth - 1 GROUP BY ALL)
SELECT doc_id, CAST(idx AS INT) AS block, CAST(parent AS INT) AS parent, CAST(depth AS INT) AS depth, CAST(i + 1 AS INT) AS "first", CAST(coalesce(shut, total - 1) + 1 AS INT) AS "last"
FROM o JOIN s USING (doc_id, idx) JOIN u USING (doc_id, idx) JOIN (SELECT doc_id, len(ls) AS total FROM d) USING (doc_id)""",
}
