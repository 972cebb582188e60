"""Queries over fetched bodies: kinds, lines of diffs, cells of notebooks, previews and paragraphs, with their
DuckDB SQL. The lines of documents become diffs, notebooks and tables; the SQL numbers them from how they were
laid out, without reading the diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import bodies
from sievework.session import table

# content type, ending, start of the body, and what becomes of them: kind, language, by_lines.
_KINDS = [
    ("text/markdown; charset=utf-8", "/a.rs", "", "markdown", None, True),
    ("application/vnd.api+JSON", "", "", "json", "json", True),
    ("text/x-csrc", "/x", "", "code", "c", True),
    (None, "/lib/Main.KT?v=1.py", "", "code", "kotlin", True),
    ("text/plain", "/fix.patch#l1.md", "", "diff", "diff", True),
    ("text/html", "/n.ipynb", "", "notebook", None, False),
    ("application/octet-stream", "/x.json", "%PDF-1.7 ", "pdf", None, False),
    ("text/plain", "/notes.txt", "#!/usr/bin/env python3\n", "code", "python", True),
    (None, "", "#!/usr/bin/env -S deno\n", "code", "deno", True),
    ("text/plain", "/q", "use a;\n  fn main() {\n", "code", "rust", True),
    ("text/plain", "/q", "class A extends B {\nimport c\n", "code", "typescript", True),
    ("text/plain", "/q", "import one\n", None, None, None),
    ("application/atom+xml", "/f", "", "xml", None, False),
    ("text/tab-separated-values", "", "", "csv", None, False),
]
_N = len(_KINDS)


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _case(k: int) -> str:
    return f"CASE doc_id % {_N} " + " ".join(f"WHEN {i} THEN {_quoted(r[k])}" for i, r in enumerate(_KINDS)) + " END"


def body_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_case(0)} AS content_type", f"concat('https://h.example', {_case(1)}) AS url", "text", f"CAST(doc_id % {_N} AS int) AS k")
    opening = F.lit("")
    for i, row in enumerate(_KINDS):
        opening = F.when(F.col("k") == i, F.lit(row[2])).otherwise(opening)
    found = docs.withColumn("found", bodies.kind(F.col("content_type"), F.col("url"), F.concat(opening, F.coalesce("text", F.lit("")))))
    return found.select("doc_id", "found.*")


#: SQL of both engines: line i (from 0) of a text as a line of a hunk; each run of 12 lines is one hunk of the file of its tens.
_MARK = "CASE WHEN (i + doc_id) % 5 = 1 THEN '+' WHEN (i * i + doc_id) % 7 = 2 THEN '-' ELSE ' ' END"
_RUN = 12


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))


def diffed(spark, sf_dir):
    """Texts of documents as diffs. Hunks, each with its file's header, follow one another; those of every
    third document carry a line between hunks that looks like content."""
    row = _lines(spark, sf_dir).withColumn("mark", F.expr(_MARK)).withColumn("run", F.expr(f"i div {_RUN}"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("mark", "x").alias("t")))), lambda s: s["t"]), "\n")
    hunk = row.groupBy("doc_id", "run").agg(F.count_if(F.col("mark") != "+").alias("olds"), F.count_if(F.col("mark") != "-").alias("news"), body.alias("body"))
    path = F.expr("concat('src/f', run div 3, '.rs')")
    gone = F.expr("doc_id % 4 = 1")
    files = F.concat(F.lit("diff --git a/x b/x\n--- a/"), path, F.when(gone, "\n+++ /dev/null\n").otherwise(F.concat(F.lit("\n+++ b/"), path, F.lit("\t2024-01-01\n"))))
    head = F.format_string("@@ -%d,%d +%d,%d @@ fn\n", F.expr("run * 100 + 1"), F.col("olds"), F.expr("run * 100 + 7"), F.col("news"))
    text = F.concat(files, head, F.col("body"), F.when(F.expr("doc_id % 3 = 0"), "\n\\ No newline at end of file\n+ not of it").otherwise(""))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", text.alias("t")))), lambda s: s["t"]), "\n")
    return hunk.groupBy("doc_id").agg(whole.alias("text"))


def diff_places(spark, sf_dir):
    return bodies.diff_lines(diffed(spark, sf_dir)).drop("pos")


def notebook_cells(spark, sf_dir):
    cell = F.struct(F.expr("CASE (i + doc_id) % 4 WHEN 0 THEN 'markdown' WHEN 3 THEN 'raw' ELSE 'code' END").alias("cell_type"), F.split("x", "(?<= )").alias("source"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("i", cell.alias("c")))), lambda s: s["c"])
    made = _lines(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.struct(held.alias("cells"))).alias("text"))
    broken = F.when(F.expr("doc_id % 6 = 5"), F.expr("concat('[', text)")).when(F.expr("doc_id % 6 = 4"), F.expr("'{\"cells\": 3}'")).otherwise(F.col("text"))
    return bodies.notebook_cells(made.select("doc_id", broken.alias("text"))).withColumn("text", F.when(F.col("cell").isNotNull(), F.col("text")))


def table_previews(spark, sf_dir):
    return bodies.table_previews(table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('\"a,b\",c', CASE WHEN doc_id % 2 = 0 THEN '\t' ELSE ',' END, 'd\n', replace(text, '\r', ' '))").alias("text")))


def plain_paragraphs(spark, sf_dir):
    return bodies.paragraphs(table(spark, sf_dir, "documents").select("doc_id", F.expr("concat(replace(replace(text, '\r', ' '), '. ', '.\n\n  '), '\n \n')").alias("text")))


QUERIES = {"body_kinds": body_kinds, "diff_places": diff_places, "notebook_cells": notebook_cells, "table_previews": table_previews, "plain_paragraphs": plain_paragraphs}

_SQL_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)"
_ANSWERS = ", ".join(f"({i}, {_quoted(r[3])}, {_quoted(r[4])}, {'NULL' if r[5] is None else r[5]})" for i, r in enumerate(_KINDS))
_SIGN = "regexp_matches(trim(x), '^(use |import |from .*import|require\\(|include!)')::INT + regexp_matches(trim(x), '^(fn |func |def |function |pub fn |async fn |struct |class |pub struct |enum |trait |interface )')::INT"
ORACLES = {
    # Only the case without a fixed answer depends on the text: one line that looks like code stands before it.
    "body_kinds": rf"""WITH a(k, kind, language, by_lines) AS (VALUES {_ANSWERS}),
s AS (SELECT doc_id, left(concat('import one' || chr(10), coalesce(text, '')), 8192) AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))[:200]) AS x FROM s),
c AS (SELECT doc_id, any_value(t) AS t, sum({_SIGN}) >= 2 AS code FROM l GROUP BY 1),
g AS (SELECT doc_id, code, CASE WHEN NOT code THEN NULL WHEN contains(t, 'fn main()') OR contains(t, 'fn ') AND contains(t, '-> ') AND contains(t, 'Option<') THEN 'rust' WHEN contains(t, 'def ') AND contains(t, ':') AND (contains(t, 'self') OR contains(t, '__init__')) THEN 'python'
  WHEN contains(t, 'func ') AND contains(t, ':=') THEN 'go' WHEN contains(t, 'class ') AND contains(t, 'extends') THEN 'typescript' WHEN contains(t, 'public class ') OR contains(t, 'private ') THEN 'java' ELSE 'code' END AS lang FROM c)
SELECT doc_id, coalesce(kind, CASE WHEN code THEN 'code' ELSE 'plain_text' END) AS kind, CASE WHEN kind IS NULL THEN g.lang ELSE language END AS language, coalesce(by_lines, code) AS by_lines FROM documents JOIN a ON doc_id % {_N} = k JOIN g USING (doc_id)""",
    "diff_places": f"""WITH {_SQL_LINES}, m AS (SELECT *, {_MARK} AS mark, i // {_RUN} AS run FROM l),
n AS (SELECT *, count(*) FILTER (WHERE mark <> '+') OVER w AS olds, count(*) FILTER (WHERE mark <> '-') OVER w AS news FROM m WINDOW w AS (PARTITION BY doc_id, run ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, concat('src/f', run // 3, '.rs') AS path, CAST(run + 1 AS INT) AS hunk, CASE mark WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'kept' END AS change,
CAST(CASE WHEN mark <> '+' THEN run * 100 + olds END AS INT) AS old_line, CAST(CASE WHEN mark <> '-' THEN run * 100 + 6 + news END AS INT) AS new_line, x AS text FROM n""",
    "notebook_cells": f"""WITH {_SQL_LINES}, t AS (SELECT doc_id, i + 1 AS cell, x, CASE (i + doc_id) % 4 WHEN 0 THEN 'markdown' WHEN 3 THEN 'raw' ELSE 'code' END AS ty FROM l WHERE doc_id % 6 < 4)
SELECT doc_id, CAST(cell AS INT) AS cell, CASE ty WHEN 'markdown' THEN 'paragraph' WHEN 'raw' THEN 'raw_text' ELSE 'code' END AS kind, CASE WHEN ty = 'code' THEN 'python' END AS language, concat('[cell ', cell, ' (', ty, ')]', chr(10), x) AS text FROM t WHERE cell <= {bodies.CELLS} AND NOT regexp_full_match(x, '\\s*')
UNION ALL SELECT doc_id, NULL, 'raw_text', NULL, NULL FROM documents WHERE text IS NOT NULL AND doc_id % 6 >= 4""",
    "table_previews": f"""WITH d AS (SELECT doc_id, string_split(regexp_replace(concat('"a,b",c', CASE WHEN doc_id % 2 = 0 THEN chr(9) ELSE ',' END, 'd', chr(10), replace(text, chr(13), ' ')), '\\n$', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(1, least(len(ls), {bodies.TABLE_ROWS}) + 1)) AS line, ls FROM d)
SELECT doc_id, CAST(line AS INT) AS line, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS INT) AS n_columns, CAST(CASE WHEN len(ls) <= {bodies.TABLE_ROWS} THEN len(ls) END AS INT) AS n_rows, concat(' ', lpad(line::VARCHAR, CASE WHEN line = 1 THEN 2 ELSE 3 END, ' '), ' | ', ls[line]) AS text FROM e""",
    "plain_paragraphs": f"""WITH d AS (SELECT doc_id, string_split(concat(replace(replace(text, chr(13), ' '), '. ', '.' || chr(10) || chr(10) || '  '), chr(10), ' ', chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS n FROM d),
g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l WHERE NOT regexp_full_match(x, '\\s*'))
SELECT doc_id, CAST(min(n) AS INT) AS "first", CAST(max(n) AS INT) AS "last", string_agg(x, chr(10) ORDER BY n) AS text FROM g GROUP BY doc_id, run""",
}
