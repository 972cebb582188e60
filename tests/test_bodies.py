"""Kinds of bodies, diffs, notebooks and tables on small cases, and diffs of random edits against difflib."""

import difflib
import json
import random

from pyspark.sql import functions as F

from sievework.operators import bodies


def test_kinds_of_bodies_with_nulls(spark):
    rows = [(None, None, None), ("", "no url", ""), (None, "https://h.example/a.b/c", "x"), ("text/plain", "https://h.example/x.MD", None), (None, None, "#!/bin/sh\n"), (None, None, "struct A;\r\n\tenum B {}\n")]
    df = spark.createDataFrame(rows, "c string, u string, b string").select(bodies.kind(F.col("c"), F.col("u"), F.col("b")).alias("k")).select("k.*")
    assert [tuple(r) for r in df.collect()] == [("plain_text", None, False)] * 3 + [("markdown", "markdown", True), ("code", "bash", True), ("code", "code", True)]


def test_diffs_of_random_edits(spark):
    rng, docs, want = random.Random(7), [], {}
    for k in range(40):
        old = [rng.choice(["-- a/x", "++ b", "@@ -1 +1 @@", "", "t", "u  v", "-"]) for _ in range(rng.randrange(60))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randrange(6)):
            new.insert(rng.randrange(len(new) + 1), rng.choice(["++ b/y", "new", " "]))
        parts = []
        for path, (a, b) in {f"f{k}.rs": (old, new), f"gone{k}.rs": (old[:5], [])}.items():
            parts += list(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}" if b or path[0] == "f" else "/dev/null", lineterm="", n=rng.randrange(4)))
        docs.append((k, "\n".join(parts)))
        want[k] = (old, new)
    got = {}
    for r in bodies.diff_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "pos").collect():
        got.setdefault((r.doc_id, r.path), []).append(r)
    for k, (old, new) in want.items():
        lines = got.get((k, f"f{k}.rs"), [])
        for r in lines:
            assert r.old_line is None or old[r.old_line - 1] == r.text
            assert r.new_line is None or new[r.new_line - 1] == r.text
        gone = {r.old_line for r in lines if r.change == "removed"}
        come = {r.new_line for r in lines if r.change == "added"}
        assert [x for i, x in enumerate(old, 1) if i not in gone] == [x for i, x in enumerate(new, 1) if i not in come]
        assert [r.text for r in got.get((k, f"gone{k}.rs"), [])] == old[:5]


def test_diffs_that_are_broken(spark):
    cut = "--- a/x\n+++ b/x\n@@ -5,3 +5,2 @@\n a\n-b\n\\ No newline at end of file"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "@@ -1 @@\n+a"), (4, cut), (5, "@@ -3 +4 @@\n-a\n+b\n+c")], "doc_id long, text string")
    got = [tuple(r)[:-1] for r in bodies.diff_lines(df).drop("pos").orderBy("doc_id", "old_line").collect()]
    assert got == [(4, "x", 1, "kept", 5, 5), (4, "x", 1, "removed", 6, None), (5, None, 1, "added", None, 4), (5, None, 1, "removed", 3, None)]
    assert bodies.diff_lines(df.limit(0)).count() == 0


def test_notebooks(spark):
    cells = [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "one text"}, {"source": ["x"]}, {"cell_type": "code", "source": [" \n"]}, {"cell_type": "markdown", "source": ["# t"]}]
    docs = [(1, json.dumps({"cells": cells})), (2, "junk"), (3, None), (4, '{"cells": "no"}'), (5, '{"cells": []}'), (6, json.dumps({"cells": cells[:1] * 9}))]
    got = sorted((r.doc_id, r.cell or 0, r.kind, r.language, r.text) for r in bodies.notebook_cells(spark.createDataFrame(docs, "doc_id long, text string"), most=5).collect())
    assert got[:3] == [(1, 1, "code", "python", "[cell 1 (code)]\na\nb"), (1, 3, "raw_text", None, "[cell 3 (unknown)]\nx"), (1, 5, "paragraph", None, "[cell 5 (markdown)]\n# t")]
    assert got[3:5] == [(2, 0, "raw_text", None, "junk"), (4, 0, "raw_text", None, '{"cells": "no"}')] and len(got) == 10


def test_tables_and_paragraphs(spark):
    docs = spark.createDataFrame([(1, 'a,"b,\tc",d\n1\r\n2'), (2, None), (3, ""), (4, "x\n" * 101), (5, "\n \n p\n\tq\n\nr")], "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.n_columns, r.n_rows, r.text) for r in bodies.table_previews(docs).filter("line < 3").collect()}
    assert got[1, 1] == (1, 3, '  1 | a,"b,\tc",d') and got[1, 2] == (1, 3, "   2 | 1") and got[4, 1] == (1, None, "  1 | x")
    assert {d for d, _ in got} == {1, 4, 5}
    assert [tuple(r)[1:] for r in bodies.paragraphs(docs).filter("doc_id = 5").orderBy("first").collect()] == [(3, 4, " p\n\tq"), (6, 6, "r")]
