"""Queries over coverage models, code evidence, cut texts and candidate files, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import local, shaping
from sievework.operators import filing
from sievework.plans import cases
from sievework.plans.real import REAL
from sievework.session import table

#: tool, workflow, exact error, profile, domain, model, decided by.
_MODELS = [
    ("web_search", None, None, None, None, None, None), ("web_search", "security_review", None, None, None, "security_review", "explicit_workflow"), ("repo_search", None, True, "security", None, "error_investigation", "mode"), ("repo_search", None, False, "security", None, "security_review", "profile"),
    ("repo_search", None, None, "research", None, "comparative_research", "profile"), ("repo_search", None, None, "coding", None, "repo_architecture", "profile"), ("repo_search", None, None, "other", "security", "repo_architecture", "default"), ("repo_search", None, None, None, None, "repo_architecture", "default"),
    ("research_search", None, True, "security", "api_design", "comparative_research", "domain"), ("research_search", None, None, None, "error_investigation", "error_investigation", "domain"), ("research_search", None, None, None, "security", "security_review", "domain"), ("research_search", None, None, None, "performance", "performance_investigation", "domain"),
    ("research_search", None, None, None, "version_migration", "version_migration", "domain"), ("research_search", None, None, None, "x", "comparative_research", "default"), ("security_search", None, True, "coding", "security", "security_review", "default"), ("other", None, None, None, None, None, None),
]
#: host, owner, repo, ref, path, url, language, symbol; raw URL, browser URL, permalink, language, role, reasons.
_CODE = [
    ("github", "o", "r", None, "src/a.rs", None, None, None, "https://raw.githubusercontent.com/o/r/main/src/a.rs", "https://github.com/o/r/blob/main/src/a.rs", "https://github.com/o/r/blob/main/src/a.rs", "rust", "implementation", "raw_url_derived,source_role_inferred,language_match"),
    ("github", "o", "r", "v1", "x.bin", "https://u", "go", "Foo", "https://raw.githubusercontent.com/o/r/v1/x.bin", "https://u", "https://github.com/o/r/blob/v1/x.bin", "go", "unknown", "raw_url_derived,language_match,provider_text_match"),
    ("gitlab", "o", "r", "dev", "tests/a.py", "https://u", None, None, "https://gitlab.com/o/r/-/raw/dev/tests/a.py", "https://u", "https://u", "python", "test", "raw_url_derived,source_role_inferred,language_match"),
    ("gitlab", "o", "r", "dev", "a.bin", None, None, None, "https://gitlab.com/o/r/-/raw/dev/a.bin", None, None, None, "unknown", "raw_url_derived"),
    ("codeberg", "o", "r", "dev", "README.md", "https://u", None, None, None, "https://u", None, "markdown", "readme", "source_role_inferred,language_match"),
    ("github", None, "r", "dev", "a.py", "https://u", None, None, None, None, None, None, None, None),
    ("github", "o", "r", "dev", None, "https://u", None, None, None, None, None, None, None, None),
]
_H = "<<<EXTERNAL_UNTRUSTED field=x id=1>>>"
#: text, most, cut text; warning, cut warning.
_CUTS = [
    ("plain text", 5, "plain", "code: text", "code"), ("plain", 50, "plain", "code: text", "code"), ("plain", 0, "", "code: text", "code"), (f"{_H}\nbody of it\n<<<END>>>", 52, f"{_H}\nbody\n<<<END>>>", "long_code: x", "long_code"), (f"{_H}\nbody\n<<<END>>>", 10, f"{_H}\n\n<<<END>>>", "long_code: x", "long_code"),
    (f"{_H}\nbody", 3, "<<<", "nocolon", "noc"), (f"{_H}\n\nbody\n\n<<<END>>>", 500, f"{_H}\nbody\n<<<END>>>", "a: b: c", "a"), ("x", 1, "x", "abc: x", "a"), ("x", 0, "", "nocolon", ""),
]


def workflow_models(spark, sf_dir):
    c = cases.given(spark, sf_dir, "events", "event_id", cases.columns("tool workflow exact profile domain", _MODELS), {"exact": "boolean"}, real=REAL["workflow_models"][0])
    return c.select("event_id", shaping.workflow_model(*[F.col(x) for x in "tool workflow exact profile domain".split()]).alias("m")).select("event_id", "m.model", "m.by")


def code_evidence(spark, sf_dir):
    names = "host owner repo ref path url language symbol".split()
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns(" ".join(names), _CODE), real=REAL["code_evidence"][0])
    e = c.select("p_partkey", shaping.code_evidence(*[F.col(x) for x in names]).alias("e"))
    return e.select("p_partkey", "e.raw_url", "e.browser_url", "e.permalink", "e.language", "e.role", F.array_join("e.reasons", ",").alias("reasons"))


def cut_texts(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("t n", _CUTS) | cases.columns("w", [r[3:] for r in _CUTS]), real=REAL["cut_texts"][0])
    return c.select("p_partkey", shaping.clipped(F.col("t"), F.col("n")).alias("text"), shaping.clipped_warning(F.col("w"), F.col("n")).alias("warning"))


_PATHS = ["src/main.rs", "src/parse/mod.rs", "tests/main.rs", "docs/parse.md", "src/Parse.rs", "a/main.rs.lock"]


def candidate_files(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS repo", f"concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '/', {cases.dealt('l_partkey', _PATHS)}) AS path", "CASE WHEN l_linenumber % 4 > 0 THEN 'rust' END AS language", "CASE l_orderkey % 3 WHEN 0 THEN 'implementation' ELSE 'test' END AS role")
    score = local.file_score(F.col("path"), F.lit("main.rs"), F.array(F.lit("parse"), F.lit("main")), F.col("language"), F.col("role"))
    return filing.candidates(t, 3, score, language="rust", file=".rs", folder="SRC")

#: language, source text, imports.
_SOURCES = [
    ("rust", "// use a\nuse std::fmt;\r\n  pub use crate::x;\nfn use_it() {}\nuser", "use std::fmt;|pub use crate::x;"), ("python", "# import os\nimport os\nfrom a import b\nfrom nowhere\nimporter", "import os|from a import b"), ("javascript", "import x from 'y'\nrequire('z')\n* import", "import x from 'y'|require('z')"),
    ("go", 'import (\n\t"fmt"\n\tx "y"\n)', 'import (|"fmt"'), ("cobol", "import x", ""), (None, "import x", ""), ("python", "x\n" * 50 + "import late", ""), ("rust", "", ""),
]
#: URL, fault; path, fault; ecosystem, package, namespace, fault.
_CHECKED = [
    ("https://x", None, "src/a.rs", None, "npm", "left-pad", None, None), (" ", "empty", "", "empty", "npm", " ", None, "empty"), ("ftp://x", "scheme", "a/../b", "parent", "npm", "a b", None, "space"), ("HTTP://x", None, "/etc", "absolute", "npm", "a?b", None, "delimiter"),
    (None, "empty", "a..b/c", None, "npm", "a//b", None, "segment"), ("http:/x", "scheme", "..", "parent", "npm", "@s/..", None, "segment"), ("x", "scheme", " ", "empty", "maven", "g:a", "org.x", "colon"), ("https://", None, "./a", None, "maven", "a", "/org", "traversal"),
    ("https://y", None, "a", None, "maven", "a", "o#x", "delimiter"), ("https://y", None, "a", None, "npm", "a", "o/./x", "segment"), ("https://y", None, "a", None, "oci", "a..b", "lib", "traversal"), ("https://y", None, "a", None, "oci", "a.b", "lib", None), ("https://y", None, "a", None, None, "a:b", "x..y", "traversal"),
]


def source_imports(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("lang t", _SOURCES), real=REAL["source_imports"][0])
    return c.select("p_partkey", F.array_join(shaping.imports(F.col("t"), F.col("lang")), "|").alias("imports"))


def address_faults(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", cases.columns("u p e n ns", [(r[0], r[2], *r[4:7]) for r in _CHECKED]), real=REAL["address_faults"][0])
    return c.select("p_partkey", shaping.bad_url(F.col("u")).alias("url"), shaping.bad_path(F.col("p")).alias("path"), shaping.bad_package(F.col("e"), F.col("n"), F.col("ns")).alias("package"))


def rendered(spark, sf_dir):
    """Turns of conversations as blocks of a document, as Markdown."""
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{cases.dealt('(conv_id + turn)', _BLOCKS)} AS kind", "cast(1 + turn % 3 AS int) AS level", "CASE turn % 2 WHEN 0 THEN 'py' END AS language", "CASE WHEN turn % 5 = 4 THEN '' ELSE concat(substr(text, 1, 20), '\n', turn) END AS text")
    blocks = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "kind", "level", "language", "text"))).alias("b"))
    return blocks.select("conv_id", shaping.markdown(F.col("b")).alias("markdown"))


_BLOCKS = ["heading", "paragraph", "list_item", "code", "table", "quote", "definition", "rule"]
QUERIES = {"source_imports": source_imports, "address_faults": address_faults, "rendered_markdown": rendered, "workflow_models": workflow_models, "code_evidence": code_evidence, "cut_texts": cut_texts, "candidate_files": candidate_files}
ORACLES = {
    "source_imports": cases.expected("part", "p_partkey", {"imports": [r[2] for r in _SOURCES]}, real=REAL["source_imports"][1]),
    "address_faults": cases.expected("part", "p_partkey", {"url": [r[1] for r in _CHECKED], "path": [r[3] for r in _CHECKED], "package": [r[7] for r in _CHECKED]}, real=REAL["address_faults"][1]),
    "rendered_markdown": f"""WITH t AS (SELECT conv_id, turn, {cases.dealt('(conv_id + turn)', _BLOCKS)} AS kind, CASE WHEN turn % 5 = 4 THEN '' ELSE substr(text, 1, 20) || chr(10) || turn END AS x FROM conversations),
l AS (SELECT conv_id, turn, CASE kind WHEN 'heading' THEN repeat('#', (1 + turn % 3)::INT) || ' ' || x || chr(10) || chr(10) WHEN 'list_item' THEN '- ' || x || chr(10) WHEN 'code' THEN '```' || CASE turn % 2 WHEN 0 THEN 'py' ELSE '' END || chr(10) || x || chr(10) || '```' || chr(10) || chr(10)
  WHEN 'quote' THEN CASE WHEN x = '' THEN chr(10) ELSE array_to_string(list_transform(string_split(x, chr(10)), lambda y: '> ' || y), chr(10)) || chr(10) || chr(10) END WHEN 'definition' THEN '**' || x || '**' || chr(10) || chr(10) WHEN 'rule' THEN '---' || chr(10) || chr(10) ELSE x || chr(10) || chr(10) END AS y FROM t)
SELECT conv_id, regexp_replace(string_agg(y, '' ORDER BY turn), '\\n+$', '') AS markdown FROM l GROUP BY conv_id""",
    "workflow_models": cases.expected("events", "event_id", cases.columns("model by", [r[5:] for r in _MODELS]), real=REAL["workflow_models"][1]).replace("AS by", 'AS "by"'),
    "code_evidence": cases.expected("part", "p_partkey", cases.columns("raw_url browser_url permalink language role reasons", [r[8:] for r in _CODE]), real=REAL["code_evidence"][1]),
    "cut_texts": cases.expected("part", "p_partkey", {"text": [r[2] for r in _CUTS], "warning": [r[4][: r[1]] if r[1] and r[3] != "nocolon" else r[4] for r in _CUTS]}, real=REAL["cut_texts"][1]),
    "candidate_files": f"""WITH f AS (SELECT l_suppkey AS repo, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '/', {cases.dealt('l_partkey', _PATHS)}) AS path, l_orderkey % 3 = 0 AS impl FROM lineitem WHERE l_linenumber % 4 > 0),
s AS (SELECT repo, path, CASE WHEN path LIKE '%/main.rs' AND false THEN 100 ELSE 0 END + CASE WHEN lower(path) LIKE '%parse%' THEN 20 ELSE 0 END + CASE WHEN lower(path) LIKE '%main%' THEN 20 ELSE 0 END AS b, regexp_matches(path, '/main[.]rs$') AS exact, impl FROM f WHERE contains(lower(path), 'src') AND contains(string_split(path, '/')[-1], '.rs')),
t AS (SELECT repo, path, (b + CASE WHEN exact THEN 100 ELSE 0 END + CASE WHEN b + CASE WHEN exact THEN 100 ELSE 0 END > 0 THEN 5 ELSE 0 END + CASE WHEN impl THEN 10 ELSE 5 END)::DOUBLE AS score FROM s)
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS place, path, score FROM t QUALIFY place <= 6""",
}
