"""Queries over folders of files, with their DuckDB SQL. The texts of documents are written out as files below
folders of their source and language, and the folders are walked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievework.session import shared_dir, table
from sievework.sources import workspace

#: Leaves out two languages, one of them taken back in for a source, and what the writer leaves beside the files.
RULES = ["# written by hand", "lang=de/", "lang=fr", "!src=0/lang=fr", "_*", "*.crc"]


_SRC = "length(coalesce(source, '')) % 5"


def tree(spark, sf_dir) -> str:
    """Documents below a new folder on the shared one: src=<n>/lang=<language>/part-*.txt, a line for each line."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL").selectExpr("text AS value", f"{_SRC} AS src", "lang")
    docs.write.partitionBy("src", "lang").text(root)
    return root


_FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder"


def workspace_folders(spark, sf_dir):
    found = workspace.inventory(spark, tree(spark, sf_dir), RULES, most_bytes=2**62)
    return found.groupBy(F.expr(_FOLDER)).agg(F.sum("size").alias("n_bytes"))


def workspace_lines(spark, sf_dir):
    found = workspace.contents(spark, tree(spark, sf_dir), RULES, most_bytes=2**62)
    return found.groupBy(F.expr(_FOLDER)).agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


QUERIES = {"workspace_folders": workspace_folders, "workspace_lines": workspace_lines}

_KEPT = f"d AS (SELECT concat('src=', {_SRC}, '/lang=', lang) AS folder, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND lang <> 'de' AND (lang <> 'fr' OR {_SRC} = 0))"
ORACLES = {
    "workspace_folders": f"WITH {_KEPT} SELECT folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM d GROUP BY ALL",
    "workspace_lines": f"WITH {_KEPT} SELECT folder, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM d GROUP BY ALL",
}
