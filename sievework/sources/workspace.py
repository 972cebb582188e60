"""Folders of files as tables: what is there by Spark's listing alone, and the contents of what is kept.

Ignore rules and the conditions of indexing are predicates over the file's metadata, which Spark applies to its
listing: a file that they leave out becomes no part of any task, so its bytes are never opened."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import local, paths
from sievework.operators import state

MOST_BYTES = 1_048_576


def _kept(spark: SparkSession, root: str, rules: list[str], most_bytes: int, hidden: bool) -> DataFrame:
    """binaryFile rows with path (below root), size and modified_at of the files that are kept."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    meta = F.col("_metadata")
    # Addresses of files are encoded, but a plus sign in them is no space.
    whole = F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(whole, rf"^[^:/]+:(?://[^/]*)?{re.escape(top)}/", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    size = meta["file_size"]
    return files.where(~state.is_ignored(path, rules) & local.eligible(path, size, most_bytes, hidden)).withColumns({"_path": path, "_size": size, "_modified": meta["file_modification_time"]})


def inventory(spark: SparkSession, root: str, rules: list[str] = (), most_bytes: int = MOST_BYTES, hidden: bool = False) -> DataFrame:
    """path (below root), size, modified_at, language, role of the files below root that are indexed: not left out by
    the rules (see ``state.ignored``), no skipped or hidden folder or binary ending, at most most_bytes long. No contents
    are read. Empty files are passed over by Spark's listing. A root without files gives no rows; one that does not exist
    is an error."""
    rows = _kept(spark, root, list(rules), most_bytes, hidden)
    return rows.select(F.col("_path").alias("path"), F.col("_size").alias("size"), F.col("_modified").alias("modified_at"), paths.language(F.col("_path")).alias("language"), paths.source_role(F.col("_path")).alias("role"))


def contents(spark: SparkSession, root: str, rules: list[str] = (), most_bytes: int = MOST_BYTES, hidden: bool = False) -> DataFrame:
    """path, size, text of the same files; bytes that are no UTF-8 are shown as replacement characters."""
    rows = _kept(spark, root, list(rules), most_bytes, hidden)
    return rows.select(F.col("_path").alias("path"), F.col("_size").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
