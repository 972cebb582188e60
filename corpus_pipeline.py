"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark
decontamination and mixing, one after the other over the documents table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import chunk_dedup, common, decontaminate, langid, mixing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or that nothing learned fits, go."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.filter("lang_pred != 'und' and score >= 0.1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five words, Jaccard 0.8."""
    return simhash.unlike_documents(docs, least=0.8, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows."""
    out = chunk_dedup.dedup(docs)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it."""
    return mixing.Mix(docs).taken().select("doc_id", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Language ID, fingerprints, chunks and the schedule are beyond SQL; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
