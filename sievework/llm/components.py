"""Connected components of an edge table by alternating large and small stars.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest
node it sees; the edge table ends as stars around the smallest node of each component.
Rounds grow with the logarithm of the longest chain. Each round is written to the shared
folder, so a lost executor costs one round; so is what each node sees before it is joined, so
that both sides of a join are plain and Spark splits the edges of a node with very many.
Nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that is not the smallest of its component; b is the smallest.

    edges: longs a, b in any order; repeats and loops do no harm; null ends are dropped."""
    now = common.materialise(
        edges.dropna().filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = common.materialise(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        below = common.materialise(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = large.join(below, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = common.materialise(small.unionByName(below.withColumnRenamed("m", "b")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
