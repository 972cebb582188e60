"""Mixing sources to target weights on a low-discrepancy schedule.

Targets: the mix is ``share`` of all words, split over the sources by weight; a source that
would give more than ``passes`` times its words stops there, and the excess is shared again.
Schedule: slot i gets the point i times the golden ratio, modulo one, as an exact 64-bit
fraction, and the point falls to a source through the cumulative targets; so every stretch
of the schedule holds the sources near their shares. A slot is the r-th of its source, and
takes the r-th block of that source: exactly ``block`` words of the source's documents in
shuffled order, laid end to end and passed over again from the start when they run out. The
block in which a source meets its target is cut there, and slots after it take nothing. A
low-discrepancy schedule leaves a source a few blocks short at most; those follow in slots
after the last, so that each source gives its target to the word. What a document gives is
the sum over the slots that meet it.

Cost: only ids and sizes are shuffled, never texts. Documents are put in order by range, and
what lies before a range is summed over ranges, so no window grows with a source. Ranks of
slots come in chunks of 65,536 with sums over chunks. The table of sources is collected,
after a check of its size.

Cases: a null or empty text has size 0 and is never taken; a text of any length is counted
whole and may lie in many blocks. A null source is a source, the last. No words at all:
every target is 0 and the schedule is empty. Repeated rows are laid end to end like others.
A rerun gives the same mix: shuffling is a hash of id and text. Columns that clash with the
result's are replaced, others kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

common.by_value(__name__)

GOLDEN = 11400714819323198485  # 2 ** 64 divided by the golden ratio, odd
CHUNK = 65_536


def targets(sizes: list[int], weights: list[float], share: float, passes: int) -> list[float]:
    """Words each source should give: by weight, none above passes times its size."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        part = (total - sum(out[k] for k in range(len(sizes)) if k not in free)) / sum(weights[k] for k in free)
        over = {k for k in free if part * weights[k] > passes * sizes[k]}
        for k in over or free:
            out[k] = float(passes * sizes[k]) if over else part * weights[k]
        free = free - over if over else set()
    return out


def sized(docs: DataFrame):
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.TOKEN)), F.lit(0)).cast("long"))


class Mix:
    """documents: docs' columns with size, source_size, target, and _s and _start, the place in
    the source's stream. schedule: slot, _s, rank. pieces: slot, _s, rank, _start, from_word
    and words, the runs of words that a slot takes of a document."""

    def __init__(self, docs: DataFrame, share=1.5, weights=(5, 2, 1), passes=2, block=512, golden=GOLDEN, max_sources=100_000):
        spark = docs.sparkSession
        self.kept = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken", "first_slot", "text"}]
        rows = common.materialise(
            sized(docs).select(*[F.col(f"`{c}`") for c in self.kept], "size", F.xxhash64("doc_id", "text", F.lit("mix")).alias("_o")), "mix-sizes"
        )
        found = rows.groupBy("source").agg(F.sum("size").alias("words")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["words"] for r in found]
        goal = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share, passes)
        whole = [round(t) for t in goal]
        self.block = block
        self.schedule = self._schedule(spark, whole, -(-sum(whole) // block), golden)
        table = [(k, r["source"], sizes[k], goal[k], whole[k]) for k, r in enumerate(found)]
        self.sources = spark.createDataFrame(table, "_s int, _source string, source_size long, target double, _whole long")
        self.documents = self._placed(rows)
        self.pieces = self._pieces(passes)

    def _schedule(self, spark, whole: list[int], slots: int, golden: int) -> DataFrame:
        import numpy as np

        cum, total = 0, max(1, sum(whole))
        edges = []
        for w in whole:
            cum += w
            edges.append(min(2**64 - 1, (cum << 64) // total))
        edges = np.array(edges, dtype=np.uint64)

        @F.pandas_udf("int")
        def source_of(slot: pd.Series) -> pd.Series:
            x = slot.to_numpy().astype(np.uint64) * np.uint64(golden)
            return pd.Series(np.minimum(np.searchsorted(edges, x, side="right"), len(edges) - 1).astype(np.int32))

        held = common.materialise(spark.range(slots).select(F.col("id").alias("slot"), source_of("id").alias("_s")), "mix-slots")
        each = held.withColumn("_c", F.floor(F.col("slot") / CHUNK))
        sums = common.materialise(each.groupBy("_s", "_c").count(), "mix-chunks")
        counts = {r[0]: r[1] for r in sums.groupBy("_s").agg(F.sum("count")).collect()}
        before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        shift = sums.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        own = F.row_number().over(Window.partitionBy("_s", "_c").orderBy("slot")) - 1
        ranked = each.withColumn("_r", own).join(shift, ["_s", "_c"]).select("slot", "_s", (F.col("_r") + F.col("_before")).alias("rank"))
        late, at = [], slots
        for k, w in enumerate(whole):
            has, wants = counts.get(k, 0), -(-w // self.block)
            if wants > has:
                late.append((k, has, at, wants - has))
                at += wants - has
        more = spark.createDataFrame(late, "_s int, _has long, _at long, _more long").select("_s", "_has", "_at", F.explode(F.expr("sequence(0L, _more - 1)")).alias("_k"))
        return ranked.unionByName(more.select((F.col("_at") + F.col("_k")).alias("slot"), "_s", (F.col("_has") + F.col("_k")).alias("rank")))

    def _placed(self, rows: DataFrame) -> DataFrame:
        named = rows.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        # Written with the number of its range, so that a lost task cannot deal rows anew.
        ranged = common.materialise(named.repartitionByRange("_s", "_o", "doc_id", "size").withColumn("_p", F.spark_partition_id()), "mix-ranges")
        sums = common.materialise(ranged.groupBy("_s", "_p").agg(F.sum("size").alias("_sum")), "mix-sums")
        before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        shift = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
        inside = Window.partitionBy("_s", "_p").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(shift, ["_s", "_p"])
        return common.materialise(placed.withColumn("_start", F.col("_in") + F.col("_before")).drop("_p", "_o", "_in", "_before"), "mix-documents")

    def _pieces(self, passes: int) -> DataFrame:
        n = self.block
        laid = (
            self.documents.filter("size > 0")
            .select("_s", "_start", "size", "source_size", "_whole", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"))
            .withColumn("_at", F.expr("_pass * source_size + _start"))
            .withColumn("_end", F.expr("least(_at + size, _whole)"))
            .filter("_at < _end")
            .withColumn("rank", F.explode(F.expr(f"sequence(_at div {n}, (_end - 1) div {n})")))
            .withColumn("_from", F.expr(f"greatest(_at, rank * {n})"))
            .withColumn("_to", F.expr(f"least(_end, (rank + 1) * {n})"))
            .selectExpr("_s", "rank", "_start", "_from - _at AS from_word", "_to - _from AS words")
        )
        return laid.join(self.schedule, ["_s", "rank"])

    def taken(self) -> DataFrame:
        """docs (without text) plus size, source_size, target, taken (words in the mix, repeats
        counted) and first_slot (the first slot that takes of the document; null where none does)."""
        sums = self.pieces.groupBy("_s", "_start").agg(F.sum("words").alias("_taken"), F.min("slot").alias("_first"))
        full = F.col("size") > 0
        return self.documents.join(sums, ["_s", "_start"], "left").select(
            *[F.col(f"`{c}`") for c in self.kept],
            "size",
            "source_size",
            "target",
            F.when(full, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
            F.when(full, F.col("_first")).alias("first_slot"),
        )


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Mix(docs).taken().select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")
