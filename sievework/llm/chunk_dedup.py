"""Substring dedup by content-defined chunks.

A gear rolling hash (h = 2 h + G[byte], of which the bits used depend on the last 17 bytes)
cuts texts where it meets a mask: after white space for about one gap in four, so that
chunks are whole words; for one character in sixteen where no white space lies in the last
``UNGAPPED`` bytes, so that texts without white space are cut by content too; and elsewhere
for one character in 512. Chunks have 16 to 256 bytes. An insertion moves the cuts near it,
and no others. A chunk is known by its 128-bit digest; the copy at the smallest (doc_id,
text hash, place) stays. Runs of later copies grow at both ends, by up to ``REACH`` bytes
that agree with those beside the first copy, in whole characters. They are removed where
they then have at least ``least`` bytes; shorter runs, like a licence line, stay. A removed
byte has its like at an earlier place, so one copy of each passage stays.

Cost: for each chunk (about 40 bytes of text) half its digest is shuffled to be counted,
with map-side combination, and once more, with its place, to find the chunks whose half
occurs again. Those are written out; whole digests are compared among them only. A hot
digest is one row of the counts; counts and first copies are written out before they are
joined, so that both sides of a join are plain and Spark splits a hot digest. Texts are
shuffled once to meet their runs, and once more to give the bytes beside first copies, of
which each is asked for once. No group is collected but one document's own chunk numbers
and ends of runs.

Cases: a null text stays null, with no chunks; an empty text stays empty. Rows that repeat
an id and a text count as one and each get its result. A null id comes first. Empty tables
give no rows. Columns that clash with the result's are replaced, others kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import common

common.by_value(__name__)

SMALLEST, LARGEST = 16, 256
GAP_MASK, ANY_MASK, DENSE_MASK = 0b11 << 15, 0b111111111 << 8, 0b1111 << 11
#: Bytes without white space from which on a text is cut by its characters; bytes a run grows by.
UNGAPPED, REACH = 32, 260
CHUNKS = "doc_id long, th long, n int, d1 long, d2 long"


def gear():
    """256 fixed random values."""
    import numpy as np

    return np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes, table) -> list[int]:
    """Ends of the chunks of a text in UTF-8."""
    import numpy as np

    b = np.frombuffer(data, dtype=np.uint8)
    h, n = table[b], 1
    while n < 32:
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
        n *= 2
    after = np.append(b[1:], 0)
    start = (after & 0xC0) != 0x80
    white, white_after = (b == 32) | (b == 10) | (b == 9), (after == 32) | (after == 10) | (after == 9)
    at = np.arange(len(b))
    dense = at - np.maximum.accumulate(np.where(white, at, -1)) >= UNGAPPED
    places = np.flatnonzero(start & ((white & ~white_after & ((h & GAP_MASK) == 0)) | ((h & ANY_MASK) == 0) | (dense & ((h & DENSE_MASK) == 0)))) + 1
    out, last = [], 0
    for p in [*places.tolist(), len(data)]:
        while p - last > LARGEST:
            last += LARGEST
            while last < len(data) and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if p - last >= SMALLEST or (p == len(data) and p > last):
            out.append(p)
            last = p
    return out


def alike(x: bytes, y: bytes) -> int:
    """The length of the common start of two byte strings."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid)
    return low


def grown(data: bytes, a: int, b: int, before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """A run of bytes with those on either side that agree with the ones beside its first copy."""
    if before:
        a -= alike(data[max(0, a - len(before)) : a][::-1], before[::-1])
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
    if after:
        b += alike(data[b : b + len(after)], after)
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
    return a, b


def runs(data: bytes, ends: list[int], copies: list[int], least: int, befores: dict | None = None, afters: dict | None = None) -> list[tuple[int, int]]:
    """Byte ranges of the runs of the chunks numbered in copies, grown by the bytes that stand
    before and after the first copies of their outer chunks, where they have ``least`` bytes."""
    own: list[list[int]] = []
    for k in sorted(set(copies)):
        if own and own[-1][1] == k - 1:
            own[-1][1] = k
        else:
            own.append([k, k])
    out: list[list[int]] = []
    for i, j in own:
        a, b = grown(data, ends[i - 1] if i else 0, ends[j], (befores or {}).get(i), (afters or {}).get(j))
        if out and a <= out[-1][1]:
            out[-1] = [min(a, out[-1][0]), max(b, out[-1][1])]
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, d1, d2: the chunks of each text, with two halves of the digest."""
    common.small_batches(docs.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        table = gear()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids, ths, ns, ds = [], [], [], []
                part = batch.slice(a, 64)
                for i, th, text in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                    data, last = (text or "").encode("utf-8"), 0
                    for n, end in enumerate(cuts(data, table)):
                        ids.append(i)
                        ths.append(th)
                        ns.append(n)
                        ds.append(xxhash.xxh3_128_digest(data[last:end]))
                        last = end
                halves = np.frombuffer(b"".join(ds), dtype=np.int64).reshape(-1, 2)
                cols = [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ns, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "d1", "d2"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(cut, CHUNKS)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, first: the chunks that are copies of an earlier one, and its place."""
    found = chunks(docs)
    often = common.materialise(found.groupBy("d1").count().filter("count > 1").select("d1"), "chunks-repeated")
    held = common.materialise(found.join(often, "d1"), "chunks")
    place = F.struct("doc_id", "th", "n")
    first = held.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    first = common.materialise(first, "chunks-first")
    return held.join(first, ["d1", "d2"]).filter(place != F.col("first")).select("doc_id", "th", "n", "first")


def _keyed(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """df with _i, the id or the least long where it is null."""
    return df.withColumn("_i", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))))


def beside(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """_i, _th, n, left, bytes: what stands before (left) or after the chunks asked for (_i, _th, n, left)."""
    wanted = asked.distinct().groupBy("_i", "_th").agg(F.collect_list(F.struct("n", "left")).alias("places"))
    texts = _keyed(docs.select("doc_id", "text")).select("_i", F.xxhash64("text").alias("_th"), "text")

    def give(batches):
        import pyarrow as pa

        table, names = gear(), ["_i", "_th", "n", "left", "bytes"]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out = []
                for i, th, text, places in zip(*[c.to_pylist() for c in batch.slice(a, 64).columns], strict=True):
                    data = (text or "").encode("utf-8")
                    ends = cuts(data, table)
                    for n, left in {(p["n"], p["left"]) for p in places}:
                        start = ends[n - 1] if n else 0
                        out.append((i, th, n, left, data[max(0, start - REACH) : start] if left else data[ends[n] : ends[n] + REACH]))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    # Rows that repeat an id and a text give their bytes once.
    met = texts.join(wanted, ["_i", "_th"]).dropDuplicates(["_i", "_th"]).select("_i", "_th", "text", "places")
    return met.mapInArrow(give, "_i long, _th long, n int, left boolean, bytes binary")


def ends_of_runs(docs: DataFrame) -> DataFrame:
    """_i, th, ns (numbers of the chunks that are copies) and ends (n, left, bytes beside the first copy)."""
    later = common.materialise(_keyed(copies(docs)), "copies")
    w = Window.partitionBy("_i", "th").orderBy("n")
    outer = later.withColumns({"prev": F.lag("n").over(w), "next": F.lead("n").over(w)})
    sides = F.array_compact(F.array(F.when(F.coalesce(F.col("prev") < F.col("n") - 1, F.lit(True)), F.lit(True)), F.when(F.coalesce(F.col("next") > F.col("n") + 1, F.lit(True)), F.lit(False))))
    edges = _keyed(outer.withColumn("left", F.explode(sides)).select("_i", "th", "n", "left", "first").withColumnRenamed("_i", "own"), "first.doc_id")
    edges = common.materialise(edges.select("own", "th", F.col("n").alias("own_n"), "left", "_i", F.col("first.th").alias("_th"), F.col("first.n").alias("n")), "ends")
    found = edges.join(beside(docs, edges.select("_i", "_th", "n", "left")), ["_i", "_th", "n", "left"])
    ends = found.groupBy(F.col("own").alias("_i"), "th").agg(F.collect_list(F.struct(F.col("own_n").alias("n"), "left", "bytes")).alias("ends"))
    return later.groupBy("_i", "th").agg(F.collect_set("n").alias("ns")).join(ends, ["_i", "th"])


def dedup(docs: DataFrame, least: int = 96) -> DataFrame:
    """docs with kept_text, n_bytes, n_removed, n_spans and spans (byte ranges in the original)."""
    common.small_batches(docs.sparkSession)
    extra = ["kept_text", "n_bytes", "n_removed", "n_spans", "spans"]
    kept = [c for c in docs.columns if c.lower() not in extra]
    found = ends_of_runs(docs)
    result = T.StructType(
        [
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )

    def one(text, ns, ends, table):
        if text is None:
            return None, 0, 0, 0, []
        data, spans = text.encode("utf-8"), []
        if ns is not None and len(ns):
            befores, afters = ({e["n"]: bytes(e["bytes"]) for e in ends if e["left"] == left} for left in (True, False))
            spans = runs(data, cuts(data, table), list(ns), least, befores, afters)
        out, last = [], 0
        for a, b in spans:
            out.append(data[last:a])
            last = b
        return b"".join([*out, data[last:]]).decode("utf-8") if spans else text, len(data), sum(b - a for a, b in spans), len(spans), [list(s) for s in spans]

    @F.pandas_udf(result)
    def apply(texts: pd.Series, ns: pd.Series, ends: pd.Series) -> pd.DataFrame:
        table = gear()
        return pd.DataFrame([one(t, n, e, table) for t, n, e in zip(texts, ns, ends, strict=True)], columns=extra)

    joined = (
        _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id", F.xxhash64("text").alias("th")))
        .join(found, ["_i", "th"], "left")
        .select("row", apply(F.col("row.text"), F.col("ns"), F.col("ends")).alias("found"))
    )
    return joined.select(*[F.col(f"row.`{c}`") for c in kept], *[f"found.{c}" for c in extra])


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"), F.col("kept_text").alias("text")
    )
