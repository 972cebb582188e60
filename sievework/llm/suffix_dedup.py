"""Exact substring dedup by prefix-free parsing, bucket by bucket of the corpus order.

Removed is each byte covered by a string of ``length`` bytes that starts anywhere else too.

Parsing: a rolling hash of 16 bytes triggers about once in 16 bytes; a phrase runs from one
trigger's window to the end of the next one's. Equal strings contain equal triggers and so
equal phrases: the distinct phrases are the dictionary, a text is its parse. In the order
of all suffixes, strings of ``length`` bytes that are equal stand together. That order is
not built as one array. It falls into buckets that no equal strings straddle: a string
belongs to the phrase of smallest digest among those it contains whole (the first, of
equal ones), or to its only trigger, if it contains no phrase. Neighbouring starts share that phrase, so one row, the context, stands for
up to some 400 starts; a string without a trigger is a row of its own.

Contexts that are equal are folded first, within their text and then among texts: their starts
are all copies, whatever their number, and one of them goes on. So a line that texts repeat
over and over is one row of each text where equal contexts meet. Contexts of a phrase that has several then meet in a
task, which names all their strings by prefix doubling, puts them into the order of
(phrase, name) and marks equal neighbours. A phrase with over ``crowd`` contexts, which
might not fit a task, has its strings counted one by one instead, with map-side
combination; so no group is cut short.

Cost: one row for about 170 bytes; its bucket is counted first, with map-side combination,
and buckets of one row go no further. Counts are written out before they are joined, so that
a join on a phrase has two plain sides and splits a hot phrase over tasks. Texts are shuffled
to give the bytes of contexts that need them, and once more to be cut. Names and digests have 128 bits between
bucket and string; equal ones are taken to be equal.

Cases: a null text counts as empty; a text shorter than ``length`` keeps all its bytes, and
matches never cross rows. Rows that repeat an id and a text are each other's copies. Empty
tables give no rows. Columns that clash with the result's are replaced, others kept. Cuts
may fall inside a character, so what is kept is binary.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import common

common.by_value(__name__)

WINDOW, GAP_BITS = 16, 4
FLUSH = 2_000_000
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PLACE = "k1 long, k2 long, s1 int, s2 int"


def triggers(b, table):
    """Ends of the triggering windows of a uint8 array."""
    import numpy as np

    if len(b) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    h, n = table[b], 1
    while n < WINDOW:
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
        n *= 2
    return np.flatnonzero(h[WINDOW - 1 :] >> np.uint32(32 - GAP_BITS) == 0) + WINDOW


def _merged(label, at, to) -> list[tuple[int, int, int]]:
    """(label, first, last) of the runs of equal labels; neighbours of one label adjoin."""
    import numpy as np

    if not len(label):
        return []
    new = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    return list(zip(label[new].tolist(), at[new].tolist(), to[np.append(new[1:] - 1, len(at) - 1)].tolist(), strict=True))


def _once(rows: list[tuple[int, bytes, int, int, int]]) -> list[tuple[int, bytes, int, int, int]]:
    """The contexts of a text, those that it holds more than once folded into their first place and runs of their starts."""
    times = Counter(r[:2] for r in rows)
    if len(times) == len(rows):
        return rows
    out, again, met = [], [], set()
    for r in rows:
        if times[r[:2]] == 1:
            out.append(r)
            continue
        again.append(r[2:4])
        if r[:2] not in met:
            met.add(r[:2])
            out.append((*r[:4], 2))
    runs: list[list[int]] = []
    for a, b in sorted(again):
        if runs and a == runs[-1][1] + 1:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return out + [(0, bytes(16), a, b, 0) for a, b in runs]


def contexts(data: bytes, length: int, table) -> list[tuple[int, bytes, int, int, int]]:
    """(bucket, digest, first start, last start, times): every start of a string of ``length``
    bytes once. times is 1, or 2 for a context that the text holds more than once; it stands
    for the first of its places, and the starts of all of them are in rows of times 0."""
    import numpy as np
    import xxhash

    if len(data) < length:
        return []
    hash64, hash128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    e = triggers(np.frombuffer(data, dtype=np.uint8), table)
    last = len(data) - length
    at = np.unique(np.concatenate([[0], e - WINDOW + 1, e - length]))
    at = at[(at >= 0) & (at <= last)]
    to = np.append(at[1:] - 1, last)
    lo, hi = np.searchsorted(e, at + WINDOW), np.searchsorted(e, at + length, side="right") - 2
    out, whole = [], []
    one = (hi < lo) & (np.searchsorted(e, at + length, side="right") > lo)
    for k, a, b in _merged(lo[one], at[one], to[one]):
        whole.append((hash64(data[e[k] - WINDOW : e[k]], 1), hash128(data[a : b + length]), a, b, 1))
    none = (hi < lo) & ~one
    poor = [s for a, b in zip(at[none].tolist(), to[none].tolist(), strict=True) for s in range(a, b + 1)]
    if poor:
        digests = [hash128(data[s : s + length]) for s in poor]
        times = Counter(digests)
        first = dict(zip(reversed(digests), reversed(poor), strict=True))
        out += [(int.from_bytes(h[:8], "little"), h, s, s, min(2, times[h])) for h, s in first.items()]
        again = np.array([s for s, h in zip(poor, digests, strict=True) if times[h] > 1], dtype=np.int64)
        if len(again):
            new = np.flatnonzero(np.append(True, again[1:] != again[:-1] + 1))
            ends = again[np.append(new[1:] - 1, len(again) - 1)].tolist()
            out += [(0, bytes(16), a, b, 0) for a, b in zip(again[new].tolist(), ends, strict=True)]
    rich = hi >= lo
    if not rich.any():
        return out + _once(whole)
    at, to, lo, hi = at[rich], to[rich], lo[rich], hi[rich]
    ends = e.tolist()
    digest = np.array([hash64(data[a - WINDOW : b]) for a, b in zip(ends, ends[1:], strict=False)], dtype=np.uint64)
    best, levels, span = np.arange(len(digest)), [], 1
    levels.append(best)
    most = int((hi - lo).max()) + 1
    while 2 * span <= most:
        left, right = best[:-span], best[span:]
        best = np.where(digest[left] <= digest[right], left, right)
        levels.append(best)
        span *= 2
    size = hi - lo + 1
    level = np.frexp(size)[1] - 1
    least = np.empty_like(lo)
    for k, best in enumerate(levels):
        own = level == k
        left, right = best[lo[own]], best[hi[own] - (1 << k) + 1]
        least[own] = np.where(digest[left] <= digest[right], left, right)
    for k, a, b in _merged(least, at, to):
        whole.append((int(digest[k]), hash128(data[a : b + length]), a, b, 1))
    return out + _once(whole)


def names(b, length: int):
    """A 64-bit name of the string of ``length`` bytes at each place of a uint8 array (too short at the end: dropped)."""
    import numpy as np

    def mix(x, y):
        z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ ((y << np.uint64(29)) | (y >> np.uint64(35)))
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(29))

    h, n = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)[b], 1
    while 2 * n <= length:
        h = mix(h[:-n], h[n:])
        n *= 2
    return h if n == length else mix(h[: len(b) - length + 1], h[length - n : len(b) - n + 1])


def marked(group, texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(number, first, last): runs of starts whose string occurs again in a text of the same group."""
    import numpy as np

    whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    name = names(whole, length)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(name)]
    inside = np.arange(len(name)) - offset[owner] <= sizes[owner] - length
    place = np.flatnonzero(inside)
    key, owner = name[place], owner[place]
    order = np.lexsort((key, group[owner]))
    same = (key[order][1:] == key[order][:-1]) & (group[owner[order]][1:] == group[owner[order]][:-1])
    hit = np.zeros(len(place), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    place, owner = place[hit], owner[hit]
    if not len(place):
        return []
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])))
    end = np.append(new[1:] - 1, len(place) - 1)
    start = place - offset[owner]
    return list(zip(owner[new].tolist(), start[new].tolist(), start[end].tolist(), strict=True))


def _keyed(docs: DataFrame):
    """docs with k1 and k2, which tell its rows apart but for repeated ones."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def _written(df: DataFrame, name: str) -> DataFrame:
    """common.materialise, after which the shuffles of df leave the disks at once, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        return common.materialise(df, name)
    finally:
        conf.set(FREED, before)


def found(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """k1, k2, s1, s2: runs of starts of strings that occur again."""
    from sievework.llm.chunk_dedup import gear

    common.small_batches(docs.sparkSession)

    def parse(batches):
        import numpy as np
        import pyarrow as pa

        table = gear()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part, rows, keys = batch.slice(a, 64), [], []
                for k1, k2, text in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                    got = contexts((text or "").encode("utf-8"), length, table)
                    rows += got
                    keys += [(k1, k2)] * len(got)
                c = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.int64).reshape(-1, 2)
                k = np.array(keys, dtype=np.int64).reshape(-1, 2)
                d = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
                s = [pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3, 4)]
                cols = [pa.array(x) for x in (d, c[:, 0], c[:, 1], k[:, 0], k[:, 1])] + s
                yield pa.RecordBatch.from_arrays(cols, ["d", "c1", "c2", "k1", "k2", "s1", "s2", "times"])

    keyed = _keyed(docs).select("k1", "k2", "text")
    rows = _written(keyed.mapInArrow(parse, f"d long, c1 long, c2 long, {PLACE}, times int"), "suffix-contexts")
    place = F.struct("k1", "k2", "s1", "s2")
    own = rows.filter("times > 0")
    often = _written(own.groupBy("d").agg(F.sum("times").alias("n")).filter("n > 1").select("d"), "suffix-repeated")
    own = _written(own.join(often, "d"), "suffix-often")
    folded = _written(own.groupBy("d", "c1", "c2").agg(F.sum("times").alias("times"), F.min(place).alias("one")), "suffix-folded")
    known = rows.filter("times = 0").select("k1", "k2", "s1", "s2")
    copies = known.unionByName(own.join(folded.filter("times > 1").select("d", "c1", "c2"), ["d", "c1", "c2"]).select("k1", "k2", "s1", "s2"))
    several = _written(folded.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-several")
    meeting = _written(folded.join(several, "d").select("d", "n", "one.*"), "suffix-meeting")

    def with_bytes(some: DataFrame) -> DataFrame:
        """d, k1, k2, s1 and the bytes of each context. Copies of a row that a task meets in a row are cut once;
        what is left of them is passed over where contexts are compared."""
        each = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("d", "s1", "s2")).alias("own"))

        def cut(batches):
            import pyarrow as pa

            last = None
            for batch in batches:
                for a in range(0, batch.num_rows, 32):
                    out = []
                    for r in batch.slice(a, 32).to_pylist():
                        if (r["k1"], r["k2"]) == last:
                            continue
                        last = (r["k1"], r["k2"])
                        data = (r["text"] or "").encode("utf-8")
                        out += [(c["d"], r["k1"], r["k2"], c["s1"], data[c["s1"] : c["s2"] + length]) for c in r["own"]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["d", "k1", "k2", "s1", "bytes"])

        return keyed.join(each, ["k1", "k2"]).mapInArrow(cut, "d long, k1 long, k2 long, s1 int, bytes binary")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def answer(rows):
            group = np.array([r[0] for r in rows], dtype=np.int64)
            out = [(rows[j][1], rows[j][2], rows[j][3] + a, rows[j][3] + b) for j, a, b in marked(group, [r[4] for r in rows], length)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["k1", "k2", "s1", "s2"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if held and row == held[-1]:
                    continue
                if size > FLUSH and row[0] != held[-1][0]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield answer(held)

    sorted_rows = with_bytes(meeting.filter(F.col("n") <= crowd)).repartition("d").sortWithinPartitions("d", "k1", "k2", "s1")
    out = copies.unionByName(sorted_rows.mapInArrow(compare, PLACE))
    if several.filter(F.col("n") > crowd).limit(1).count():

        def single(batches):
            import pyarrow as pa
            import xxhash

            for batch in batches:
                for _, k1, k2, s1, data in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                    n = len(data) - length + 1
                    h = [xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h, pa.binary()), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(s1, s1 + n), pa.int32())], ["h", "k1", "k2", "s1"]
                    )

        strings = with_bytes(meeting.filter(F.col("n") > crowd)).mapInArrow(single, "h binary, k1 long, k2 long, s1 int")
        again = _written(strings.groupBy("h").count().filter("count > 1").select("h"), "suffix-strings")
        out = out.unionByName(strings.join(again, "h").select("k1", "k2", "s1", F.col("s1").alias("s2")))
    return out


def dedup(docs: DataFrame, length: int = 400, crowd: int = 5000) -> DataFrame:
    """docs with kept (the remaining bytes), n_bytes, n_removed, n_spans and spans (byte ranges removed)."""
    extra = ["kept", "n_bytes", "n_removed", "n_spans", "spans"]
    cols = [c for c in docs.columns if c.lower() not in extra]
    spans = found(docs, length, crowd).groupBy("k1", "k2").agg(F.collect_set(F.struct("s1", "s2")).alias("own"))
    result = T.StructType([T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in extra[1:4]], T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def one(text, own):
        data = (text or "").encode("utf-8")
        gone: list[list[int]] = []
        for a, b in sorted((r["s1"], r["s2"] + length) for r in (own if own is not None else ())):
            if gone and a <= gone[-1][1]:
                gone[-1][1] = max(b, gone[-1][1])
            else:
                gone.append([a, b])
        edges = [0, *[x for s in gone for x in s], len(data)]
        kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
        return kept, len(data), len(data) - len(kept), len(gone), gone

    @F.pandas_udf(result)
    def apply(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, o) for t, o in zip(texts, own, strict=True)], columns=extra)

    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    joined = _keyed(docs).select(row, "k1", "k2").join(spans, ["k1", "k2"], "left").select("row", apply(F.col("row.text"), F.col("own")).alias("found"))
    return joined.select(*[F.col(f"row.`{c}`") for c in cols], *[f"found.{c}" for c in extra])


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The digest is of the bytes; in the text a character that a cut has halved is U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)
