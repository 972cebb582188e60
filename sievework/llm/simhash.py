"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint sums the bits of the XXH64 hashes of all word shingles. Equal fingerprints
are folded into one first. Distinct fingerprints are cut into tiles by the population counts
of their two halves: the halves' counts of two fingerprints differ by no more, added up, than
their bits do, so a tile meets only the tiles whose counts lie within the radius, and every
other pair of tiles is skipped. A large tile is split into parts of about ``tile``
fingerprints. A task compares a pair of parts block by block, by exclusive-or and bit counts,
and answers with links to the smallest linked member, never with all pairs; components join
the links. No pair within the radius is missed.

Cost: texts are read once and not shuffled. A fingerprint travels to some twenty tiles, as
8 bytes; beyond ``tile`` fingerprints in a tile that grows with the number of its parts. The
work grows with the square of the distinct fingerprints, about one pair in four being compared.

Cases: a null or empty text, or white space alone, has fingerprint zero and is linked like
any other. Repeated rows share a fingerprint. A null id is passed over where another id
is in the component; without one component_id is null. Empty tables give no rows. Columns
named fingerprint or component_id are replaced, one named fp is left out of near_duplicates(),
others are kept.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.llm.components import stars

common.by_value(__name__)

BLOCK = 65_536

#: The near-dedup stage: longs of a wide SimHash, bits of the first and of all within which a
#: pair is looked at exactly (Jaccard 0.8 gives 9.7 and 39 by the angle formula); sets in a tile at
#: most; tiles that small tables have at most; sets of a candidate component that one task holds.
WIDE, NEAR, NEAR_WIDE = 4, 22, 68
TILE, FEW_TILES, HELD = 65_536, 32, 2_048


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs plus fp, the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp("text"))


def _shifts(radius: int) -> list[int]:
    """Differences of packed counts of halves within the radius, one of each pair of opposites, and zero."""
    return [(a << 8) + b for a, b in product(range(-radius, radius + 1), repeat=2) if abs(a) + abs(b) <= radius and (a, b) >= (0, 0)]


def joined(a, b):
    """(member, smallest member it reaches) of links between the values of two int64 arrays."""
    import numpy as np

    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = at[: len(a)], at[len(a) :], np.arange(len(keys))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, new[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    held = low != np.arange(len(keys))
    return keys[held], keys[low[held]]


def links_between(a, b, radius: int):
    """(member, smallest member it reaches) for the linked fingerprints of two int64 arrays."""
    import numpy as np

    ua, ub = a.view(np.uint64), b.view(np.uint64)
    top, found, size = np.iinfo(np.int64).max, [], 0
    for r in range(0, len(a), 256):
        for c in range(0, len(b), 8192):
            near = np.bitwise_count(ua[r : r + 256, None] ^ ub[None, c : c + 8192]) <= radius
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            # Of the links of a block enough to join what it joins: each row and its first column
            # and each column and its first row.
            near, va, vb = near[np.ix_(rows, cols)], a[rows + r], b[cols + c]
            first = np.minimum(va, np.where(near, vb[None, :], top).min(axis=1))
            least = np.minimum(vb, np.where(near, first[:, None], top).min(axis=0))
            back = np.where(near, least[None, :], top).min(axis=1)
            while (back < first).any():
                first = np.minimum(first, back)
                least = np.minimum(least, np.where(near, first[:, None], top).min(axis=0))
                back = np.where(near, least[None, :], top).min(axis=1)
            found.append((np.concatenate([va, vb]), np.concatenate([first, least])))
            size += len(va) + len(vb)
            if size > 1_000_000:
                found = [joined(*map(np.concatenate, zip(*found, strict=True)))]
                size = len(found[0][0])
    return joined(*map(np.concatenate, zip(*found, strict=True))) if found else (a[:0], a[:0])


def links(distinct: DataFrame, radius: int = 4, tile: int = 262_144) -> DataFrame:
    """(a, b): links that join all fingerprints within the radius; distinct has a long fp, each once."""
    spark = distinct.sparkSession
    common.small_batches(spark)
    halves = [F.bit_count(F.shiftrightunsigned("fp", 32)).cast("long"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")]
    keyed = distinct.select("fp", (F.shiftleft(halves[0], 8) + halves[1]).alias("key"))
    # At most 33 ** 2 keys, whatever the input: small enough to broadcast.
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = common.materialise(
        keyed.join(F.broadcast(parts), "key")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        .groupBy("key", "part", "parts")
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    shifts = F.explode(F.array(*[F.lit(x).cast("long") for x in _shifts(radius)]))
    met = (
        tiles.select("key", "part", shifts.alias("shift"))
        .withColumn("other", F.col("key") + F.col("shift"))
        .join(F.broadcast(parts.select(F.col("key").alias("other"), F.col("parts").alias("others"))), "other")
        .withColumn("other_part", F.explode(F.sequence(F.when(F.col("key") == F.col("other"), F.col("part")).otherwise(F.lit(0)), F.col("others") - 1)))
        .select("key", "part", "other", "other_part")
    )
    # Few rows of much work each: dealt over a number of tasks that does not follow their bytes.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    there = tiles.select(F.col("key").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("other_fps"))
    pairs = met.join(tiles.drop("parts"), ["key", "part"]).repartition(n, "other", "other_part").join(there.repartition(n, "other", "other_part"), ["other", "other_part"]).select("fps", "other_fps")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            av, bv = a.values.to_numpy(), b.values.to_numpy()
            ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
            for i in range(batch.num_rows):
                got = links_between(av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]], radius)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fp and component_id (the smallest doc_id of its component) for each distinct fp of (doc_id, fp)."""
    first = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    star = stars(links(first.select("fp"), radius))
    linked = star.unionByName(star.select(F.col("b").alias("a"), "b").distinct())
    ids = linked.join(first.withColumnRenamed("fp", "a"), "a")
    found = ids.groupBy("b").agg(F.min("first").alias("least")).join(linked, "b").select(F.col("a").alias("fp"), "least")
    # Written out, so that what is joined to it by fp has two plain sides and a hot one is split.
    return common.materialise(first.join(found, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "component-ids")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs plus fingerprint (16 hex digits) and component_id; shuffles the texts once."""
    kept = [c for c in docs.columns if c.lower() not in {"fingerprint", "component_id", "fp"}]
    own = with_fingerprint(docs.select(*[F.col(f"`{c}`") for c in kept]), shingle)
    found = components(common.materialise(own.select("doc_id", "fp"), "simhash"), radius)
    return own.join(found, "fp").select(
        *[F.col(f"`{c}`") for c in kept], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Rows that repeat an
    id and a text are one row; rows without an id stay once for each fingerprint if no
    linked row has one."""
    kept = assigned(docs, radius, shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = kept.select(F.col("doc_id").alias("_id"), F.conv("fingerprint", 16, -10).cast("long").alias("_fp")).distinct()
    own = with_fingerprint(docs.withColumnRenamed("fp", "_own_fp") if "fp" in docs.columns else docs, shingle)
    out = own.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")
    out = out.dropDuplicates(["doc_id", "fp"]).drop("fp")
    return out.select(*[F.col(f"`{'_own_fp' if c == 'fp' else c}`").alias(c) for c in docs.columns])


def assigned(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id alone: near_duplicates() without the texts."""
    fps = common.materialise(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "simhash")
    return fps.join(components(fps, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(text: str | None, shingle: int = 5):
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], dtype=np.uint64))


def wide_of(hashes) -> list[int]:
    """A SimHash of WIDE signed longs over a set of hashes; the bits of each long come from another mix."""
    import numpy as np

    out = []
    for k in range(WIDE):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), BLOCK):
            h = hashes[at : at + BLOCK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0]))
    return out


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, th, k (a digest of the set of shingles), n (its size) and w0, w1, ... (its wide SimHash)."""
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "th", "k", "n", *[f"w{i}" for i in range(WIDE)]]

    def sketch(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                hashes = shingles_of(text, shingle)
                rows.append([xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63, len(hashes), *wide_of(hashes)])
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * (WIDE + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(sketch, ", ".join(f"{c} long" for c in names))


def wide_links(a, b, least: float):
    """(member, smallest member it reaches) for two tuples of arrays k, n, w0, ...; pairs whose sizes rule out ``least`` are none."""
    import numpy as np

    (ka, na, *wa), (kb, nb, *wb) = a, b
    wa, wb = [w.view(np.uint64) for w in wa], [w.view(np.uint64) for w in wb]
    out = [np.zeros((0, 2), np.int64)]
    for r in range(0, len(ka), 256):
        for c in range(0, len(kb), 4096):
            i, j = np.nonzero(np.bitwise_count(wa[0][r : r + 256, None] ^ wb[0][None, c : c + 4096]) <= NEAR)
            i, j = i + r, j + c
            fits = (np.minimum(na[i], nb[j]) >= least * np.maximum(na[i], nb[j])) & (ka[i] != kb[j])
            i, j = i[fits], j[fits]
            bits = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(wa, wb, strict=True))
            i, j = i[bits <= NEAR_WIDE], j[bits <= NEAR_WIDE]
            if not len(i):
                continue
            out.append(np.stack(joined(ka[i], kb[j]), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def candidates(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b): links that join the sets (k, n, w0, ...) whose sizes and wide SimHashes allow ``least``.

    Sets stand in tiles by size, of at most about TILE, and a pair of tiles whose sizes rule
    ``least`` out is not compared. Sets of under four have no neighbour but themselves."""
    spark = sets.sparkSession
    common.small_batches(spark)
    own = sets.filter(F.col("n") * (1 - least) >= least - 1e-9)
    count = own.count()
    tiles = max(1, -(-count // TILE), min(FEW_TILES, -(-count // 8192)))
    ranged = own.repartitionByRange(tiles, "n", "k").withColumn("tile", F.spark_partition_id())
    row = F.struct("k", "n", *[f"w{i}" for i in range(WIDE)])
    made = common.materialise(ranged.groupBy("tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_list(row).alias("rows")), "wide-tiles")
    # The bounds of the tiles, not what is in them: a row for each TILE sets. Tiles follow each
    # other by size, so the partners of a tile are those up to the last that begins near enough.
    bounds = sorted(made.select("tile", "lo", "hi").collect())
    upto = [(t, max(u for u, lo, _ in bounds[k:] if hi >= least * lo)) for k, (t, _, hi) in enumerate(bounds)]
    met = spark.createDataFrame(upto, "tile int, last int").withColumn("other_tile", F.explode(F.sequence("tile", "last"))).drop("last")
    n = min(len(bounds) * (len(bounds) + 1) // 2 or 1, max(200, 8 * tiles))
    there = made.select(F.col("tile").alias("other_tile"), F.col("rows").alias("other_rows"))
    pairs = met.join(made.select("tile", "rows"), "tile").join(there, "other_tile").repartition(n, "tile", "other_tile").select("rows", "other_rows")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                sides = [[f.to_numpy() for f in batch.column(c)[i].values.flatten()] for c in (0, 1)]
                got = wide_links(*sides, least)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def joined_sets(sets: list, least: float) -> list[int]:
    """For each set of sorted hashes the number of the first one of its component, sets being linked
    where their Jaccard similarity is ``least`` or more. A set is held against the members of each
    component until one is near; no pair that matters is left out."""
    import numpy as np

    def near(x, y):
        if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - 1e-9

    groups: list[list[int]] = []
    for i, s in enumerate(sets):
        met, rest = [i], []
        for g in groups:
            if any(near(s, sets[j]) for j in g):
                met = g + met
            else:
                rest.append(g)
        groups = [*rest, met]
    out = [0] * len(sets)
    for g in groups:
        for i in g:
            out[i] = min(g)
    return out


def chunked(members: DataFrame, held: int = HELD) -> DataFrame:
    """members plus chunks, the number of chunks that the component comp is dealt into: one up to
    ``held`` sets, else so many that two chunks have about ``held``."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"))
    sizes = sizes.select("comp", F.when(F.col("n") <= held, 1).otherwise(F.ceil(F.col("n") / (held / 2))).cast("int").alias("chunks"))
    return members.join(common.materialise(sizes, "chunk-numbers"), "comp")


def confirmed(texts: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(k, root) for (k, comp, chunks, text): the components of comp that hold by exact Jaccard similarity.

    A component of one chunk is settled in one task. Of a larger one every pair of chunks meets
    in a task of its own, and what the tasks link is joined, so no task holds a large component."""
    common.small_batches(texts.sparkSession)
    chunk = F.pmod(F.xxhash64("k"), F.col("chunks").cast("long")).cast("int")
    with_all = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, chunk).alias("c"), F.greatest(j, chunk).alias("d"))))
    dealt = texts.select("k", "comp", "text", with_all.alias("to")).select("k", "comp", "to.c", "to.d", "text")

    def confirm(batches):
        import pyarrow as pa

        def settle(keys, sets):
            roots = joined_sets(sets, least)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[r] for r in roots], pa.int64())], ["k", "root"])

        now, keys, sets = None, [], []
        for batch in batches:
            for k, comp, c, d, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (comp, c, d) != now and keys:
                    yield settle(keys, sets)
                    keys, sets = [], []
                now = (comp, c, d)
                keys.append(k)
                sets.append(shingles_of(text, shingle))
        if keys:
            yield settle(keys, sets)

    found = dealt.repartition("comp", "c", "d").sortWithinPartitions("comp", "c", "d", "k").mapInArrow(confirm, "k long, root long")
    found = common.materialise(found, "confirmed")
    star = stars(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    return found.select("k").distinct().join(star.withColumnRenamed("a", "k"), "k", "left").select("k", F.coalesce("b", "k").alias("root"))


def unlike_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each component of texts whose sets of word shingles have a Jaccard
    similarity of ``least`` or more: that of the smallest doc_id, a null id last.

    Texts of equal sets are folded into one. Wide SimHashes find the candidates, their components
    bring the texts of candidates together, and exact similarity decides inside."""
    place = {"_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_th": F.xxhash64("text")}
    own = common.materialise(sketches(docs, shingle), "sketches")
    words = [f"w{i}" for i in range(WIDE)]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    sets = common.materialise(own.groupBy("k", "n", *words).agg(one.alias("one")), "sets")
    star = stars(candidates(sets.select("k", "n", *words), least))
    members = star.select(F.col("a").alias("k"), F.col("b").alias("comp")).unionByName(star.select(F.col("b").alias("k"), F.col("b").alias("comp")).distinct())
    wanted = chunked(members.join(sets, "k")).select("k", "comp", "chunks", F.coalesce("one.doc_id", F.lit(-(2**63))).alias("_i"), F.col("one.th").alias("_th"))
    wanted = common.materialise(wanted, "candidates")
    texts = docs.select("doc_id", "text").withColumns(place).join(wanted, ["_i", "_th"]).dropDuplicates(["_i", "_th", "k"])
    roots = common.materialise(confirmed(texts, least, shingle), "roots")
    left = sets.join(roots, "k", "left").groupBy(F.coalesce("root", "k").alias("g")).agg(F.min("one").alias("one"))
    left = common.materialise(left.select(F.coalesce("one.doc_id", F.lit(-(2**63))).alias("_i"), F.col("one.th").alias("_th")), "unlike")
    return docs.withColumns(place).join(left, ["_i", "_th"], "left_semi").dropDuplicates(["_i", "_th"]).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return assigned(common.table(spark, sf_dir, "documents"))
