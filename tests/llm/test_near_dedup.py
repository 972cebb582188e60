"""The near-dedup stage against brute force over sets of five-word shingles."""

import random

import corpus_pipeline
from sievework.llm import simhash
from sievework.llm.components import stars


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The rows of the smallest id of each component of Jaccard 0.8, and the number of near pairs."""
    sets, group, near = [shingles(t) for _, t in rows], list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                near += 1
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted(least.values()), near


def test_near_copies_go(spark):
    """Copies with a changed sentence, at all similarities about 0.8, short texts and empty ones."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(0, ""), (1, None), (2, "one two three"), (3, "one two four"), (4, "one two three")]
    for k in range(60):
        base = [word() for _ in range(rnd.choice([12, 60, 200, 500]))]
        rows.append((10 + 10 * k, " ".join(base)))
        for c in range(1, 4):
            at, n = rnd.randrange(len(base)), max(1, int(len(base) * rnd.choice([0.02, 0.06, 0.1, 0.14])))
            rows.append((10 + 10 * k + c, " ".join([*base[:at], *[word() for _ in range(n)], *base[at + n :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, near = brute(rows)
    assert near > 50
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "d e"), (7, "d e")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, odd, "").collect()) == ["7", "None"]


def test_large_components_in_chunks(spark):
    """Components dealt into chunks, pair by pair of chunks, are what one task would find."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for k in range(90):
        at = rnd.randrange(len(base))
        rows.append((k, k % 2, " ".join([*base[:at], *[word() for _ in range(rnd.choice([1, 3, 9, 30]))], *base[at + 1 :]])))
    members = spark.createDataFrame(rows, "k long, comp long, text string")
    one = {r.k: r.root for r in simhash.confirmed(simhash.chunked(members, 1000)).collect()}
    many = simhash.chunked(members, 8)
    assert many.select("chunks").distinct().collect()[0].chunks > 10
    assert {r.k: r.root for r in simhash.confirmed(many).collect()} == one
    assert len(set(one.values())) > 4


def test_tiles_of_many_parts(spark):
    """Tiles cut into parts, and blocks within them, miss no link."""
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(30)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = stars(simhash.links(distinct, tile=3))
    root = {r.a: r.b for r in got.collect()}
    low = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    assert {f: root.get(f, f) for f in signed} == low
