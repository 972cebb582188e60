"""Centroid clustering with Yinyang bounds: against SQL, plain clustering and the odd cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from sievework.llm import yinyang

from oracle import same

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, Distance long"


def plain(rows, k, rounds, dims):
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in held if i is not None)[:k]
    c = [v for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    if not c:
        return Counter()
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in held]
        for j in set(own):
            mine = [v for (_, v), o in zip(held, own, strict=True) if o == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    final = [nearest(v) for _, v in held] if c else []
    sums = Counter()
    for d, j in final:
        sums[j] += d
    fit = lambda v: v if v < 2**63 else None
    every = None if any(d >= 2**63 for d, _ in final) else fit(sum(sums.values()))
    bad = {j for d, j in final if d >= 2**63}
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return Counter((i, j, fit(d), None if j in bad else fit(sums[j]), every, digest[j]) for (i, _), (d, j) in zip(held, final, strict=True))


def check(spark, rows, k=6, rounds=4, dims=5):
    df = spark.createDataFrame([(*r, "old", -1) for r in rows], SCHEMA).repartition(3)
    got = yinyang.cluster(df, k=k, rounds=rounds, dims=dims, groups=3)
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == plain(rows, k, rounds, dims)
    return got


def test_against_sql(spark):
    same(spark, SF, yinyang.query, yinyang.SQL)


def test_against_plain_clustering(spark):
    rnd = random.Random(13)
    rows = [(k, [rnd.gauss(k % 4, 0.3) for _ in range(5)]) for k in range(150)]
    rows += [(500 + k, [float(k % 3)] * 5) for k in range(30)]  # ties
    rows += [(3, rows[3][1])] * 40 + [(600, None), (601, [1.0]), (602, [1.0, None, 1.0, 1.0, 1.0]), (603, [float("nan")] * 5), (604, [float("inf")] * 5), (None, [0.5] * 5)]
    got = check(spark, rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sizes_beyond_floats_and_longs(spark):
    rnd = random.Random(14)
    check(spark, [(k, [rnd.uniform(-1, 1) * 2**22 for _ in range(5)]) for k in range(60)])
    check(spark, [(k, [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 25]) for _ in range(5)]) for k in range(60)], rounds=2)


def test_few_rows_and_none(spark):
    check(spark, [(1, [0.0] * 5), (2, [1.0] * 5), (2, [1.0] * 5)], k=6)
    check(spark, [(None, [0.0] * 5)], k=2)
    check(spark, [(1, [0.0])], k=2)
    assert yinyang.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_skip_most_distances():
    rnd = np.random.default_rng(15)
    heads = rnd.integers(-800, 800, (40, 64)).astype(float)
    x = np.floor(heads[rnd.integers(0, 40, 3000)] + rnd.normal(0, 60, (3000, 64)))
    parts = yinyang.grouped(heads, 4)
    a, ub, lb, looked = yinyang.assigned(x, heads, parts, np.zeros(3000, dtype=int), np.full(3000, np.inf), np.full((3000, len(parts)), -np.inf), np.zeros(40))
    assert looked >= 3000 * 40 and (a == yinyang.squared(x, heads).argmin(axis=1)).all()
    for _ in range(4):
        new = np.floor(heads + rnd.normal(0, 3, heads.shape))
        moved, heads = np.sqrt(((new - heads) ** 2).sum(axis=1)), new
        a, ub, lb, looked = yinyang.assigned(x, heads, parts, a, ub, lb, moved)
        assert (a == yinyang.squared(x, heads).argmin(axis=1)).all() and looked < 3000 * 40 / 4
