"""Centroid clustering with Yinyang bounds.

Components become integers, floor(scale * x). The centroids are put into groups once. Each
vector keeps its centroid, an upper bound of the distance to it and one lower bound for each
group: no other centroid of the group is nearer than that. When centroids move the bounds
loosen by how far they moved. A vector whose lowest bound lies above its upper bound keeps its
centroid unseen (after a second look with the exact distance); else only groups whose bound does
not lie above are scanned, exactly. Bounds are compared with a margin wider than what floating
point can lose, so the result is that of a full scan, ties included (smaller number).

Cost: one pass a round, from a written table to the next, with no shuffle but the partial sums
of each task, at most ``k`` rows of each. Those sums stand in the same written table as the
vectors, in columns of their own, so a pass over the sums reads next to nothing. The table of
the round before is deleted. Centroids are collected (``k`` times ``dims`` integers).

Cases: vectors that are null, of another length, with a null or non-finite component (or one
that is not finite times ``scale``) are left out. A vector without id is clustered but never a
seed. Repeated rows stand each; if they are seeds, the later centroid stays empty. Fewer rows
with ids than ``k`` give fewer centroids; none, or an empty table, no rows. Components may be of
any size: beyond 2**20 exact integers of Python take the place of floats and every centroid is
scanned. A distance, or a sum of them, beyond a long is null. Other columns are not returned,
whatever their names, but for those in ``keep``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import common

common.by_value(__name__)

#: Largest component for which distances are exact in floats; the margin of comparisons of
#: bounds; bits of one of the numbers that a sum travels in; the largest distance returned.
EXACT, MARGIN, LIMB, TOP = 2**20, 1e-6, 40, 2**63 - 1

STATE = "_v array<double>, _c int, _u double, _l array<double>, _d long, _k int, _part int, _n long, _sums array<long>"


def grouped(centroids, groups: int, rounds: int = 5):
    """The group of each centroid: a few rounds of plain clustering of the centroids."""
    import numpy as np

    c = np.array(centroids, dtype=float)
    heads, of = c[:groups].copy(), np.zeros(len(c), dtype=int)
    for _ in range(rounds):
        of = ((c[:, None, :] - heads) ** 2).sum(-1).argmin(1)
        for g in set(of.tolist()):
            heads[g] = c[of == g].mean(0)
    return [np.flatnonzero(of == g) for g in sorted(set(of.tolist()))]


def squared(x, c):
    """Exact squared distances of rows of x to rows of c."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def own_distance(x, c, a):
    return ((x - c[a]) ** 2).sum(1)


def assigned(x, c, groups, a, ub, lb, moved):
    """One round: the nearest centroid of each row of x, with its bounds loosened by what the
    centroids moved and tightened where they were looked at. Also counts the distances taken."""
    import numpy as np

    big = x.dtype == object
    root = (lambda d: np.full(len(d), np.inf)) if big else (lambda d: np.sqrt(d))
    above = lambda u: u * (1 + MARGIN) + MARGIN
    a, ub = a.copy(), ub + moved[a]
    lb = np.full_like(lb, -np.inf) if big else lb - np.array([moved[m].max() for m in groups])
    rows = np.flatnonzero(lb.min(axis=1) <= above(ub))
    own = own_distance(x[rows], c, a[rows])
    looked = len(rows)
    ub[rows] = root(own)
    open_ = lb[rows].min(axis=1) <= above(ub[rows])
    rows, own = rows[open_], own[open_]
    if not len(rows):
        return a, ub, lb, looked
    was, best, who, bound, seen = a[rows], own.copy(), a[rows].copy(), above(ub[rows]), []
    for g, members in enumerate(groups):
        at = np.flatnonzero(lb[rows, g] <= bound)
        d = squared(x[rows[at]], c[members])
        looked += d.size
        first = d.argmin(axis=1) if len(at) else np.zeros(0, dtype=int)
        low, at_low = d[np.arange(len(at)), first], members[first]
        if len(members) > 1:
            rest = d.copy()
            rest[np.arange(len(at)), first] = rest.max() + 1 if len(at) else 0
            second = rest.min(axis=1)
        else:
            second = None
        better = (low < best[at]) | ((low == best[at]) & (at_low < who[at]))
        best[at[better]], who[at[better]] = low[better], at_low[better]
        seen.append((at, low, at_low, second))
    for g, (at, low, at_low, second) in enumerate(seen):
        mine = at_low == who[at]
        other = np.full(len(at), np.inf) if second is None else root(second)
        lb[rows[at], g] = np.where(mine, other, root(low))
        # A group not scanned now holds the old centroid as another one.
        left = np.isin(was, groups[g]) & (who != was)
        left[at] = False
        lb[rows[left], g] = np.minimum(lb[rows[left], g], root(own[left]))
    a[rows], ub[rows] = who, root(best)
    return a, ub, lb, looked


def limbs(sums):
    """Rows of integers of any size as rows of longs, lowest bits first; signs are kept."""
    out = []
    while True:
        out.append([(abs(s) & (1 << LIMB) - 1) * (-1 if s < 0 else 1) for s in sums])
        sums = [(abs(s) >> LIMB) * (-1 if s < 0 else 1) for s in sums]
        if not any(sums):
            return out


def _pass(held, scale: float, keep_fields):
    """The function that runs a round over the batches of a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c0, groups, moved, first, last = held.value
        dims, sums, counts = len(c0[0]), {}, {}
        moved = np.array(moved)
        wide = max((abs(v) for row in c0 for v in row), default=0) > EXACT
        floats = None if wide else np.array(c0, dtype=float)
        whole = np.array([[int(v) for v in row] for row in c0], dtype=object)
        names = [f.name for f in keep_fields]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, dims)
            if first:
                x = np.floor(x * scale)
                a, ub, lb = np.zeros(n, dtype=int), np.full(n, np.inf), np.full((n, len(groups)), -np.inf)
            else:
                a = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(int)
                ub = batch.column(len(names) + 2).to_numpy(zero_copy_only=False).astype(float)
                lb = batch.column(len(names) + 3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(groups))
            big = wide or np.abs(x).max() > EXACT
            y = np.frompyfunc(int, 1, 1)(x) if big else x
            c = whole if big else floats
            a, ub, lb, _ = assigned(y, c, groups, a, ub, lb, moved)
            near = [int(v) if v <= TOP else None for v in own_distance(y, c, a)] if last else [None] * n
            if not last:
                for j in np.unique(a).tolist():
                    part = y[a == j].sum(axis=0)
                    sums[j] = [p + int(q) for p, q in zip(sums.get(j, [0] * dims), part, strict=True)]
                    counts[j] = counts.get(j, 0) + int((a == j).sum())
            lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
            nulls = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            vectors = pa.nulls(n, pa.list_(pa.float64())) if last else lists(x)
            bounds = pa.nulls(n, pa.list_(pa.float64())) if last else lists(lb)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), vectors, pa.array(a, pa.int32()), pa.array(ub, pa.float64()), bounds, pa.array(near, pa.int64()), *nulls],
                names=[*names, "_v", "_c", "_u", "_l", "_d", "_k", "_part", "_n", "_sums"],
            )
        rows = [(j, p, counts[j] if p == 0 else 0, row) for j in sums for p, row in enumerate(limbs(sums[j]))]
        if rows:
            js, ps, ns, rs = zip(*rows, strict=True)
            n = len(rows)
            lead = [pa.nulls(n, f.type) for f in keep_fields]
            mid = [pa.nulls(n, t) for t in (pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*lead, *mid, pa.array(js, pa.int32()), pa.array(ps, pa.int32()), pa.array(ns, pa.int64()), pa.array(rs, pa.list_(pa.int64()))],
                names=[*names, "_v", "_c", "_u", "_l", "_d", "_k", "_part", "_n", "_sums"],
            )

    return run


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", groups: int | None = None, keep: tuple = ()
) -> DataFrame:
    """id, ``keep``, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each
    vector of ``dims`` finite components, after ``rounds`` rounds from the ``k`` vectors of smallest
    sha256 of ``seed:id``. ``groups``: of centroids, a tenth of ``k`` by default."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    spark = vectors.sparkSession
    common.small_batches(spark)
    names = [id_col, *keep]
    fine = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    rows = vectors.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{vec_col}`").cast("array<double>").alias("_x")).filter((F.size("_x") == dims) & ~fine)
    seeds = (
        rows.filter(F.col(f"`{id_col}`").isNotNull())
        .select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256).alias("_h"), "_x")
        .orderBy("_h", "_x")
        .limit(k)
        .collect()
    )
    out = T.StructType([*rows.select(*[F.col(f"`{c}`") for c in names]).schema.fields, *T._parse_datatype_string(STATE).fields])
    if not seeds:
        return _result(spark.createDataFrame([], out), names, [], spark)
    centroids = [[int(v) for v in np.floor(np.array(r["_x"]) * scale)] for r in seeds]
    parts = grouped(centroids, groups or max(1, len(centroids) // 10))
    import pyarrow as pa

    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in out.fields[: len(names)]]
    state, moved = rows, [0.0] * len(centroids)
    for r in range(rounds + 1):
        held = spark.sparkContext.broadcast((centroids, parts, moved, r == 0, r == rounds))
        before = state
        if r:
            before = state.filter("_k IS NULL").select(*[F.col(f"`{c}`") for c in names], "_v", "_c", "_u", "_l")
        new = common.materialise(before.mapInArrow(_pass(held, float(scale), fields), out), "yinyang")
        if r:
            common.discard(state)
        state = new
        if r < rounds:
            fresh = replaced(state, centroids, dims)
            moved = [float(np.sqrt(sum((float(p) - float(q)) ** 2 for p, q in zip(old, now, strict=True)))) for old, now in zip(centroids, fresh, strict=True)]
            centroids = fresh
    return _result(state, names, centroids, spark)


def replaced(state: DataFrame, centroids: list, dims: int) -> list:
    """The centroids as exact floor(sum / count) of their vectors; those without vectors stay."""
    sums = state.filter("_k IS NOT NULL").groupBy("_k", "_part").agg(F.sum("_n").alias("n"), *[F.sum(F.col("_sums")[i]).alias(f"s{i}") for i in range(dims)])
    total, count = {}, {}
    for r in sums.collect():
        count[r["_k"]] = count.get(r["_k"], 0) + r["n"]
        own = total.setdefault(r["_k"], [0] * dims)
        for i in range(dims):
            own[i] += r[f"s{i}"] << LIMB * r["_part"]
    return [[s // count[j] for s in total[j]] if count.get(j) else c for j, c in enumerate(centroids)]


def _result(state: DataFrame, names: list, centroids: list, spark) -> DataFrame:
    own = state.select(*[F.col(f"`{c}`") for c in names], F.col("_c").alias("cluster"), F.col("_d").alias("distance"))
    # A distance beyond a long makes its sums null, too.
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r for r in own.groupBy("cluster").agg(whole.alias("total")).collect()}
    inertia = None if any(r["total"] is None for r in sums.values()) else sum(int(r["total"]) for r in sums.values())
    fit = lambda v: int(v) if v is not None and v <= TOP else None
    table = [(j, fit(r["total"]), fit(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, r in sorted(sums.items())]
    # One row for each centroid.
    told = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(told), "cluster").select(*[F.col(f"`{c}`") for c in names], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _sql(k: int, rounds: int) -> str:
    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT rid, CAST(m % {k} AS INTEGER) AS k, m // {k} AS d FROM (
    SELECT rid, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS BIGINT) * {k} + k) AS m
    FROM v, c{r} GROUP BY rid))"""

    def means(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(new.y, c{r}.y) AS y FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS y FROM (
      SELECT k, i, CAST(sum(CAST(e AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS i FROM v JOIN a{r} USING (rid)) GROUP BY k, i) GROUP BY k) new
  ON c{r}.k = new.k)"""

    steps = ",\n".join(f"{nearest(r)},\n{means(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS y
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
{steps},
{nearest(rounds)},
told AS (SELECT k, sum(d) AS own FROM a{rounds} GROUP BY k)
SELECT vec_id, a.k AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(told.own AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(own) FROM told) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(y, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN told ON told.k = a.k JOIN c{rounds} c ON c.k = a.k
"""


SQL = _sql(40, 5)
