"""Choices that depend on earlier ones, against plain loops over random rows."""

import random

from pyspark.sql import functions as F

from sievework.operators import selection, state


def greedy(cards, per_domain, per_group, total):
    out, nd, ng = [], {}, {}
    for score, pos, d, g in sorted(cards, key=lambda c: (-c[0], c[1])):
        if len(out) < total and nd.get(d, 0) < per_domain and ng.get(g, 0) < per_group:
            nd[d], ng[g] = nd.get(d, 0) + 1, ng.get(g, 0) + 1
            out.append(pos)
    return out


def test_diverse_is_the_greedy_choice(spark):
    """Also where few domains and groups make most cards skipped, so that the bounds are reached."""
    rnd, rows = random.Random(3), []
    for q in range(60):
        n, nd, ng = rnd.choice([5, 50, 400]), rnd.choice([1, 3, 40]), rnd.choice([1, 4, 60])
        rows += [(q, i, f"d{int(nd * rnd.random() ** 3)}", f"g{int(ng * rnd.random() ** 3)}", float(rnd.randint(0, 30))) for i in range(n)]
    df = spark.createDataFrame(rows, 'query_id long, pos long, domain string, `group` string, score double')
    for caps in ((2, 2, 8), (1, 3, 7)):
        got: dict = {}
        for r in selection.diverse(df, *caps).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.pos)
        for q in range(60):
            assert got[q] == greedy([(s, p, d, g) for k, p, d, g, s in rows if k == q], *caps), (q, caps)


def test_diverse_takes_nulls_as_one(spark):
    df = spark.createDataFrame([(1, i, None, None, 1.0) for i in range(9)], 'query_id long, pos long, domain string, `group` string, score double')
    assert [r.pos for r in selection.diverse(df).orderBy("place").collect()] == [0, 1]
    assert selection.diverse(df.filter(F.lit(False))).collect() == []


def test_unlike_keeps_what_is_over_the_bound(spark):
    rows = [(1, i, "same words said over and over again here") for i in range(6)] + [(2, 0, None), (2, 1, ""), (2, 2, "one two")]
    df = spark.createDataFrame(rows, "query_id long, pos long, text string")
    got = {(r.query_id, r.pos): r.kept for r in selection.unlike(df, most=4).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (1, 3): False, (1, 4): True, (1, 5): True, (2, 0): True, (2, 1): True, (2, 2): True}


def test_clipped_marks_the_first_over_the_budget_only(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, None), (1, 2, "bbbb"), (1, 3, "cccc"), (2, 0, "x" * 9)], "query_id long, pos long, text string")
    got = {(r.query_id, r.pos): (r.text, r.clipped) for r in selection.clipped(df, 9, 6).collect()}
    assert got == {(1, 0): ("aaaa", False), (1, 1): (None, False), (1, 2): ("b…", True), (1, 3): ("cccc", False), (2, 0): ("xxxxx…", True)}


def test_cooldowns_walk_each_provider(spark):
    rnd, rows = random.Random(5), []
    for i in range(3000):
        rows.append((i % 7 % 3, i, i * 4, rnd.random() < 0.8, rnd.choice(["timeout", "blocked", "x"])))
    df = spark.createDataFrame(rows, "provider long, call_id long, s long, failed boolean, class string").withColumn("ts", F.timestamp_seconds("s"))
    want, state_ = set(), {}
    for p, i, s, failed, c in rows:
        streak, until = state_.get(p, (0, -1))
        streak = streak + 1 if failed else 0
        if streak >= 3 and s >= until:
            until = s + {"timeout": 15, "blocked": 60}.get(c, 30)
            want.add((str(p), i, until))
        state_[p] = (streak, until)
    got = {(r.provider, r.call_id, r.u) for r in state.cooldowns(df).select("provider", "call_id", F.unix_seconds("until").alias("u")).collect()}
    assert got == want and len(got) > 20
