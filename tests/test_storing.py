"""Freshness of responses on small cases, and the store after random answers against a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sievework.operators import storing

UTC = dt.timezone.utc


def test_dates_of_headers(spark):
    cases = {
        "Tue, 02 Jan 2024 03:04:05 GMT": "2024-01-02 03:04:05", "2 jan 2024 03:04 EST": "2024-01-02 08:04:00", "02 Feb 2024 00:00:00 +0130": "2024-02-01 22:30:00", "Tue, 02 Jan 2024 03:04:05 B": "2024-01-02 01:04:05",
        "2024-01-02T00:00:00Z": "2024-01-02 00:00:00", "0": None, "": None, None: None, "Tue, 32 Jan 2024 03:04:05 GMT": None, "02 Foo 2024 03:04:05 GMT": None, "02 Jan 2024 03:04:05 XYZ": None,
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", F.date_format(storing.header_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss"))
    assert df.filter("NOT (got <=> want)").collect() == []


def test_freshness_and_storing(spark):
    day = dt.datetime(2024, 1, 2, tzinfo=UTC)
    cases = [
        ({"cache-control": "public, MAX-AGE=60"}, 200, "text/html", 59, True, True), ({"cache-control": "max-age=60"}, 200, None, 60, False, True), ({"cache-control": "max-age=1,s-maxage=\"90\""}, 204, "", 80, True, True),
        ({"cache-control": "no-cache, max-age=60"}, 200, "text/html", 1, False, True), ({"cache-control": "no-store, max-age=60"}, 200, "text/html", 1, False, False), ({"cache-control": "private, max-age=60"}, 200, "text/html", 1, True, False),
        ({"cache-control": "max-age=-1", "expires": "Tue, 02 Jan 2024 01:00:00 GMT"}, 200, "text/html", 3599, True, True), ({"expires": "Tue, 02 Jan 2024 01:00:00 GMT"}, 200, "text/html", 3600, False, True),
        ({"vary": "Accept, accept-ENCODING,"}, 200, "text/html", 0, False, True), ({"vary": "Cookie"}, 200, "text/html", 0, False, False), ({}, 404, "text/html", 0, False, False), ({}, 200, "Audio/ogg;x", 0, False, False), (None, 200, None, 0, False, True),
    ]
    df = spark.createDataFrame(cases, "headers map<string,string>, status int, type string, after int, fresh boolean, kept boolean")
    f = storing.freshness(F.col("headers"))
    got = df.select("fresh", "kept", storing.is_fresh(f, F.lit(day), F.timestamp_seconds(F.unix_seconds(F.lit(day)) + F.col("after"))).alias("f"), storing.storable(F.col("status"), F.col("type"), f).alias("k")).collect()
    assert [(r.f, r.k) for r in got] == [(r.fresh, r.kept) for r in got]
    asks = spark.createDataFrame([({"etag": "e", "last-modified": "l"},), ({"last-modified": "l"},), ({},)], "h map<string,string>").select(storing.conditions(storing.freshness(F.col("h"))).alias("c")).collect()
    assert [r.c for r in asks] == [{"If-None-Match": "e"}, {"If-Modified-Since": "l"}, {}]


def plain(stored, answers):
    held = {k: (b, t, "stored", dict(h)) for k, b, t, h in stored}
    known = set(held)
    for k, _, t, status, h, b in sorted((a for a in answers if a[0] is not None), key=lambda a: (a[2], a[1])):
        before = held.get(k)
        if before and t < before[1]:
            continue
        if status == 200:
            held[k] = (b, t, "replaced" if k in known else "added", dict(h))
        elif status == 304 and before:
            held[k] = (before[0], t, "revalidated", before[3] | h)
    return held


def test_store_after_random_answers(spark):
    rng = random.Random(5)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=s)
    some = lambda: {k: v for k, v in {"cache-control": f"max-age={rng.randrange(9)}", "etag": f"e{rng.randrange(99)}", "vary": "accept"}.items() if rng.random() < 0.5}
    stored = [(k, f"old{k}", rng.randrange(20), some()) for k in range(30)]
    answers = [(rng.choice([*range(40), None]), n, rng.randrange(40), rng.choice([200, 304, 304, 404]), some(), f"b{n % 7}") for n in range(300)] + [(7, 1000 + n, 50, 304, {"etag": f"x{n}"}, None) for n in range(500)]
    s = spark.createDataFrame([(k, b, at(t), h) for k, b, t, h in stored], "key long, body_id string, fetched_at timestamp, h map<string,string>").select("key", "body_id", "fetched_at", storing.freshness(F.col("h")).alias("fresh"))
    a = spark.createDataFrame([(k, n, at(t), st, "text/html", h, b) for k, n, t, st, h, b in answers], "key long, answer_id long, ts timestamp, status int, content_type string, headers map<string,string>, body_id string")
    entries = storing.revalidated(s, a)
    got = {r.key: (r.body_id, r.sec, r.status, r.fresh.max_age, r.fresh.etag, r.fresh.vary) for r in entries.withColumn("sec", F.unix_seconds("fetched_at") - F.unix_seconds(F.lit(at(0)))).collect()}
    age = lambda h: int(h["cache-control"][8:]) if "cache-control" in h else None
    assert got == {k: (b, t, st, age(h), h.get("etag"), h.get("vary")) for k, (b, t, st, h) in plain(stored, answers).items()}
    bodies = storing.new_bodies(s, a.withColumn("body", F.concat(F.lit("text of "), "body_id")), entries)
    assert sorted(r.body_id for r in bodies.collect()) == sorted({v[0] for v in got.values() if v[0].startswith("b")})
    assert storing.revalidated(s.limit(0), a.limit(0)).count() == 0
