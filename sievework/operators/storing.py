"""Stored responses: how long they are fresh, whether they may be stored, and what new responses make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import local

# Zones and months of dates in headers, headers that a stored response may vary by, types that are not stored.
ZONES = {"UT": "+00:00", "GMT": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
ZONES |= {c: f"{'+' if n > 0 else '-'}{abs(n):02d}:00" for c, n in zip("ABCDEFGHIKLMNOPQRSTUVWXY", [*range(1, 13), *range(-1, -13, -1)], strict=True)}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MAY_VARY = ["accept-encoding", "accept", ""]
NOT_STORED = r"^(image/|audio/|video/|application/octet-stream$)"
#: Fields of freshness, and which header stands for each.
FRESHNESS = "struct<max_age: bigint, expires: timestamp, no_store: boolean, no_cache: boolean, private: boolean, vary: string, etag: string, last_modified: string>"


def header_date(raw: Column) -> Column:
    """The time of a date in a header (like 'Tue, 02 Jan 2024 03:04:05 GMT') or of RFC 3339; null for anything else."""
    shape = r"^\s*(?:[A-Za-z]{3}\s*,\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2})(:\d{2})?\s+([+-]\d{4}|[A-Z]{1,3})\s*$"
    part = lambda k: F.regexp_extract(raw, shape, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
    zone = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), part(6)), F.regexp_replace(part(6), r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    second = F.coalesce(F.nullif(part(5), F.lit("")), F.lit(":00"))
    text = F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), second, zone)
    return F.coalesce(F.when(raw.rlike(shape) & (month > 0), local.timestamp(text)), local.timestamp(raw))


def freshness(headers: Column) -> Column:
    """What headers (a map with names in lower case) say of a response: max_age in seconds (that for shared
    stores, if it has one), expires where there is no max_age, no_store, no_cache, private, vary and the
    validators. The last of a repeated directive counts; an age that is no number counts as none."""
    get = lambda name: F.try_element_at(headers, F.lit(name))
    each = F.transform(F.split(F.coalesce(get("cache-control"), F.lit("")), ","), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, "=", 1))).alias("name"), F.when(F.contains(d, F.lit("=")), F.regexp_replace(d, "^[^=]*=", "")).otherwise("").alias("value")))
    named = lambda name: F.filter(each, lambda d: d["name"] == name)
    age = lambda name: F.regexp_replace(F.trim(F.try_element_at(named(name), F.lit(-1))["value"]), r'^"+|"+$', "")
    seconds = lambda name: F.when(age(name).rlike(r"^\+?\d+$"), age(name).try_cast("bigint"))
    max_age = F.coalesce(seconds("s-maxage"), seconds("max-age"))
    has = lambda name: F.size(named(name)) > 0
    return F.struct(
        max_age.alias("max_age"), F.when(max_age.isNull(), header_date(get("expires"))).alias("expires"), has("no-store").alias("no_store"), has("no-cache").alias("no_cache"), has("private").alias("private"),
        get("vary").alias("vary"), get("etag").alias("etag"), get("last-modified").alias("last_modified"),
    )


def is_fresh(fresh: Column, fetched_at: Column, now: Column) -> Column:
    """Whether a stored response may answer now without asking again; one without any time limit may not."""
    aged = F.unix_micros(now) - F.unix_micros(fetched_at)
    by_age = F.when(fresh["max_age"].isNotNull(), (aged >= 0) & (aged.cast("double") < fresh["max_age"].cast("double") * 1e6))
    return F.coalesce(~fresh["no_store"] & ~fresh["no_cache"] & F.coalesce(by_age, now < fresh["expires"]), F.lit(False))


def storable(status: Column, content_type: Column, fresh: Column, anonymous: bool = True) -> Column:
    """Whether a response may be stored: a success without no-store, not private (in a store that all
    share), varying by nothing but what the store asks for, and no picture, sound, film or bare bytes."""
    varies = F.exists(F.split(F.lower(F.coalesce(fresh["vary"], F.lit(""))), ","), lambda h: ~F.trim(h).isin(MAY_VARY))
    base = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    refused = fresh["no_store"] | varies | base.rlike(NOT_STORED)
    return F.coalesce(status.between(200, 299) & ~(refused | fresh["private"] if anonymous else refused), F.lit(False))


def conditions(fresh: Column) -> Column:
    """The header that asks whether a stored response still holds, as a map; empty without a validator."""
    return (
        F.when(fresh["etag"].isNotNull(), F.create_map(F.lit("If-None-Match"), fresh["etag"]))
        .when(fresh["last_modified"].isNotNull(), F.create_map(F.lit("If-Modified-Since"), fresh["last_modified"]))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def revalidated(stored: DataFrame, answers: DataFrame, anonymous: bool = True) -> DataFrame:
    """key, body_id, fetched_at, fresh, status (stored, replaced, revalidated, added): the store after the
    answers of later fetches.

    stored: key (unique), body_id, fetched_at, fresh (see freshness). answers: key, answer_id, ts, status,
    content_type, headers (map), body_id. A success that may be stored takes the place of what is there; after
    the last such one, 304s renew its time and set the fields that their headers name: all of cache-control
    together, an expiry that can be read, vary, and each validator. Other answers, those without a key, and a 304
    for what is not stored change nothing. Answers at one time count in order of answer_id; what is stored comes
    before answers of its time.

    Both sides are aggregates by key that start before the shuffle: the last full answer, and for each field the
    last 304 that names it. Where that one is older than the full answer, so are all others, and it is passed
    over; so a key with very many answers is one row when the sides meet. No bodies are moved, only their ids."""
    read = answers.filter("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts", "answer_id", "status", "headers", "body_id", freshness(F.col("headers")).alias("fresh"), "content_type")
    place = lambda new, ts, n: F.struct(ts.alias("ts"), F.lit(new).alias("new"), n.alias("n"))
    old = stored.select("key", place(0, F.col("fetched_at"), F.lit(None).cast("long")).alias("at"), F.struct("body_id", "fresh").alias("entry"))
    full = read.filter(storable(F.col("status"), F.col("content_type"), F.col("fresh"), anonymous))
    new = full.select("key", place(1, F.col("ts"), F.col("answer_id").cast("long")).alias("at"), F.struct("body_id", "fresh").alias("entry"))
    base = old.unionByName(new).groupBy("key").agg(F.max("at").alias("at"), F.max_by("entry", "at").alias("entry"), F.bool_or(F.col("at.new") == 0).alias("known"))
    own = place(1, F.col("ts"), F.col("answer_id").cast("long"))
    has = lambda name: F.try_element_at(F.col("headers"), F.lit(name)).isNotNull()
    last = lambda value, when: F.max(F.when(when, F.struct(own.alias("at"), value.alias("value"))))
    f = F.col("fresh")
    control = F.struct(f["max_age"].alias("max_age"), f["no_store"].alias("no_store"), f["no_cache"].alias("no_cache"), f["private"].alias("private"))
    named = {"control": (control, has("cache-control")), "expires": (f["expires"], f["expires"].isNotNull()), "vary": (f["vary"], has("vary")), "etag": (f["etag"], has("etag")), "last_modified": (f["last_modified"], has("last-modified"))}
    later = read.filter("status = 304").groupBy("key").agg(F.max(own).alias("renewed"), *[last(*v).alias(k) for k, v in named.items()])
    both = base.join(later, "key", "left").withColumns({k: F.when(F.col(f"{k}.at") > F.col("at"), F.col(f"{k}.value")) for k in named} | {"renewed": F.when(F.col("renewed") > F.col("at"), F.col("renewed.ts"))})
    e = F.col("entry.fresh")
    by_control = lambda k: F.when(F.col("control").isNotNull(), F.col("control")[k]).otherwise(e[k]).alias(k)
    either = lambda k: F.coalesce(F.col(k), e[k]).alias(k)
    fresh = F.struct(by_control("max_age"), either("expires"), by_control("no_store"), by_control("no_cache"), by_control("private"), either("vary"), either("etag"), either("last_modified"))
    status = F.when(F.col("renewed").isNotNull(), "revalidated").when(F.col("at.new") == 0, "stored").when(F.col("known"), "replaced").otherwise("added")
    return both.select("key", F.col("entry.body_id").alias("body_id"), F.coalesce("renewed", "at.ts").alias("fetched_at"), fresh.alias("fresh"), status.alias("status"))


def new_bodies(kept: DataFrame, answers: DataFrame, entries: DataFrame) -> DataFrame:
    """body_id, body: the bodies that must be written for entries (of revalidated), each once: those of
    answers that are not kept already, so unchanged ones are not written again.

    kept: body_id, ...; answers: body_id, body. Bodies of one id are equal; any of them is taken."""
    needed = entries.select("body_id").filter("body_id IS NOT NULL").distinct().join(kept.select("body_id"), "body_id", "left_anti")
    return answers.join(needed, "body_id", "left_semi").groupBy("body_id").agg(F.any_value("body").alias("body"))
