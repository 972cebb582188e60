"""What depends on time or place: streaks, cooldowns, cached answers, snapshots, enclosing symbols,
conflicts between sources, and ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 3
# Seconds of rest after repeated failures, by class of the last one.
REST = {"rate_limited": 60, "blocked": 60, "timeout": 15}
OTHER_REST = 30


def streaks(calls: DataFrame, slice: str = "hour") -> DataFrame:
    """calls (provider, call_id, ts, failed, ...) with streak: failures in a row up to this call.

    Calls are counted within slices of time, so that a busy provider is spread over tasks; what a
    slice begins with is the failures that the slices before it end with, from a table of slices."""
    sliced = calls.withColumn("slice", F.date_trunc(slice, "ts"))
    w = Window.partitionBy("provider", "slice").orderBy("ts", "call_id")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    island = sliced.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(upto(w)))
    own = Window.partitionBy("provider", "slice", "island").orderBy("ts", "call_id")
    local = island.withColumn("own", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(upto(own)))
    ends = local.groupBy("provider", "slice").agg((F.max("island") > 0).cast("int").alias("reset"), F.max_by("own", F.struct("ts", "call_id")).alias("trail"))
    by_time = Window.partitionBy("provider").orderBy("slice")
    grouped = ends.withColumn("group", F.sum("reset").over(upto(by_time)))
    total = F.sum("trail").over(upto(Window.partitionBy("provider", "group").orderBy("slice")))
    carried = grouped.withColumn("total", total).withColumn("carried", F.coalesce(F.lag("total").over(by_time), F.lit(0))).select("provider", "slice", "carried")
    met = local.join(carried, ["provider", "slice"])
    return met.select(*[F.col(f"`{c}`") for c in calls.columns], (F.col("own") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)).alias("streak"))


def cooldowns(calls: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """provider, call_id, start, until: the rests that failures set off. A failure that ends a streak
    of ``threshold`` or more does, unless the provider rests already.

    Each rest depends on the one before, so a provider's candidates (only failures at or past the
    threshold) are walked in order; batches stream through with one timestamp of state, and no
    provider is gathered. calls: provider, call_id, ts, failed, class."""
    rest = F.lit(OTHER_REST)
    for name, seconds in REST.items():
        rest = F.when(F.col("class") == name, seconds).otherwise(rest)
    cand = streaks(calls).filter(F.col("failed") & (F.col("streak") >= threshold))
    cand = cand.select(F.col("provider").cast("string").alias("provider"), F.col("call_id").cast("long").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), rest.cast("long").alias("rest"))

    def walk(batches):
        last, until = None, None
        for b in batches:
            keep, ends = [], []
            for p, s, r in zip(b["provider"].tolist(), b["start"].tolist(), b["rest"].tolist()):
                if p != last:
                    last, until = p, None
                free = until is None or s >= until
                if free:
                    until = s + r * 1_000_000
                keep.append(free)
                ends.append(until)
            out = b[["provider", "call_id", "start"]].copy()
            out["until"] = ends
            yield out[keep]

    rows = cand.repartition("provider").sortWithinPartitions("provider", "start", "call_id")
    found = rows.mapInPandas(walk, "provider string, call_id long, start long, until long")
    return found.select("provider", "call_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("until").alias("until"))


def circuits(calls: DataFrame, threshold: int = 5, rest_ms: int = 30_000, base_ms: int = 250, most_ms: int = 10_000) -> DataFrame:
    """calls (origin, call_id, ts, outcome) with failures, longest_delay_ms and open_until: what the
    breaker of an origin makes of each call. Retryable and rate-limited failures in a row are
    counted; a success or another failure starts anew; from ``threshold`` on the circuit opens, for
    two minutes at most. The delay is drawn at random up to longest_delay_ms, so only that is given."""
    again = F.col("outcome").isin("retryable", "rate_limited")
    own = streaks(calls.withColumnRenamed("origin", "provider").withColumn("failed", again)).withColumnRenamed("provider", "origin")
    n = F.col("streak")
    until = F.when(again & (n >= threshold), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + min(rest_ms, 120_000) * 1000))
    longest = F.when(again, F.least(F.call_function("shiftleft", F.lit(base_ms), F.least(n, F.lit(6)).cast("int")), F.lit(most_ms)))
    return own.select(*[F.col(f"`{c}`") for c in calls.columns], n.alias("failures"), longest.cast("long").alias("longest_delay_ms"), until.alias("open_until"))


def cached(requests: DataFrame, stored: DataFrame, ttl: int = 300) -> DataFrame:
    """requests with stored_id: the last complete answer of its key stored at or before it and no
    older than ttl seconds; else null. An as-of join by one sort of both sides' union: no request
    meets the answers of its key one by one.

    requests: request_id, key, ts; stored: stored_id, key, ts, complete."""
    both = requests.select("key", "ts", F.lit(1).alias("side"), "request_id", F.lit(None).cast("long").alias("stored_id")).unionByName(
        stored.filter("complete").select("key", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("request_id"), F.col("stored_id").cast("long").alias("stored_id"))
    )
    w = Window.partitionBy("key").orderBy("ts", "side", "stored_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("ts", "stored_id")), ignorenulls=True).over(w)
    young = F.col("ts") <= F.col("last.ts") + F.expr(f"interval {int(ttl)} seconds")
    return both.withColumn("last", last).filter("side = 1").select("request_id", "key", "ts", F.when(young, F.col("last.stored_id")).alias("stored_id"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of two snapshots (path, size, mtime): added, removed, changed or same."""
    b, a = before.select("path", F.struct("size", "mtime").alias("b")), after.select("path", F.struct("size", "mtime").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return b.join(a, "path", "full").select("path", change.alias("change"))


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """places (file, line, place_id) with symbol: the innermost that has the line (the shortest, then
    the one that starts last, then the smallest symbol_id), or null.

    A symbol is laid onto the blocks of 1, 2, 4, ... lines that make it up, two of a size at most, and of
    each block only its innermost symbol is kept. A line lies in one block of each size, so it meets as many
    rows as there are sizes, however many symbols have it. symbols: symbol_id, file, first, last."""
    whole = symbols.filter("first <= last").select("symbol_id", "file", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    top = whole.agg((F.length(F.bin(F.max(F.col("last") - F.col("first")) + 1)) - 1).alias("top"))

    def blocks(k):
        low, high = -F.call_function("shiftright", -F.col("first"), k), F.call_function("shiftright", F.col("last") + 1, k)
        odd = lambda n: n.bitwiseAND(F.lit(1)) == 1
        at = lambda c, block: F.when((low < high) & c, F.struct(k.alias("size"), block.alias("block")))
        return F.array(at(odd(low), low), at(odd(high), high - 1))

    sizes = F.sequence(F.lit(0), F.length(F.bin(F.col("last") - F.col("first") + 1)) - 1)
    laid = whole.select("*", F.explode(F.array_compact(F.flatten(F.transform(sizes, lambda k: blocks(k))))).alias("b"))
    rank = F.struct((F.col("last") - F.col("first")).alias("length"), (-F.col("first")).alias("start"), "symbol_id").alias("rank")
    inner = laid.select("file", "b.size", "b.block", rank).groupBy("file", "size", "block").agg(F.min("rank").alias("rank"))
    lines = places.select("file", "line").filter("line is not null").distinct().crossJoin(F.broadcast(top))
    asked = lines.select("file", "line", F.explode(F.sequence(F.lit(0), "top")).alias("size")).withColumn("block", F.call_function("shiftright", F.col("line").cast("long"), F.col("size")))
    best = asked.join(inner, ["file", "size", "block"]).groupBy("file", "line").agg(F.min("rank")["symbol_id"].alias("symbol"))
    return places.join(best, ["file", "line"], "left").select("place_id", "file", "line", "symbol")


def disagreements(values: DataFrame) -> DataFrame:
    """Sources of an entity that give different sets of values: a row for each set, of entities with
    two sets or more.

    values: entity, source, value. Pairs of sources are not written out: entity, values, the first
    source with that set, how many have it, and how many sources it disagrees with, which holds every
    pair. Equal sets of one entity meet in a map-side aggregate."""
    sets = values.filter("value is not null").groupBy("entity", "source").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("said"))
    classes = sets.groupBy("entity", "said").agg(F.min("source").alias("first_source"), F.count("*").alias("n_sources"))
    entity = classes.groupBy("entity").agg(F.count("*").alias("n_sets"), F.sum("n_sources").alias("n_all")).filter("n_sets > 1")
    return classes.join(entity, "entity").select("entity", F.col("said").alias("values"), "first_source", "n_sources", (F.col("n_all") - F.col("n_sources")).alias("n_against"))


def _glob(rule: str) -> tuple[str, bool]:
    """(regular expression over a path, whether it takes the path back in) of one ignore rule."""
    negated = rule.startswith("!")
    body = rule[1:] if negated else rule
    folder, body = body.endswith("/"), body.rstrip("/")
    rooted, body = "/" in body, body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def is_ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules leave a path out; see ``ignored``."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            pattern, negated = _glob(rule)
            out = F.when(path.rlike(pattern), not negated).otherwise(out)
    return out


def ignored(files: DataFrame, rules: list[str]) -> DataFrame:
    """files (path, ...) with ignored: whether the last rule that fits a path, or a folder above it,
    leaves it out. Rules are those of ignore files: * and ? within a segment, ** across, a slash at
    the end for folders only, one elsewhere ties the rule to the top, ! takes back in. Blank rules
    and comments count for nothing. The rules become one expression, so files are scanned once."""
    return files.withColumn("ignored", is_ignored(F.col("path"), rules))
