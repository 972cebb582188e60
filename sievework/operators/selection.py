"""Choosing among ranked cards: groups, caps, budgets, excerpts, and cards that say the same.

All is keyed by query_id. Where a choice depends on the choices before it, the rows that can
matter are cut down to a proven bound by windows first, and the fold runs over that bound."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from sievework.functions import text, urls


def grouped(cards: DataFrame, kind: Column, order: list[str], per_group: int, max_groups: int | None = None, by: list[Column] | None = None) -> DataFrame:
    """Cards in groups of a kind the caller names, with group_no, place and truncated.

    Groups stand in the given order, then others by their first card (position pos); at most
    max_groups of them, and of each the first per_group cards by ``by`` (else pos)."""
    w = cards.withColumn("kind", kind)
    given = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")) if order else F.lit(0)
    groups = w.groupBy("query_id", "kind").agg(F.min("pos").alias("first"), F.count("*").alias("n_cards"))
    groups = groups.withColumn("group_no", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(given > 0, given).otherwise(F.lit(len(order) + 1)), "first")))
    if max_groups is not None:
        groups = groups.filter(F.col("group_no") <= max_groups)
    place = Window.partitionBy("query_id", "kind").orderBy(*(by or []), F.col("pos"))
    kept = w.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_group)
    return kept.join(groups.drop("first"), ["query_id", "kind"]).withColumn("truncated", F.col("n_cards") > per_group).drop("n_cards")


def diverse(cards: DataFrame, per_domain: int = 2, per_group: int = 2, total: int = 8) -> DataFrame:
    """The greedy choice down the order of score (then pos): no more than per_domain cards of a
    domain, per_group of a group and total in all; with place and gain.

    Which rows can matter is bounded. Of one (domain, group) pair only the first few can be taken,
    as both caps only fill up. A taken card has before it in its domain fewer than per_domain taken
    ones, and skipped ones of full groups, of which there are at most total / per_group; so its rank
    in the domain is bounded, likewise in its group, and then its rank in all. Null domains and
    groups count as one each."""
    pair = min(per_domain, per_group)
    full_g, full_d = total // per_group, total // per_domain
    in_domain, in_group = full_g * pair + per_domain, full_d * pair + per_group
    bound = total + full_d * in_domain + full_g * in_group
    rows = cards.withColumns({"d": F.coalesce("domain", F.lit("")), "g": F.coalesce("group", F.lit(""))})
    best = [F.desc("score"), F.asc("pos")]
    for keys, n in ((["d", "g"], pair), (["d"], in_domain), (["g"], in_group), ([], bound)):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(*best))).filter(F.col("r") <= n)
    item = F.struct((-F.col("score")).alias("o"), "pos", "d", "g")
    taken_type = "array<struct<pos:bigint,d:string,g:string,gain:double>>"

    def step(taken, x):
        nd = F.size(F.filter(taken, lambda t: t["d"] == x["d"])) + 1
        ng = F.size(F.filter(taken, lambda t: t["g"] == x["g"])) + 1
        gain = F.when((nd == 1) & (ng == 1), 1.0).when((nd <= 2) & (ng <= 2), 0.7).otherwise(0.4)
        new = F.array(F.struct(x["pos"].cast("long").alias("pos"), x["d"].alias("d"), x["g"].alias("g"), gain.alias("gain")))
        return F.when((F.size(taken) < total) & (nd <= per_domain) & (ng <= per_group), F.concat(taken, new)).otherwise(taken)

    folded = rows.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(taken_type), step).alias("t"))
    return folded.select("query_id", F.posexplode("t").alias("place", "t")).select("query_id", (F.col("place") + 1).alias("place"), "t.pos", F.col("t.d").alias("domain"), F.col("t.g").alias("group"), "t.gain")


def clipped(items: DataFrame, max_items: int, max_chars: int) -> DataFrame:
    """The first max_items of each query by pos. The first whose text goes over the budget of
    characters is cut to what is left (its last character an ellipsis) or to nothing, and marked;
    those after it stay as they are."""
    w = Window.partitionBy("query_id").orderBy("pos")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = items.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_items).withColumn("before", before)
    over = F.col("before") + F.coalesce(F.length("text"), F.lit(0)) > max_chars
    first = F.min(F.when(over, F.col("r"))).over(Window.partitionBy("query_id"))
    left = F.greatest(F.lit(max_chars) - F.col("before"), F.lit(0))
    cut = F.when(left == 0, None).when(F.length("text") <= left, F.col("text")).otherwise(F.concat(F.expr(f"substring(text, 1, cast(greatest({max_chars} - before, 1) as int) - 1)"), F.lit("…")))
    rows = rows.withColumn("clipped", F.coalesce(F.col("r") == first, F.lit(False)))
    return rows.withColumn("text", F.when(F.col("clipped"), cut).otherwise(F.col("text"))).drop("r", "before")


def richest(sources: DataFrame) -> DataFrame:
    """Sources without those of a URL key that another has with more reasons (n_reasons), or as
    many and an earlier pos; sources without a usable URL stay."""
    keyed = sources.withColumn("key", urls.dedup_key(F.col("url")))
    w = Window.partitionBy("key").orderBy(F.desc("n_reasons"), "pos")
    named = keyed.filter("key is not null").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return named.unionByName(keyed.filter("key is null"))


def excerpts(rows: DataFrame, n: int = 3) -> DataFrame:
    """The excerpts of each card: list after list, in a list by score from the top, each text once
    (white space and case aside), none that repeats the card's snippet or is blank, at most n.

    rows: card, list_no, pos, score (null last), text, snippet."""
    same = lambda c: F.lower(text.one_line(c))
    order = [F.asc("list_no"), F.desc_nulls_last("score"), F.asc("pos")]
    rows = rows.withColumn("norm", same(F.col("text"))).filter("norm <> ''").filter(~F.col("norm").eqNullSafe(same(F.col("snippet"))))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("card", "norm").orderBy(*order))).filter("r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("card").orderBy(*order))).filter(F.col("place") <= n).select("card", "place", "text")


def unlike(passages: DataFrame, length: int = 4, least: int = 4, overlap: float = 0.8, most: int | None = 256) -> DataFrame:
    """query_id, pos, kept: whether a passage says something that no kept one before it (by pos) says.

    It does not if its tokens are the same, or if the smaller set of shingles has ``least`` or more
    and ``overlap`` of it is shared. The first ``most`` passages of a query are judged, as an answer
    holds no more, and any after them are kept; with None all are judged. A task holds the hashes (64 bits) of one query's judged
    passages, found through an index of shingles, so none is compared with all before it."""
    tokens = text.tokens(F.coalesce("text", F.lit("")))
    rows = passages.select("query_id", "pos", tokens.alias("tokens")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - length + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("tokens", i, length)))
    grams = F.when(F.size("tokens") >= length, F.array_distinct(grams)).otherwise(F.array().cast("array<long>"))
    judged = (rows if most is None else rows.filter(F.col("r") <= most)).select("query_id", F.col("pos").cast("long").alias("pos"), F.xxhash64("tokens").alias("h"), F.size("tokens").alias("n"), grams.alias("grams"))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        said, having, sizes, kept = set(), {}, [], []
        for h, n, gs in zip(group["h"], group["n"], group["grams"]):
            shared = Counter(k for g in gs for k in having.get(g, ()))
            floors = ((c, min(len(gs), sizes[k])) for k, c in shared.items())
            new = n == 0 or not ((h, n) in said or any(f >= least and c / f >= overlap for c, f in floors))
            kept.append(new)
            if new:
                said.add((h, n))
                for g in gs:
                    having.setdefault(g, []).append(len(sizes))
                sizes.append(len(gs))
        return group[["query_id", "pos"]].assign(kept=kept)

    early = judged.groupBy("query_id").applyInPandas(judge, StructType([judged.schema["query_id"], StructField("pos", LongType()), StructField("kept", BooleanType())]))
    if most is None:
        return early
    late = rows.filter(F.col("r") > most).select("query_id", F.col("pos").cast("long").alias("pos"), F.lit(True).alias("kept"))
    return early.unionByName(late)


def waves(items: DataFrame, size: int, budget: int) -> DataFrame:
    """Items of a batch in waves of ``size`` by pos; an item runs unless an earlier wave had a
    failure or the characters of earlier waves are over the budget."""
    w = Window.partitionBy("query_id")
    rows = items.withColumn("wave", F.floor((F.row_number().over(w.orderBy("pos")) - 1) / size))
    earlier = w.orderBy("wave").rangeBetween(Window.unboundedPreceding, -1)
    failed, spent = F.coalesce(F.max("failed").over(earlier), F.lit(False)), F.coalesce(F.sum("n_chars").over(earlier), F.lit(0))
    return rows.withColumn("runs", ~failed & (spent <= budget))
