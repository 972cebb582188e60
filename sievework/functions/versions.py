"""Version orders and range expressions with three outcomes, as Column expressions.

Versions of any length are compared: the shorter one is padded with zeros. A number is what fits
an unsigned 64-bit integer. Most ecosystems share one order; Maven has its own for qualifiers;
images and workflow actions are equal or not comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 18446744073709551615  # 2 ** 64 - 1

# Ranks of Maven's qualifiers; others rank with a release.
QUALIFIERS = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "milestone": 2, "m": 2, "rc": 3, "cr": 3, "snapshot": 4, "sp": 6}
RELEASE_RANK, RELEASE_NAMES = 5, ["final", "ga", "release"]
#: Ecosystems whose versions have no order.
UNORDERED = ["oci", "github_actions"]


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often it stands in the body."""
    return F.get(F.transform(F.array(value), body), 0)


def _bare(version: Column) -> Column:
    return F.regexp_replace(F.trim(version), "^v+", "")


def _number(token: Column) -> Column:
    """A decimal, or null for what is no unsigned 64-bit integer."""
    n = F.when(token.rlike("^0*[0-9]{1,20}$"), F.regexp_replace(token, "^0+(?=[0-9])", "").cast("decimal(20,0)"))
    return F.when(n <= F.lit(str(LARGEST)).cast("decimal(20,0)"), n)


def key(version: Column) -> Column:
    """struct(numbers, release, tag): 1 for a release, 0 for a prerelease. Segments that are no number
    are dropped; what follows "+" is ignored; tags compare as strings; null without a number."""
    bare = F.substring_index(_bare(version), "+", 1)
    numbers = F.filter(F.transform(F.split(F.substring_index(bare, "-", 1), r"\."), _number), lambda n: n.isNotNull())
    found = F.struct(numbers.alias("numbers"), (~F.contains(bare, F.lit("-"))).cast("int").alias("release"), F.regexp_extract(bare, "^[^-]*-(.*)$", 1).alias("tag"))
    return _let(found, lambda k: F.when(F.size(k["numbers"]) > 0, k))


def maven_key(version: Column) -> Column:
    """struct(numbers, release, tag): release is the rank of the qualifier, tag its name."""
    tokens = F.split(_bare(version), r"[.\-_+]")
    first = _let(tokens, lambda ts: F.coalesce(F.array_position(F.transform(ts, lambda t: _number(t).isNull()), F.lit(True)), F.lit(0)))

    def made(x):
        n = F.when(x["first"] > 0, x["first"] - 1).otherwise(F.size(x["tokens"])).cast("int")
        name = F.lower(F.array_join(F.slice(x["tokens"], n + 1, F.size(x["tokens"])), "-"))
        return F.struct(F.transform(F.slice(x["tokens"], 1, n), _number).alias("numbers"), F.when(name.isin(RELEASE_NAMES), "").otherwise(name).alias("tag"))

    ranks = F.create_map(*[F.lit(v) for kv in QUALIFIERS.items() for v in kv])
    ranked = lambda m: F.when(F.size(m["numbers"]) > 0, F.struct(m["numbers"].alias("numbers"), F.coalesce(F.try_element_at(ranks, m["tag"]), F.lit(RELEASE_RANK)).alias("release"), m["tag"].alias("tag")))
    return _let(_let(F.struct(tokens.alias("tokens"), first.alias("first")), made), ranked)


def _order(k: Column) -> Column:
    """-1, 0 or 1 of two keys, the shorter one padded with zeros."""
    def padded(mine, other):
        more = F.greatest(F.size(other["numbers"]) - F.size(mine["numbers"]), F.lit(0))
        return F.struct(F.concat(mine["numbers"], F.array_repeat(F.lit(0).cast("decimal(20,0)"), more)), mine["release"], mine["tag"])

    sides = F.struct(padded(k["x"], k["y"]).alias("x"), padded(k["y"], k["x"]).alias("y"))
    return F.when(k["x"].isNull() | k["y"].isNull(), None).otherwise(_let(sides, lambda s: F.when(s["x"] < s["y"], -1).when(s["x"] == s["y"], 0).otherwise(1)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is no version."""
    return _let(F.struct(key(a).alias("x"), key(b).alias("y")), _order)


def compare_maven(a: Column, b: Column) -> Column:
    return _let(F.struct(maven_key(a).alias("x"), maven_key(b).alias("y")), _order)


def compare_in(ecosystem: Column, a: Column, b: Column) -> Column:
    """The order of two versions of an ecosystem; null if they can't be compared."""
    return F.when(ecosystem.isin(UNORDERED), F.when(a == b, 0)).when(ecosystem == "maven", compare_maven(a, b)).otherwise(compare(a, b))


def in_range(version: Column, spec: Column, order=compare) -> Column:
    """Whether a version meets all clauses of "op version, op version". Clauses are read left to
    right: the first false one decides, and the first that can't be read makes it unknown (null).
    A version without any operator or comma means equality; a bare one among clauses can't be read,
    and empty clauses are passed over."""
    bare = ~spec.rlike("[<>=!,]")
    clauses = F.filter(F.transform(F.split(spec, ","), lambda c: F.trim(c)), lambda c: c != "")

    def met(c):
        op = F.regexp_extract(c, "^(>=|<=|!=|>|<|=)?", 1)
        told = order(version, F.trim(F.regexp_replace(c, "^(?:>=|<=|!=|>|<|=)", "")))
        out = lambda o: (
            F.when(o.isNull() | ((op == "") & ~bare), None)
            .when(op == ">=", o >= 0)
            .when(op == "<=", o <= 0)
            .when(op == "!=", o != 0)
            .when(op == ">", o > 0)
            .when(op == "<", o < 0)
            .otherwise(o == 0)
        )
        return F.struct(_let(told, out).alias("ok"))

    decided = F.filter(F.transform(clauses, met), lambda m: m["ok"].isNull() | ~m["ok"])
    first = lambda d: F.when(F.size(d) == 0, True).otherwise(F.get(d, 0)["ok"])
    return F.when(F.trim(spec) == "", None).otherwise(_let(decided, first))
