"""The innermost symbol of a line: against every pair, and where thousands of symbols have every line."""

import random

from pyspark.sql import functions as F

from sievework.operators import state


def test_against_every_pair(spark):
    draw = random.Random(3)
    symbols = [(i, draw.choice([0, 1, None]), f, f + draw.choice([-1, 0, 1, 7, 63, 64, 300])) for i, f in enumerate(draw.randrange(-40, 400) for _ in range(300))]
    symbols.append((999, 1, 5, None))
    places = [(i, draw.choice([0, 1, 2, None]), draw.choice([None, draw.randrange(-60, 800)])) for i in range(400)]
    got = state.enclosing(spark.createDataFrame(places, "place_id long, file int, line long"), spark.createDataFrame(symbols, "symbol_id long, file int, first long, last long")).collect()
    for r in got:
        mine = [(b - a, -a, s) for s, f, a, b in symbols if None not in (f, a, b, r.line) and f == r.file and a <= r.line <= b]
        assert r.symbol == (min(mine)[2] if mine else None)
    assert sorted(r.place_id for r in got) == list(range(400))


def test_without_symbols(spark):
    got = state.enclosing(spark.createDataFrame([(1, 0, 3)], "place_id long, file int, line long"), spark.createDataFrame([], "symbol_id long, file int, first long, last long")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, None)]


def test_a_line_meets_no_more_rows_where_all_symbols_have_it(spark):
    n = 60_000
    symbols = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit(0).alias("file"), (F.col("id") % 50).alias("first"), (100 + F.col("id") % 50).alias("last"))
    places = spark.range(n).select(F.col("id").alias("place_id"), F.lit(0).alias("file"), (50 + F.col("id") % 50).alias("line"))
    got = state.enclosing(places, symbols).groupBy("symbol").count().collect()
    assert [tuple(r) for r in got] == [(49, n)]
