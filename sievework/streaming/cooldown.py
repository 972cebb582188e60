"""Provider health as a stream: streaks of failures and the rests they set off, and calls that
repeat within a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.operators.state import OTHER_REST, REST, THRESHOLD

_OUT = "provider string, call_id long, start long, until long"


def _walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One provider's calls of a batch, by time: its state is a streak and the end of its last rest."""
    streak, until = state.get if state.exists else (0, -1)
    rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
    out = []
    for call, at, failed, kind in zip(rows["call_id"], rows["at"], rows["failed"], rows["class"]):
        streak = streak + 1 if failed else 0
        if streak >= THRESHOLD and at >= until:
            until = int(at) + REST.get(kind, OTHER_REST) * 1_000_000
            out.append((key[0], call, at, until))
    state.update((int(streak), int(until)))
    yield pd.DataFrame(out, columns=["provider", "call_id", "start", "until"])


def rests(calls: DataFrame) -> DataFrame:
    """provider, call_id, start, until (microseconds) of each rest, as calls come in. A batch is taken
    in order of time; a call that comes in a later batch than a later one counts when it comes.

    calls (a stream): provider, call_id, ts, failed, class. State is two numbers for each provider."""
    rows = calls.select(F.col("provider").cast("string").alias("provider"), F.col("call_id").cast("long").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "failed", "class")
    return rows.groupBy("provider").applyInPandasWithState(_walk, _OUT, "streak long, until long", "append", GroupStateTimeout.NoTimeout)


def single_flight(calls: DataFrame, key: str = "key", within: str = "30 seconds") -> DataFrame:
    """The first call of each key within a while; the state of a key goes with the watermark."""
    return calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
