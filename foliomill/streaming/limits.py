"""The same limits over a stream of requests."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliomill.functions import text as T


def request_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Requests from the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def daily_use(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, calls) per quota day; calls later than ``late`` are left out."""
    day = F.window(F.col("ts"), "1 day", startTime="8 hours")
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(day.alias("w"), "user_id").agg(F.count("*").alias("calls")).select("user_id", T.quota_day(F.col("w.start")).alias("day"), "calls")


def merged_updates(updates: DataFrame, *key: str) -> DataFrame:
    """The last update of each key, of rows that a batch each wrote with its number in ``batch``."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*key, *(F.col("r")[c].alias(c) for c in rest))


def rate_breaches(stream: DataFrame, limit: int, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """(event_id, user_id, calls) of calls over the limit.

    The state is each user's calls that a later one may still be compared
    with; it goes when the watermark has passed them all.  A call counts those
    of the seconds before it, not later ones that came first; calls later than
    ``late`` are left out.
    """
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for event, us in zip(rows["event_id"].tolist(), rows["us"].tolist()):
            at = bisect_right(recent, us)
            recent.insert(at, us)
            calls = at + 1 - bisect_right(recent, us - span)
            if calls > limit:
                out.append((event, int(key[0]), calls))
        if recent:
            passed = max(0, state.getCurrentWatermarkMs()) * 1000
            recent = recent[bisect_right(recent, passed - span) :]
        if recent:
            state.update((recent,))
            state.setTimeoutTimestamp(max((recent[-1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "calls"])

    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("event_id", "user_id", "at", F.unix_micros("at").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, calls long", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)
