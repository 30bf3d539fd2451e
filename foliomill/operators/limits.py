"""Request limits: sliding window and daily quota, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T


def rate_breaches(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(event_id, user_id, calls): calls that make more than ``limit`` within the seconds before them, their own included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy("us").rangeBetween(1 - seconds * 1_000_000, 0)
    rows = events.select("event_id", "user_id", micros.alias("us")).withColumn("calls", F.count("*").over(window))
    return rows.filter(F.col("calls") > limit).select("event_id", "user_id", "calls")


def daily_use(events: DataFrame, quota: int = 0) -> DataFrame:
    """(user_id, day, calls, over): calls per quota day and how many exceed the quota (0: no quota)."""
    rows = events.groupBy("user_id", T.quota_day(F.col("ts")).alias("day")).agg(F.count("*").alias("calls"))
    return rows.withColumn("over", F.greatest(F.lit(0), F.col("calls") - quota) if quota else F.lit(0).cast("long"))


def admitted(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(event_id, user_id, ts, start, waited): when each call may start if calls queue for the limit.

    Enforcing is sequential per user: rows are streamed in time order, the
    state is the last ``limit`` starts.
    """
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("us", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, starts = None, []
        for batch in batches:
            out = []
            for u, us in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if u != user:
                    user, starts = u, []
                at = max(us, starts[-limit] + seconds * 1_000_000 if len(starts) >= limit else us, starts[-1] if starts else us)
                starts = [*starts[-limit + 1 :], at] if limit > 1 else [at]
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], schema=schema)

    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    done = rows.mapInArrow(run, "event_id long, user_id long, us long, start long")
    return done.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("start").alias("start"), ((F.col("start") - F.col("us")) / 1e6).alias("waited"))
