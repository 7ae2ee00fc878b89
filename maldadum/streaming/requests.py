"""Requests as a stream: debounce, latest wins, and the newest sessions.

A writer's requests that follow one another within the gap are one burst, of which the last is answered. The same functions take batch and
streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The last ``value`` of each burst: ``key``, ``start``, ``end`` (the last event's time plus the gap), ``n``, ``last``.

    On a stream, bursts come out once the watermark has passed them; events later than ``late`` are dropped by the engine and shown in its
    progress. Null keys are a key of their own; events with a null time belong to no burst."""
    timed = events.where(F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", late)
    bursts = timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_ts", value)).alias("l"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.col(f"l.{value}").alias("last"))


def latest(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Each key's row of the highest ``order``; of equal ones the larger values. A running answer on a stream in update or complete mode."""
    return events.groupBy(key).agg(F.max(F.struct(order, *values)).alias("l")).select(key, *[F.col(f"l.{c}").alias(c) for c in (order, *values)])


def newest(sessions: DataFrame, ts: str, tie: str, limit: int = 20) -> DataFrame:
    """The newest sessions, as a report of fixed length."""
    return sessions.orderBy(F.desc_nulls_last(ts), F.desc(tie)).limit(limit)


def newest_per_key(sessions: DataFrame, key: str, ts: str, tie: str, limit: int = 20) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(ts), F.desc(tie)))
    return sessions.withColumn("rank", rank).where(F.col("rank") <= limit)
