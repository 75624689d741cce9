"""Live state: windows over events, sessions, latest values, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with ts as a timestamp with time zone, and on a stream with a watermark."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return held.withWatermark("ts", late) if events.isStreaming else held


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; on a stream, events later than `late` are left out."""
    held = _timed(events, late)
    rows = held.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """(start, n, users): sliding windows."""
    held = _timed(events)
    rows = held.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users") if events.isStreaming else F.countDistinct("user_id").alias("users"))
    return rows.select(F.col("window.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of that length."""
    held = _timed(events)
    rows = held.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest(updates: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """The last value of every other column for each key: last-value-wins state."""
    others = [c for c in updates.columns if c not in (*keys, time)]
    last = F.max_by(F.struct(*others), F.struct(time, *others)).alias("x")
    return updates.groupBy(*keys).agg(F.max(time).alias(time), last).select(*keys, time, "x.*")


def fresh(now: Column, then: Column, seconds: int = 300) -> Column:
    """If a state file of that time is young enough to count."""
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) <= seconds


def progress(updates: DataFrame) -> DataFrame:
    """(stage, done, total, share): the latest progress of each stage."""
    rows = latest(updates, ["stage"])
    return rows.select("stage", "done", "total", F.round(F.coalesce(F.try_divide("done", "total"), F.lit(0.0)), 6).alias("share"))
