"""Rules over time on job and upload events: each works on a batch or, where it says so, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_upload(uploads: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 10) -> DataFrame:
    """An upload goes if the same name comes again within ``seconds``."""
    later = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, "event_id"))
    gap = F.unix_micros(later.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return uploads.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds * 1_000_000)).drop("_gap")


def first_upload_stream(uploads: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """R1 on a stream: the first of each name within ten seconds."""
    return uploads.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "10 seconds").dropDuplicatesWithinWatermark(keys)


def history(events: DataFrame, job: str, n: int = 50) -> DataFrame:
    """The last ``n`` events of each job."""
    rank = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


def status(events: DataFrame, job: str) -> DataFrame:
    """R2: each job's latest status."""
    return events.groupBy(job).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def expired(events: DataFrame, job: str, now, seconds: int = 300) -> DataFrame:
    """By job whether its last event is older than ``seconds``."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))
    return events.groupBy(job).agg((age > seconds * 1_000_000).alias("expired"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by hour and type; on a stream, rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("value_cents"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "value_cents")


def sessions(events: DataFrame, user: str, gap: str = "5 minutes") -> DataFrame:
    """Runs of a user's events with pauses below ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    out = timed.groupBy(F.session_window("ts", gap), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), "n")
