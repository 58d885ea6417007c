"""Registered queries about jobs and files over time, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.catalog import _read, query
from tallyspark.streaming import status

_JOBS_SQL = """e AS (SELECT user_id AS job, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS message, CASE WHEN event_id % 4 > 0 THEN (event_id % 100)::INTEGER END AS progress FROM events),
l AS (SELECT *, CASE WHEN lag(status) OVER w = 'completed' AND epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 300000000 THEN 1 ELSE 0 END AS afresh FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, seq)),
g AS (SELECT *, sum(afresh) OVER (PARTITION BY job ORDER BY ts, seq) AS life FROM l), k AS (SELECT * FROM g QUALIFY life = max(life) OVER (PARTITION BY job)),
s AS (SELECT job, arg_max(status, (ts, seq)) AS status, coalesce(arg_max(message, (ts, seq)) FILTER (message <> ''), '') AS message, coalesce(arg_max(progress, (ts, seq)) FILTER (progress IS NOT NULL), 0) AS progress, max(ts) AS ts, least(count(*) FILTER (message <> ''), 50) AS n_events FROM k GROUP BY job)"""


def _jobs(spark, d):
    n = F.col("event_id")
    return _read(spark, d, "events").select(
        F.col("user_id").alias("job"), "ts", n.alias("seq"), F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"),
        F.when(n % 3 == 0, "").otherwise(F.col("event_type")).alias("message"), F.when(n % 4 > 0, (n % 100).cast("int")).alias("progress"),
    )


@query("R2_job_status", f"WITH {_JOBS_SQL} SELECT * FROM s")
def r2_status(spark, d):
    """Each user's events as a job that ends with a purchase."""
    return status.statuses(_jobs(spark, d))


@query("R3_remembered", f"WITH {_JOBS_SQL}, m AS (SELECT max(ts) AS now FROM events) SELECT s.* FROM s, m WHERE NOT (status = 'completed' AND epoch_us(now) - epoch_us(ts) >= 300000000)")
def r3_remembered(spark, d):
    """Jobs that are still remembered at the last event of all."""
    now = _read(spark, d, "events").agg(F.max("ts")).first()[0]
    return status.statuses(_jobs(spark, d), now)


@query("R2_asked", f"WITH {_JOBS_SQL} SELECT c_custkey AS job, coalesce(status, 'unknown') AS status, coalesce(message, 'Job not found') AS message, coalesce(progress, 0) AS progress FROM customer LEFT JOIN s ON c_custkey = job")
def r2_asked(spark, d):
    """Every customer asks for the job of their number; most have none."""
    return status.asked(_read(spark, d, "customer").select(F.col("c_custkey").alias("job")), status.statuses(_jobs(spark, d)))


@query("R4_retention", "WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderpriority AS kind, count(*) FILTER (epoch_us(now) - epoch_us(o_orderdate) > 7200000000::BIGINT * 365) AS cleaned, count(*) FILTER (NOT epoch_us(now) - epoch_us(o_orderdate) > 7200000000::BIGINT * 365) AS kept FROM orders, m GROUP BY ALL")
def r4(spark, d):
    """Orders as files of their priority's kind, kept for 730 hours."""
    orders = _read(spark, d, "orders")
    now = orders.agg(F.max("o_orderdate")).first()[0]
    return status.retention_counts(orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("modified")), now, hours=730)
