"""Status of jobs and news of listings as state that a stream keeps, and the same rules on a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statuses that end a job, events kept of each, and how long an ended job is remembered.
ENDS = ("completed", "failed")
LAST = 50
SECONDS = 300
#: The state store that ``transformWithState`` needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EVENT = "ts timestamp, seq long, status string, message string"
_STATUS = f"status string, message string, progress int, ts timestamp, events array<struct<{_EVENT.replace(' timestamp', ':timestamp').replace(' long', ':long').replace(' string', ':string')}>>"
UNKNOWN = {"status": "unknown", "message": "Job not found", "progress": 0}


class JobStatus(StatefulProcessor):
    """One job's status, its last non-empty message, last progress and last events, until SECONDS after an end that nothing followed."""

    def __init__(self, ends: tuple[str, ...] = ENDS, last: int = LAST, seconds: int = SECONDS) -> None:
        self.ends, self.last, self.seconds = ends, last, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, ts timestamp, seq long, message string, message_ts timestamp, message_seq long, progress int, progress_ts timestamp, progress_seq long")
        self.events = handle.getListState("events", _EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        now = list(self.now.get()) if self.now.exists() else [None] * 9
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        for r in new.itertuples(index=False):
            at = (r.ts.to_pydatetime(), int(r.seq))
            if now[0] in self.ends and (at[0] - now[1]).total_seconds() >= self.seconds:
                now, events = [None] * 9, []
            text = r.message if isinstance(r.message, str) and r.message else None
            for k, value in ((0, r.status), (3, text), (6, None if pd.isna(r.progress) else int(r.progress))):
                if (k == 0 or value is not None) and (now[k + 1] is None or (now[k + 1], now[k + 2]) <= at):
                    now[k : k + 3] = [value, *at]
            if text:
                events.append((*at, r.status, text))
        events = sorted(events, key=lambda e: e[:2])[-self.last :]
        self.now.update(tuple(now))
        if events:
            self.events.put(events)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now[0] in self.ends:
            self.handle.registerTimer(int(now[1].timestamp() * 1000) + self.seconds * 1000)
        yield self.row(key, now[0], now[3] or "", now[6] or 0, now[1], events)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.now.clear()
        self.events.clear()
        yield self.row(key, UNKNOWN["status"], UNKNOWN["message"], UNKNOWN["progress"], None, [])

    def row(self, key: Any, status: str, message: str, progress: int, ts: Any, events: list) -> pd.DataFrame:
        names = ("ts", "seq", "status", "message")
        return pd.DataFrame({"job": [key[0]], "status": [status], "message": [message], "progress": [progress], "ts": pd.Series([ts], dtype="datetime64[us]"), "events": [[dict(zip(names, e, strict=True)) for e in events]]})

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, late: str = "10 seconds", **rule: Any) -> DataFrame:
    """R2, R3 on a stream of (job, ts, seq, status, message, progress): a job's row whenever it changes, and one of status ``unknown`` when it is forgotten.

    State lives by job. Needs the state store ``STORE``; rows later than ``late`` behind the newest are dropped. Write it in update mode.
    """
    kind = events.schema["job"].dataType.simpleString()
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("job").transformWithStateInPandas(JobStatus(**rule), outputStructType=f"job {kind}, {_STATUS}", outputMode="Update", timeMode="EventTime")


def statuses(events: DataFrame, now: Any = None, ends: tuple[str, ...] = ENDS, last: int = LAST, seconds: int = SECONDS) -> DataFrame:
    """R2, R3 on a batch: (job, status, message, progress, ts, n_events) of every job that is still remembered at ``now`` (none: at its last event).

    An event ``seconds`` or more after an end starts the job afresh. ``n_events`` counts those with a message, ``last`` at most.
    """
    order = Window.partitionBy("job").orderBy("ts", "seq")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(order))
    afresh = F.coalesce(F.lag("status").over(order).isin(*ends) & (gap >= seconds * 1_000_000), F.lit(False))
    lives = events.withColumn("_afresh", afresh).withColumn("_life", F.sum(F.col("_afresh").cast("int")).over(order))
    key = F.struct("_life", "ts", "seq")
    told = lambda c, ok: F.max(F.when(ok, F.struct("_life", "ts", "seq", F.col(c).alias("v"))))
    n = F.max_by("_n", "_life")
    by_life = lives.groupBy("job", "_life").agg(
        F.max_by("status", key).alias("status"), F.max("ts").alias("ts"), told("message", F.coalesce(F.col("message") != "", F.lit(False))).alias("m"),
        told("progress", F.col("progress").isNotNull()).alias("p"), F.least(F.count_if(F.coalesce(F.col("message") != "", F.lit(False))), F.lit(last)).alias("_n"),
    )
    newest = lambda c: F.max_by(c, "_life")
    out = by_life.groupBy("job").agg(newest("status").alias("status"), F.coalesce(newest("m.v"), F.lit("")).alias("message"), F.coalesce(newest("p.v"), F.lit(0)).alias("progress"), newest("ts").alias("ts"), n.alias("n_events"))
    if now is None:
        return out
    gone = F.col("status").isin(*ends) & (micros(F.lit(now)) - micros(F.col("ts")) >= seconds * 1_000_000)
    return out.where(~gone)


def asked(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """R2: the status of each asked job; one that is not known has status ``unknown`` and progress 0."""
    out = jobs.select("job").join(known.select("job", "status", "message", "progress"), "job", "left")
    return out.select("job", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in UNKNOWN.items()])


def retention(files: DataFrame, now: Any, hours: float = 24) -> DataFrame:
    """Files (kind, modified) with ``old``: older than ``hours`` at ``now``. Nothing is deleted."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("modified").cast("timestamp"))
    return files.withColumn("old", F.coalesce(age > int(hours * 3_600_000_000), F.lit(False)))


def retention_counts(files: DataFrame, now: Any, hours: float = 24) -> DataFrame:
    """(kind, cleaned, kept) of every kind of files."""
    return retention(files, now, hours).groupBy("kind").agg(F.count_if("old").alias("cleaned"), F.count_if(~F.col("old")).alias("kept"))


class FirstSeen(StatefulProcessor):
    """Whether a product of a site is new: the page that brought it first is remembered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "page int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pages = sorted(set(pd.concat([r["page"] for r in rows]).tolist()))
        seen = self.first.exists()
        if not seen:
            self.first.update((int(pages[0]),))
        new = [0 if seen else 1] + [0] * (len(pages) - 1)
        yield pd.DataFrame({"site": [key[0]] * len(pages), "source_url": [key[1]] * len(pages), "page": pages, "new": new})

    def close(self) -> None:
        pass


def arrivals(products: DataFrame) -> DataFrame:
    """R5 on a stream of (site, page, source_url): each product of each page, with ``new`` 1 where no earlier page of the site had it.

    State lives by site and product, so that a large site is many keys. Pages come in order, each in one batch.
    """
    kinds = {c: products.schema[c].dataType.simpleString() for c in ("site", "source_url")}
    return products.groupBy("site", "source_url").transformWithStateInPandas(
        FirstSeen(), outputStructType=f"site {kinds['site']}, source_url {kinds['source_url']}, page int, new int", outputMode="Append", timeMode="None"
    )


class Listings:
    """A ``foreachBatch`` sink for ``arrivals`` that keeps the products of each listing up to the first page without news, under ``folder``.

    A batch writes its own parts, ``pages/batch=n`` and ``products/batch=n``, and replaces them when it is run again after a failure.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _part(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        counts = rows.groupBy("site", "page").agg(F.sum("new").alias("new"))
        counts.write.mode("overwrite").parquet(self._part("pages", batch))
        ends = self.pages(spark).where(F.col("batch") <= batch).groupBy("site").agg(F.min(F.when(F.col("new") == 0, F.col("page"))).alias("end"))
        fresh = rows.where("new = 1").join(ends, "site").where(F.col("end").isNull() | (F.col("page") < F.col("end")))
        fresh.select("site", "page", "source_url").write.mode("overwrite").parquet(self._part("products", batch))

    def pages(self, spark: SparkSession) -> DataFrame:
        """(site, page, new, batch)"""
        return spark.read.parquet(f"{self.folder}/pages")

    def products(self, spark: SparkSession) -> DataFrame:
        """(site, page, source_url) of all listings, each product once."""
        return spark.read.parquet(f"{self.folder}/products").select("site", "page", "source_url")

    def by_page(self, spark: SparkSession) -> DataFrame:
        """(site, page, new, wanted), as ``crawl.new_by_page`` gives it for all pages at once."""
        seen = self.pages(spark).groupBy("site", "page").agg(F.sum("new").alias("new"))
        end: Column = F.min(F.when(F.col("new") == 0, F.col("page"))).over(Window.partitionBy("site"))
        return seen.select("site", "page", "new", (end.isNull() | (F.col("page") < end)).alias("wanted"))
