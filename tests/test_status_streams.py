import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import crawl
from tallyspark.streaming import status

NAMES = ["job", "ts", "seq", "status", "message", "progress"]
SCHEMA = "job string, ts timestamp, seq long, status string, message string, progress int"


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


@pytest.fixture
def store(spark):
    before = spark.conf.get(status.STORE[0])
    spark.conf.set(*status.STORE)
    yield
    spark.conf.set(status.STORE[0], before)


def feed(tmp_path, name, rows, names=NAMES):
    (tmp_path / "in").mkdir(exist_ok=True)
    file = tmp_path / "in" / name
    file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    os.utime(file, (1_700_000_000 + 60 * int(file.stem),) * 2)  # files are read in order of their times


def run(spark, tmp_path, schema, make, sink, mode):
    """Until all that is there has been read; the state stays in the checkpoint."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = make(source).writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def latest(seen):
    return {r.job: r for batch in seen for r in batch}


FIRST = [("a", at(0), 1, "running", "started", 5), ("a", at(2), 3, "running", "", None), ("a", at(1), 2, "running", "page 1", 20), ("b", at(3), 4, "running", "started", None), *[("c", at(4), 100 + k, "running", f"step {k}", k) for k in range(60)]]
SECOND = [("a", at(9), 200, "completed", "done", 100), ("c", at(8), 201, "running", "late step", None), ("b", at(9), 202, "failed", None, None)]


def test_status_over_batches_and_a_restart(spark, store, tmp_path):
    seen = []
    feed(tmp_path, "1.json", FIRST)
    run(spark, tmp_path, SCHEMA, status.status_stream, lambda df, _: seen.append(df.collect()), "update")
    feed(tmp_path, "2.json", SECOND)
    run(spark, tmp_path, SCHEMA, status.status_stream, lambda df, _: seen.append(df.collect()), "update")
    rows = latest(seen)
    batch = status.statuses(spark.createDataFrame(FIRST + SECOND, NAMES).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("progress", F.col("progress").cast("int")))
    for w in batch.collect():
        got = rows[w.job]
        assert (got.status, got.message, got.progress, got.ts, len(got.events)) == (w.status, w.message, w.progress, w.ts, w.n_events)
    assert (rows["a"].status, rows["a"].progress, [e.message for e in rows["a"].events]) == ("completed", 100, ["started", "page 1", "done"])
    assert [e.message for e in rows["c"].events] == [f"step {k}" for k in range(11, 60)] + ["late step"] and rows["c"].progress == 59
    assert (rows["b"].status, rows["b"].message, rows["b"].progress) == ("failed", "started", 0)
    ids = spark.createDataFrame([("a",), ("nobody",)], "job string")
    assert sorted(tuple(r) for r in status.asked(ids, batch).collect()) == [("a", "completed", "done", 100), ("nobody", "unknown", "Job not found", 0)]


def test_state_goes_after_the_end_and_a_later_event_starts_afresh(spark, store, tmp_path):
    seen = []
    sink = lambda df, _: seen.append(df.collect())
    feed(tmp_path, "1.json", FIRST)
    feed(tmp_path, "2.json", SECOND)
    feed(tmp_path, "3.json", [("d", at(320), 300, "running", "other job", 1)])
    run(spark, tmp_path, SCHEMA, status.status_stream, sink, "update")
    feed(tmp_path, "4.json", [("d", at(330), 301, "running", "other job goes on", 2)])
    run(spark, tmp_path, SCHEMA, status.status_stream, sink, "update")
    rows = latest(seen)
    assert (rows["a"].status, rows["a"].progress, rows["a"].events) == ("unknown", 0, []) and rows["b"].status == "unknown"
    assert rows["c"].status == "running" and len(rows["c"].events) == 50
    feed(tmp_path, "5.json", [("a", at(340), 302, "running", "again", None)])
    run(spark, tmp_path, SCHEMA, status.status_stream, sink, "update")
    again = latest(seen)["a"]
    assert (again.status, again.progress, [e.message for e in again.events]) == ("running", 0, ["again"])


def test_lives_of_a_job_on_a_batch(spark):
    rows = [("a", at(0), 1, "running", "x", 5), ("a", at(10), 2, "completed", "end", 100), ("a", at(309), 3, "running", "same life", None), ("a", at(320), 4, "completed", None, None), ("a", at(620), 5, "running", "new life", None)]
    df = spark.createDataFrame(rows, NAMES).withColumn("ts", F.col("ts").cast("timestamp"))
    got = status.statuses(df).first()
    assert (got.status, got.message, got.progress, got.n_events) == ("running", "new life", 0, 1)
    got = status.statuses(df.where("seq < 5")).first()
    assert (got.status, got.message, got.progress, got.n_events) == ("completed", "same life", 100, 3)
    assert status.statuses(df.where("seq < 5"), at(619)).count() == 1 and status.statuses(df.where("seq < 5"), at(620)).count() == 0


def test_listings_in_three_files_with_a_restart(spark, store, tmp_path):
    names, schema = ["site", "page", "source_url"], "site string, page int, source_url string"
    files = [
        [("s", 1, "x"), ("s", 1, "y"), ("t", 1, "x"), ("u", 1, "p"), ("u", 2, "p")],
        [("s", 2, "y"), ("s", 2, "z"), ("t", 2, "x"), ("u", 3, "q")],
        [("s", 3, "x"), ("s", 3, "z"), ("t", 3, "new behind the end"), ("s", 4, "w")],
    ]
    sink = status.Listings(f"file://{tmp_path}/out")
    for k, rows in enumerate(files):
        feed(tmp_path, f"{k}.json", rows, names)
        if k:  # the first two in one run, then a restart
            run(spark, tmp_path, schema, status.arrivals, sink, "append")
    rows = [r for f in files for r in f]
    want = crawl.new_by_page(spark.createDataFrame(rows, names)).collect()
    got = sink.by_page(spark).collect()
    assert sorted((r.site, r.page, r.new, r.wanted) for r in got) == sorted((r.site, r.page, r.new, r.wanted) for r in want)
    assert sorted(tuple(r) for r in sink.products(spark).collect()) == [("s", 1, "x"), ("s", 1, "y"), ("s", 2, "z"), ("t", 1, "x"), ("u", 1, "p")]


def test_retention(spark):
    files = spark.createDataFrame([("uploads", at(0)), ("uploads", at(7200)), ("outputs", at(1)), ("sessions", None)], "kind string, modified string")
    got = status.retention_counts(files, at(7201), hours=2).orderBy("kind").collect()
    assert [tuple(r) for r in got] == [("outputs", 0, 1), ("sessions", 0, 1), ("uploads", 1, 1)]
