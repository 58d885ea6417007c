import json

from pyspark.sql import functions as F

from tallyspark.operators import pages
from tallyspark.streaming import jobs

EVENTS = [(1, "2024-01-01 00:00:00", 7, "a", 1.25), (2, "2024-01-01 00:00:04", 7, "a", 2.0), (3, "2024-01-01 00:30:00", 7, "b", 1.0), (4, "2024-01-01 01:00:00", 8, "a", 0.5)]
NAMES = ["event_id", "ts", "user_id", "event_type", "value"]


def streamed(spark, tmp_path, make, mode):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(NAMES, e))) for e in EVENTS))
    source = spark.readStream.schema("event_id long, ts timestamp, user_id int, event_type string, value double").json(f"file://{tmp_path}/in")
    run = make(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    return spark.table("out").collect()


def test_first_upload(spark, tmp_path):
    rows = streamed(spark, tmp_path, lambda s: jobs.first_upload_stream(s, ["user_id", "event_type"]), "append")
    assert sorted(r.event_id for r in rows) == [1, 3, 4]


def test_hourly(spark, tmp_path):
    rows = streamed(spark, tmp_path, jobs.hourly, "complete")
    assert sorted((str(r.hour)[11:13], r.event_type, r.n, r.value_cents) for r in rows) == [("00", "a", 2, 325), ("00", "b", 1, 100), ("01", "a", 1, 50)]


def test_batches(spark):
    ev = spark.createDataFrame(EVENTS, NAMES).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in jobs.sessions(ev, "user_id").collect()) == [1, 1, 2]
    assert {r.user_id: r.expired for r in jobs.expired(ev, "user_id", "2024-01-01 01:03:00").collect()} == {7: True, 8: False}
    assert [r.event_id for r in jobs.newest_upload(ev, ["user_id", "event_type"]).orderBy("event_id").collect()] == [2, 3, 4]


def test_product_links(spark):
    html = '<h1>A&amp;B</h1><a href="/product/1">x</a><a href="/product/1">y</a><a href="/collection/product/2">z</a><a href="/about">u</a>'
    page = spark.createDataFrame([(1, "http://h/x", html)], "page_id int, url string, html string")
    assert [(r.target, r.pos) for r in pages.product_links(page).collect()] == [("http://h/product/1", 0)]
    assert tuple(pages.product(page).first()) == (1, "A&B", None)
    kinds = spark.createDataFrame([("http://h/category/a",), ("http://h/item/a",), ("http://h/",)], "u string").select(pages.page_kind(F.col("u")))
    assert [r[0] for r in kinds.collect()] == ["category", "product", "other"]
