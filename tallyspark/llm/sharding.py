"""Shards by weighted rendezvous hashing of stable record keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import written

SHARDS = 16
#: Rows of one shard are numbered in so many separate groups.
GROUPS = 1024


def rendezvous(key: Column, weights: list[float], seed: int = 42) -> Column:
    """The shard whose score for this key is best: -weight / ln(u), u the key's hash for that shard in (0, 1).

    A further shard wins only the keys for which its own score is best; no other key moves. A larger weight wins in
    proportion. Ties go to the smaller shard. The hash is a pure function of key, shard and seed.
    """
    best = []
    for shard, weight in enumerate(weights):
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11)
        u = (h.cast("double") + 0.5) / float(2**53)
        best.append(F.struct((F.ln(u) / float(weight)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*best)["shard"]).cast("int")


def sharded(docs: DataFrame, n: int = SHARDS, weights: list[float] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row.

    ``shard`` depends on doc_id, the number of shards and their weights alone (rows that repeat a doc_id, or have none, share a
    shard); ``grown_shard`` is where the row goes if one shard of weight 1 is added. A null text has size 1 and no checksum. Slots
    count from 0 in each shard: by hash groups, whose sizes are summed first, so no task sorts a whole shard. Other
    columns are not read.
    """
    weights = weights or [1.0] * n
    key, data = F.col("doc_id").cast("string"), F.col(text).cast("binary")
    size = (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(data).alias("text_crc32"), rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, 1.0]).alias("grown_shard"))
    rows = written(rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(GROUPS)).cast("int")))
    groups = rows.groupBy("shard", "_g").agg(F.count("*").alias("_n"))
    before = groups.select("shard", "_g", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_g")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_g").orderBy("doc_id", "text_crc32", "size")) - 1
    # before has at most shards x GROUPS rows
    return rows.join(before, ["shard", "_g"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + rank).cast("long").alias("slot"), "grown_shard")


def op4_rendezvous_sharding(spark, sf_dir) -> DataFrame:
    """One row per document: its shard of 16, its slot there, and its shard of 17."""
    from tallyspark.llm.common import table

    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
