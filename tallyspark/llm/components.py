"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import run_once, shared_dir, unbroadcast

#: Edges of a task: few edges go to few tasks (as many as there are cores at least), however many partitions a shuffle has, so that rounds leave few files.
EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node that can be reached.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): each round hangs neighbours
    on the smallest node seen, so chains of length n end after O(log n) rounds and no round gathers
    a node's neighbours in one place (minima are pre-aggregated, the join back can be split).
    Each round's edges are checkpointed in the shared folder. Loops, repeated and null edges are ignored.
    """
    shared_dir(edges.sparkSession)
    with run_once(edges.sparkSession):
        a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        now = edges.where("a is not null and b is not null and a <> b").select(a, b).distinct().checkpoint()
        cores = edges.sparkSession.sparkContext.defaultParallelism
        seen, tasks = None, max(cores, -(-now.count() // EDGES))
        while True:
            now = now.coalesce(tasks)
            # large star: every larger neighbour of u moves to the smallest node around u
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.where("b > a").join(unbroadcast(least), "a").where("b <> m").select(F.col("m").alias("a"), "b").coalesce(tasks).distinct().coalesce(tasks)
            # small star: u and its smaller neighbours move to the smallest of them
            least = large.groupBy("b").agg(F.min("a").alias("m"))
            moved = large.join(unbroadcast(least), "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            now = moved.unionByName(least.select(F.col("m").alias("a"), "b")).coalesce(tasks).distinct().coalesce(tasks).checkpoint()
            mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if mark == seen:
                break
            seen = mark
    pairs = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
