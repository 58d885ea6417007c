"""Connected components, and what intermediate tables leave on disk."""

from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.components import connected_components


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, out.collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]


def test_rounds_leave_no_shuffle(spark):
    """A chain, a star and copies of a link: the roots are right, and few edges go to few tasks whatever a shuffle's partitions."""
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 240)] + [(7, 200)] * 5 + [(9, 9), (None, 3)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        before = shuffle_files(spark)
        roots = connected_components(edges)
        assert not shuffle_files(spark) - before
        assert roots.rdd.getNumPartitions() <= 32 + spark.sparkContext.defaultParallelism
        got = {r.node: r.root for r in roots.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 240))}
