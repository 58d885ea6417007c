"""Registered queries about columns of positioned words, with their SQL twins: a recursion over each page's positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import layout
from tallyspark.plans.catalog import _read, query


def _words(spark, d):
    """Each order is a page, each of its lines a word; the first line is the header at 100, the next one too near to count."""
    x0, n = F.col("l_partkey") % 200, F.col("l_linenumber")
    top = F.when(n == 1, 100).when(n == 2, 103).otherwise(100 + 20 * n)
    return _read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), x0.cast("double").alias("x0"), (x0 + 4 + F.col("l_suppkey") % 40).cast("double").alias("x1"), top.cast("double").alias("top"), F.lit(100.0).alias("header_top")
    )


def _sql(mode):
    reach, fewest, apart = layout.COLUMN_MODES[mode]
    rows = "w" if mode == "all" else "w WHERE n <> 2"
    left = "" if mode == "alignment" else f"UNION SELECT doc_id, x0 FROM {rows} "
    keep = f"QUALIFY coalesce(centre - lag(centre) OVER (PARTITION BY doc_id ORDER BY c) > {apart}, true)" if apart else ""
    head = "WHERE EXISTS (SELECT 1 FROM w WHERE n = 1 AND w.doc_id = k.doc_id)" if mode == "header" else ""
    return f"""WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, (l_partkey % 200)::DOUBLE AS x0, (l_partkey % 200 + 4 + l_suppkey % 40)::DOUBLE AS x1 FROM lineitem),
p AS (SELECT doc_id, (x0 + x1) / 2 AS x FROM {rows} {left}), r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY x) AS i FROM (SELECT DISTINCT * FROM p)),
f AS (SELECT doc_id, i, x AS total, 1 AS n, 1 AS c FROM r WHERE i = 1
UNION ALL SELECT r.doc_id, r.i, CASE WHEN r.x - f.total / f.n < {reach} THEN f.total + r.x ELSE r.x END, CASE WHEN r.x - f.total / f.n < {reach} THEN f.n + 1 ELSE 1 END, CASE WHEN r.x - f.total / f.n < {reach} THEN f.c ELSE f.c + 1 END FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1),
k AS (SELECT doc_id, c, arg_max(total, i) / max(n) AS centre FROM f GROUP BY doc_id, c HAVING max(n) >= {fewest}),
s AS (SELECT * FROM k {head} {keep})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1)::INTEGER AS column_no, centre FROM s"""


def _columns(mode):
    def run(spark, d):
        return layout.running_columns(_words(spark, d), ["doc_id", "page"], mode).drop("page")

    return run


for _mode in layout.COLUMN_MODES:
    query(f"W7_{_mode}_columns", _sql(_mode))(_columns(_mode))
