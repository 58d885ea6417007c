"""Reports on items: images of rows, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def images_by_overlap(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each image to the row of its page that it overlaps most, else to the row whose centre is nearest."""
    a, b = images.alias("a"), boxes.alias("b")
    over = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    gap = F.abs((F.col("a.y0") + F.col("a.y1")) / 2 - (F.col("b.y0") + F.col("b.y1")) / 2)
    both = a.join(b, [F.col("a.doc_id") == F.col("b.doc_id"), F.col("a.page") == F.col("b.page")])
    rows = both.select("a.doc_id", "a.page", "a.img_id", "b.row_idx", over.alias("o"), gap.alias("g"))
    best = F.coalesce(F.max_by("row_idx", F.when(F.col("o") > 0, F.struct("o", -F.col("row_idx")))), F.min_by("row_idx", F.struct("g", "row_idx")))
    return rows.groupBy("doc_id", "page", "img_id").agg(best.alias("row_idx"))


def images_by_rank(images: DataFrame, rows: DataFrame) -> DataFrame:
    """The nth image of a page, from above, to its nth data row; surplus images go."""
    i = images.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy((F.col("y0") + F.col("y1")) / 2, "img_id")))
    k = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row_idx")))
    k = k.withColumn("global_row", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "row_idx")) - 1)
    return i.join(k, ["doc_id", "page", "r"]).select("doc_id", "page", "img_id", "row_idx", "global_row")
