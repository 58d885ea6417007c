"""Tables out of positioned words, and rules that compare whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_columns(words: DataFrame, keys: list[str], x: str = "x0", gap: float = 10.0) -> DataFrame:
    """Words of a page sorted by ``x`` fall into columns wherever two neighbours are ``gap`` apart: (keys, column_no, centre, words)."""
    near = F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(x)) < gap
    flagged = words.select(*keys, F.col(x).cast("double").alias("_x"), F.when(near, 0).otherwise(1).alias("_new"))
    placed = flagged.withColumn("column_no", F.sum("_new").over(Window.partitionBy(*keys).orderBy("_x")))
    return placed.groupBy(*keys, "column_no").agg(F.avg("_x").alias("centre"), F.count("*").alias("words"))


# Fixed values by mode: how near a position must be to the running centre, how many positions make a column, the gap that separates columns (none: any).
COLUMN_MODES = {"all": (15.0, 3, 30.0), "header": (15.0, 2, None), "alignment": (20.0, 2, None)}


def running_columns(words: DataFrame, keys: list[str], mode: str = "all", header: str = "header_top") -> DataFrame:
    """Columns of each page by a running centre: (keys, column_no, centre).

    Different positions of the words (x0, x1, top), from left to right, join the current column while they are nearer than the mode's reach to the mean of its
    members so far. ``all`` takes left edges and middles of all words; ``header`` and ``alignment`` those, or the middles alone, of the row at ``header`` (less than 2 away) and of
    rows 5 and more from it, the former only where there is such a row. Columns of too few positions go; in mode ``all`` so do those 30 or less right of the column before. Each page's positions are one fold over one array.
    """
    reach, fewest, apart = COLUMN_MODES[mode]
    rows = words
    if mode != "all":
        away = F.abs(F.col("top") - F.col(header))
        rows = rows.withColumn("_head", away < 2).where("_head or abs(top - " + f"`{header}`" + ") >= 5")
        if mode == "header":
            rows = rows.withColumn("_any", F.bool_or("_head").over(Window.partitionBy(*keys))).where("_any")
    middle = (F.col("x0") + F.col("x1")) / 2
    spots = F.array(middle) if mode == "alignment" else F.array(F.col("x0").cast("double"), middle)
    xs = F.array_sort(F.array_distinct(F.flatten(F.collect_set(spots))))
    of_page = rows.groupBy(*keys).agg(xs.alias("_xs"))
    none = F.array().cast("array<struct<total:double,n:int>>")

    def closed(acc):
        return F.when(acc["n"] >= fewest, F.concat(acc["done"], F.array(F.struct(acc["total"].alias("total"), acc["n"].alias("n"))))).otherwise(acc["done"])

    def add(acc, x):
        near = x - acc["total"] / acc["n"] < reach
        joined = F.struct((acc["total"] + x).alias("total"), (acc["n"] + 1).alias("n"), acc["done"].alias("done"))
        return F.when(near, joined).otherwise(F.struct(x.alias("total"), F.lit(1).alias("n"), closed(acc).alias("done")))

    start = F.struct(F.get("_xs", 0).alias("total"), F.lit(1).alias("n"), none.alias("done"))
    found = F.aggregate(F.slice("_xs", 2, F.greatest(F.size("_xs") - 1, F.lit(0))), start, add, closed)
    centres = F.transform(found, lambda c: c["total"] / c["n"])
    placed = of_page.select(*keys, centres.alias("_c"))
    if apart is not None:
        placed = placed.withColumn("_c", F.filter("_c", lambda c, i: (i == 0) | (c - F.get("_c", i - 1) > apart)))
    return placed.select(*keys, F.posexplode("_c").alias("column_no", "centre"))


def nearest_column(words: DataFrame, columns: DataFrame, keys: list[str], x: str = "x0", reach: float = 50.0) -> DataFrame:
    """Each word with the column of its page whose centre is nearest, the leftmost of equal ones; null beyond ``reach``. A page's columns are one short array."""
    of_page = columns.groupBy(*keys).agg(F.collect_list(F.struct("centre", "column_no")).alias("_columns"))
    far = F.transform("_columns", lambda c: F.struct(F.abs(F.col(x) - c["centre"]).alias("d"), c["column_no"].alias("column_no")))
    best = F.array_min(F.filter(far, lambda c: c["d"] <= reach))
    return words.join(of_page, keys, "left").withColumn("column_no", best["column_no"]).drop("_columns")


def word_grid(words: DataFrame, gap: float = 10.0, reach: float = 50.0, fewest: int = 10) -> DataFrame:
    """Words (doc_id, page, top, x0, text) to cells (doc_id, page, top, column_no, text); words of one
    rounded ``top`` are a row, the first ten rows make the columns, pages below ``fewest`` words give nothing."""
    page = ["doc_id", "page"]
    rows = words.withColumns({"top": F.round("top", 1), "_n": F.count("*").over(Window.partitionBy(*page))}).where(F.col("_n") >= fewest)
    ranked = rows.withColumn("_row", F.dense_rank().over(Window.partitionBy(*page).orderBy("top")))
    placed = nearest_column(ranked, gap_columns(ranked.where("_row <= 10"), page, "x0", gap), page, "x0", reach).where("column_no is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*page, "top", "column_no").agg(text.alias("text"))


def without_blank_rows(grid: DataFrame) -> DataFrame:
    """Rows go if nothing but tags and white space (no-break and zero-width too) is in their cells."""
    left = F.regexp_replace(F.array_join("cells", ""), r"<[^>]+>|&nbsp;|[\s ​-‍﻿]", "")
    return grid.where(F.length(left) > 0)


def padded(grid: DataFrame, width: str = "width") -> DataFrame:
    """Every row has at least ``width`` cells; runs of three and more spaces become one, ends are trimmed."""
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), " {3,}", " ")))
    more = F.array_repeat(F.lit(""), F.greatest(F.col(width) - F.size("cells"), F.lit(0)))
    return grid.withColumn("cells", F.concat(cells, more))


def distinct_tables(grid: DataFrame) -> DataFrame:
    """Of tables with as many rows and the same first and last row the first by (doc_id, table_idx) stays: (doc_id, table_idx, n_rows)."""
    row = F.array_join("cells", "|", "")
    ends = grid.groupBy("doc_id", "table_idx").agg(F.count("*").alias("n_rows"), F.min_by(row, "row_idx").alias("_first"), F.max_by(row, "row_idx").alias("_last"))
    kept = ends.groupBy("n_rows", "_first", "_last").agg(F.min(F.struct("doc_id", "table_idx")).alias("_t"))
    return kept.select("_t.doc_id", "_t.table_idx", "n_rows")


def similar_tables(grid: DataFrame, share: float = 0.7) -> DataFrame:
    """Tables of a page whose first three rows share more than ``share`` of their words with an earlier table
    of that page: (doc_id, page, table_idx). Distinct shared words over the longer word list, repeats counted."""
    words = F.filter(F.split(F.lower(F.array_join("cells", " ")), " +"), lambda w: w != "")
    tables = grid.where("row_idx < 3").groupBy("doc_id", "page", "table_idx").agg(F.flatten(F.collect_list(words)).alias("w"))
    a, b = tables.alias("a"), tables.alias("b")
    same_page = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.table_idx") < F.col("b.table_idx"))
    overlap = F.size(F.array_intersect("a.w", "b.w")) / F.greatest(F.size("a.w"), F.size("b.w"), F.lit(1))
    return b.join(a, same_page & (overlap > share), "left_semi").select("doc_id", "page", "table_idx")


def extraction_counts(grid: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Pages, tables, rows and images of each document that has any: grid (doc_id, page, table_idx), images (doc_id, page). Pages are those that have either."""
    by_table = grid.groupBy("doc_id", "page", "table_idx").agg(F.count("*").alias("rows"))
    by_page = by_table.groupBy("doc_id", "page").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows")).withColumn("images", F.lit(0).cast("long"))
    if images is not None:
        of_page = images.groupBy("doc_id", "page").agg(F.count("*").alias("images"))
        by_page = by_page.unionByName(of_page.select("doc_id", "page", F.lit(0).cast("long").alias("tables"), F.lit(0).cast("long").alias("rows"), "images"))
        by_page = by_page.groupBy("doc_id", "page").agg(*[F.sum(c).alias(c) for c in ("tables", "rows", "images")])
    return by_page.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("tables", "rows", "images")])


def counts(grid: DataFrame) -> DataFrame:
    """Tables and rows of each document."""
    of_table = grid.groupBy("doc_id", "table_idx").agg(F.count("*").alias("_n"))
    return of_table.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum("_n").alias("rows"))
