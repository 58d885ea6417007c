"""Tables out of raw text, and the clean-up of their rows.

A grid row is (doc_id, page, table_idx, row_idx, cells). Nothing here makes a column per header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import is_summary

SEPARATOR = r"^[-|: ]+$"


def markdown_grid(docs: DataFrame, text: str = "md", blank_cells: str = "drop") -> DataFrame:
    """Runs of lines with a pipe are tables, their first line is the header (row 0); separator lines go, wherever they are.

    ``drop`` leaves out blank cells and then rows with another number of cells than the header; ``keep`` cuts between the outer pipes.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    piped = F.contains("line", F.lit("|"))
    block = F.sum(F.when(~piped, 1).otherwise(0)).over(order)
    trimmed = lambda c: F.transform(F.split(c, r"[|]"), lambda c: F.trim(c))
    if blank_cells == "keep":
        cells = trimmed(F.regexp_replace(F.trim("line"), r"^\||\|$", ""))
    else:
        cells = F.filter(trimmed(F.col("line")), lambda c: c != "")
    rows = lines.withColumn("block", block).where(piped & ~F.col("line").rlike(SEPARATOR)).select("doc_id", "block", "line_no", cells.alias("cells"))
    table = Window.partitionBy("doc_id", "block").orderBy("line_no")
    n = F.count("*").over(Window.partitionBy("doc_id", "block"))
    rows = rows.withColumns({"row_idx": F.row_number().over(table) - 1, "width": F.first(F.size("cells")).over(table), "n": n})
    return rows.where((F.col("n") >= 2) & (F.size("cells") == F.col("width"))).select("doc_id", F.col("block").alias("table_idx"), "row_idx", "cells")


def html_grid(docs: DataFrame, html: str = "html") -> DataFrame:
    """S3: every table, row and cell, in order; nested tables are not told apart."""
    tables = docs.select("doc_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table_idx", "t"))
    rows = tables.select("doc_id", "table_idx", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_idx", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    return rows.select("doc_id", "table_idx", "row_idx", cells.alias("cells"))


def delimited_grid(docs: DataFrame, text: str = "text") -> DataFrame:
    """Tab, else pipe, else two spaces or more; lines of two cells at least, texts of two lines at least."""
    line = F.col("line")
    cut = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit("|")), F.split(line, "[|]")).otherwise(F.split(F.trim(line), r" {2,}"))
    cells = F.filter(F.transform(cut, lambda c: F.trim(c)), lambda c: c != "")
    rows = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("row_idx", "line")).select("doc_id", "row_idx", cells.alias("cells")).where(F.size("cells") >= 2)
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 2").drop("n")


def cells_of(grid: DataFrame) -> DataFrame:
    """The long form: (doc_id, table_idx, row_no, col_idx, header, text), headers from row 0."""
    headers = grid.where("row_idx = 0").select("doc_id", "table_idx", F.col("cells").alias("headers"))
    rows = grid.where("row_idx > 0").join(headers, ["doc_id", "table_idx"])
    return rows.select("doc_id", "table_idx", F.col("row_idx").alias("row_no"), F.posexplode("cells").alias("col_idx", "text"), "headers").withColumn("header", F.try_element_at("headers", F.col("col_idx") + 1)).drop("headers")


def merge_pages(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, table_idx, headers) with ``merged_id``: a table goes on if it is on the next page, has as many columns, and
    its headers are blank (70 % or more), equal those of its group (70 % or more), or hold two numbers or prices."""
    order = Window.partitionBy("doc_id").orderBy("page", "table_idx")
    size = F.size("headers")
    blank = F.size(F.filter("headers", lambda h: F.trim(h) == ""))
    numeric = F.size(F.filter("headers", lambda h: h.rlike(r"^\s*(QAR)?\s*[0-9][0-9,.]*\s*$")))
    own = F.when((blank < 0.7 * size) & (numeric < 2), F.col("headers"))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    equal = F.size(F.filter(F.arrays_zip(F.col("headers").alias("a"), F.col("_before").alias("b")), lambda z: F.lower(F.trim(z["a"])) == F.lower(F.trim(z["b"]))))
    rows = tables.withColumns({"_before": before, "_page": F.lag("page").over(order), "_size": F.lag(size).over(order)})
    same = (F.col("page") - F.col("_page") == 1) & (size == F.col("_size")) & ((blank >= 0.7 * size) | (numeric >= 2) | (equal >= 0.7 * size))
    rows = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return rows.withColumns({"merged_id": F.sum("_new").over(order), "header_is_data": (F.col("_new") == 0) & (numeric >= 2)}).drop("_before", "_page", "_size", "_new")


def serial(text):
    """The first digits, if from 1 to 10000."""
    n = F.nullif(F.regexp_extract(text, r"[0-9]+", 0), F.lit("")).try_cast("int")
    return F.when(n.between(1, 10_000), n)


def sort_by_serial(rows: DataFrame, keys: list[str], sn, position: str) -> DataFrame:
    """Rows without a number last, ties in place."""
    return rows.withColumn("sorted_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(sn), position)))


def sort_numbered_slots(rows: DataFrame, keys: list[str], sn: str, position: str) -> DataFrame:
    """Numbered rows are sorted among their own slots; the others stay where they are."""
    own = rows.where(F.col(sn).isNotNull())
    slot = own.select(*keys, F.col(position).alias("sorted_no"), F.row_number().over(Window.partitionBy(*keys).orderBy(position)).alias("_r"))
    value = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(sn, position)))
    moved = value.join(slot, [*keys, "_r"]).drop("_r")
    return moved.unionByName(rows.where(F.col(sn).isNull()).withColumn("sorted_no", F.col(position)))


def carry_sections(rows: DataFrame, keys: list[str], position: str, text: str, is_section) -> DataFrame:
    """Each row with the last section title above it."""
    order = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(F.when(is_section, F.col(text)), ignorenulls=True).over(order))


def is_section(cells):
    """One cell with text, in capitals or title case, without a digit, 50 characters at most."""
    full = F.filter(cells, lambda c: F.trim(c) != "")
    t = F.try_element_at(full, F.lit(1))
    return (F.size(full) == 1) & ((t == F.upper(t)) | (t == F.initcap(t))) & ~t.rlike("[0-9]") & (F.length(t) <= 50)


def merge_continuations(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows (serial, description, qty, price as text) that continue an item are folded into it: descriptions joined by a space, numbers from the first row that has them."""
    num = r"^\s*[0-9][0-9,.]*\s*$"
    start = F.coalesce(F.col("serial").rlike(r"^\s*[0-9]+"), F.lit(False)) | (F.col("qty").rlike(num) & F.col("price").rlike(num)) | ((F.length("description") > 10) & (F.col("qty").rlike(num) | F.col("price").rlike(num)))
    begin = F.coalesce(start | is_summary(F.col("description")), F.lit(False)).cast("int")
    item = F.sum(begin).over(Window.partitionBy(*keys).orderBy(position))
    text = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct(position, "description"))), lambda x: x["description"]), lambda d: d != ""), " ")
    first = lambda c: F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", F.col(position)))
    return rows.withColumn("item_id", item).groupBy(*keys, "item_id").agg(text.alias("description"), first("serial").alias("serial"), first("qty").alias("qty"), first("price").alias("price"), F.count("*").alias("merged_rows"))


def distinct_rows(grid: DataFrame) -> DataFrame:
    """U4: of equal rows in a table (cells trimmed) the first stays; blank rows go; a table left with one row goes."""
    key = F.array_join(F.transform("cells", lambda c: F.trim(c)), "|")
    rank = F.row_number().over(Window.partitionBy("doc_id", "table_idx", "_k").orderBy("row_idx"))
    rows = grid.withColumn("_k", key).where(F.length(F.replace("_k", F.lit("|"), F.lit(""))) > 0).withColumn("_r", rank).where("_r = 1")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "table_idx"))).where("_n >= 2").drop("_k", "_r", "_n")


def quality(grid: DataFrame, role_words: str = "description|qty|quantity|unit|rate|price|amount|total|item") -> DataFrame:
    """A10: 30 or 15 for the header's cells, 30 or 15 for the rows, 10 for each role word (30 at most), 10 for even rows."""
    n, hits = F.size("cells"), F.size(F.filter("cells", lambda c: F.lower(c).rlike(role_words)))
    g = grid.groupBy("doc_id", "table_idx").agg(F.max(F.when(F.col("row_idx") == 0, n)).alias("h"), F.max(F.when(F.col("row_idx") == 0, hits)).alias("r"), F.count_if(F.col("row_idx") > 0).alias("rows"), F.min(n).alias("lo"), F.max(n).alias("hi"))
    header = F.when(F.col("h") >= 4, 30).when(F.col("h") >= 2, 15).otherwise(0)
    body = F.when(F.col("rows") >= 5, 30).when(F.col("rows") >= 2, 15).otherwise(0)
    return g.select("doc_id", "table_idx", (header + body + F.least(F.lit(30), F.coalesce("r", F.lit(0)) * 10) + F.when(F.col("lo") == F.col("hi"), 10).otherwise(0)).alias("score"))


def best_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The highest score, the first of equal ones."""
    return scored.groupBy(*keys).agg(F.max_by("table_idx", F.struct("score", -F.col("table_idx"))).alias("table_idx"), F.max("score").alias("score"))
