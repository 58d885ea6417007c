"""Readers and writers at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "xls", "xlsx"]


def manifest(spark: SparkSession, path: str, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Files of a known kind up to a size; their content is not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(EXTENSIONS) & (F.col("length") <= most_bytes))


def price_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns ``Product Name`` and ``PRICE``; raises ValueError without them."""
    df = spark.read.csv(path, header=True)
    if missing := {"Product Name", "PRICE"} - set(df.columns):
        raise ValueError(f"the price list lacks {', '.join(sorted(missing))}")
    return df


def write_price_list(catalogue: DataFrame, path: str) -> None:
    """Name, description and price of every named product."""
    name = F.trim(F.coalesce("model", F.col("name") if "name" in catalogue.columns else F.lit(None)))
    out = catalogue.select(name.alias("Product Name"), F.col("description").alias("Description"), F.col("price").alias("PRICE"))
    out.where(F.length("Product Name") > 0).write.csv(path, header=True)


def with_text_rows(grid: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of all tables and, of documents without a table, the lines of their text as rows of one cell (table 0, page 0 where the grid
    has pages); lines without text go, so documents without any have no rows."""
    bare = texts.join(grid.select("doc_id").distinct(), "doc_id", "left_anti")
    lines = bare.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("row_idx", "line")).where("trim(line) <> ''")
    rows = lines.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("table_idx"), "row_idx", F.array("line").alias("cells"))
    names = ["doc_id", *(["page"] if "page" in grid.columns else []), "table_idx", "row_idx", "cells"]
    return grid.select(*names).unionByName(rows.select(*names))


def write_tables(grid: DataFrame, path: str) -> None:
    """One folder per document, page (where the grid has pages) and table."""
    grid.write.partitionBy(*[c for c in ("doc_id", "page", "table_idx") if c in grid.columns]).parquet(path)


def offer_rows(items: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each offer, then its subtotal, tax and grand total."""
    rows = items.select(*keys, F.lit("item").alias("section"), F.col("item_no").cast("int").alias("seq"), "total")
    sums = totals.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(k).alias("seq"), F.col(n).alias("total")) for k, n in enumerate(("subtotal", "vat", "grand_total"))])).alias("x"))
    return rows.unionByName(sums.select(*keys, "x.section", "x.seq", "x.total"))


BLOCK = "array<struct<block_label: string, block_type: string, block_content: string>>"
PAGE = f"array<struct<prunedResult: struct<parsing_res_list: {BLOCK}>, pruned_result: struct<parsing_res_list: {BLOCK}>, parsing_res_list: {BLOCK}>>"
#: Where services put the list of pages.
PAGE_KEYS = ["layoutParsingResults", "layout_parsing_results", "pages", "results"]


def layout_blocks(docs: DataFrame, json: str = "json") -> DataFrame:
    """Answers of a layout service to (doc_id, page, block, label, content, is_table). The pages are under one of PAGE_KEYS, there or
    in ``result``, or are the answer itself. A block is a table by its label or type, by table tags, or by three pipes. Other texts give no rows."""
    keys = ", ".join(f"{k}: {PAGE}" for k in PAGE_KEYS)
    whole = F.from_json(json, f"struct<result: struct<{keys}>, {keys}>")
    bare = F.when(F.trim(json).startswith("["), F.from_json(json, PAGE))
    parsed = docs.select("doc_id", whole.alias("w"), bare.alias("b"))
    found = F.coalesce(*[F.col(f"w.{p}{k}") for p in ("", "result.") for k in PAGE_KEYS], F.col("b"))
    pages = parsed.select("doc_id", F.posexplode(found).alias("page", "p"))
    blocks = F.coalesce("p.prunedResult.parsing_res_list", "p.pruned_result.parsing_res_list", "p.parsing_res_list")
    rows = pages.select("doc_id", "page", F.posexplode(blocks).alias("block", "x"))
    content = F.coalesce("x.block_content", F.lit(""))
    label, kind = F.lower(F.coalesce("x.block_label", F.lit(""))), F.lower(F.coalesce("x.block_type", F.lit("")))
    by_text = F.lower(content).rlike("<table|<tr>|<td>") | (F.regexp_count(content, F.lit("[|]")) > 2)
    is_table = (content != "") & (label.isin("table", "table_block", "table_cell") | kind.isin("table", "table_block") | by_text)
    return rows.select("doc_id", "page", "block", label.alias("label"), content.alias("content"), is_table.alias("is_table"))


COLLECTIONS = "array<struct<collection: string, products: array<struct<position: bigint, model: string, price: double>>>>"


def brand_files(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """The brand files of a tier, ``<brand>_<tier>.json`` with ``brand`` and ``collections``: (brand, tier, collections). The name in the file wins over the file's name."""
    files = spark.read.option("wholetext", True).text(f"{path}/*_{tier}.json").select("value", F.col("_metadata.file_name").alias("file"))
    parsed = files.select(F.from_json("value", f"brand string, collections {COLLECTIONS}").alias("v"), F.regexp_extract("file", rf"^(.*)_{tier}\.json$", 1).alias("file_brand"))
    return parsed.select(F.coalesce("v.brand", "file_brand").alias("brand"), F.lit(tier).alias("tier"), "v.collections")


def flattened(brands: DataFrame) -> DataFrame:
    """One row per product of every collection: (brand, tier, collection, position, model, price)."""
    rows = brands.select("brand", "tier", F.explode("collections").alias("c"))
    return rows.select("brand", "tier", F.col("c.collection").alias("collection"), F.inline("c.products"))
