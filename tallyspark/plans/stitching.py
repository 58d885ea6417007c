"""Registered queries about stitched tables with letters, notes, several headers or none, and about their items, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import stitch
from tallyspark.plans.catalog import _read, query
from tallyspark.plans.offers import HEAD, PER_PAGE, _lines, _LINES_SQL


def _mixed_grid(spark, d):
    """Orders as documents of four kinds: a header on every page; none; a letter before the first table and a note at the end of each; another header on later pages."""
    li = _lines(spark, d).select("doc_id", "page", F.lit(1).alias("table_idx"), F.col("rn").alias("row_idx"), F.array(F.replace(F.get("cells", 1), F.lit("part number "), F.lit("")), F.get("cells", 2)).alias("cells"))
    kind = F.col("doc_id") % 4
    pages = li.select("doc_id", "page").distinct()
    row = lambda rows, table, at, cells: rows.select("doc_id", "page", F.lit(table).alias("table_idx"), F.lit(at).alias("row_idx"), cells.alias("cells"))
    item, ref = F.array(F.lit("Item"), F.lit("Qty")), F.array(F.lit("Ref"), F.lit("Colour"))
    heads = row(pages.where(kind != 1), 1, 0, F.when((kind == 3) & (F.col("page") == 0), ref).otherwise(item))
    letters = row(pages.where((kind == 2) & (F.col("page") == 0)), 0, 0, F.array(F.lit("a letter to you"), F.lit("")))
    notes = row(pages.where(kind == 2), 1, 1000, F.array(F.lit("unit and price as agreed"), F.lit("")))
    blanks = row(pages, 1, 500, F.array(F.lit("<b> </b>"), F.lit(" ")))
    return li.unionByName(heads).unionByName(letters).unionByName(notes).unionByName(blanks)


@query(
    "U10_mixed_documents",
    f"""WITH {_LINES_SQL}, r AS (SELECT doc_id, (rn - 1) // {PER_PAGE} AS page, 1 AS t, rn AS pos, p || '|' || q AS cells FROM li
UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, 'a letter to you|' FROM li WHERE doc_id % 4 = 2
UNION ALL SELECT DISTINCT doc_id, (rn - 1) // {PER_PAGE}, 1, 1000, 'unit and price as agreed|' FROM li WHERE doc_id % 4 = 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, t, pos) AS row_no, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 3 THEN 'Ref|Colour' ELSE 'Item|Qty' END AS headers, cells FROM r""",
)
def u10_mixed(spark, d):
    out = stitch.stitched(_mixed_grid(spark, d))
    return out.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|").alias("cells"))


@query(
    "X4_varied_items",
    """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 7 AS k, p_name AS n, p_size AS q FROM part)
SELECT doc_id, CASE k WHEN 0 THEN 'Executive chair ' || n WHEN 1 THEN 'meeting table' WHEN 3 THEN 'planter box' WHEN 4 THEN 'bar stool' ELSE 'office desk' END AS description, q::DOUBLE AS qty, CASE k WHEN 4 THEN 0 ELSE 12.5 END::DOUBLE AS unit_rate,
  CASE WHEN k IN (0, 4) THEN 'seating' WHEN k = 3 THEN 'general' ELSE 'desking' END AS category, CASE k WHEN 0 THEN 'executive_chairs' WHEN 1 THEN 'meeting_tables' WHEN 3 THEN 'general' WHEN 4 THEN 'task_chairs' ELSE 'workstations' END AS subcategory
FROM p WHERE k NOT IN (2, 5) AND (k <> 4 OR q > 0)""",
)
def x4_varied(spark, d):
    """Items of several categories; too short a description, a repeated header, and neither quantity nor rate make none."""
    k = F.col("p_partkey") % 7
    text = F.when(k == 0, F.concat(F.lit("Executive chair "), F.col("p_name"))).when(k == 1, "meeting table").when(k == 2, "abcd").when(k == 3, "planter box").when(k == 4, "bar stool").otherwise("office desk")
    cells = F.array(F.lit("1"), text, F.col("p_size").cast("string"), F.when(k == 4, "TBA").otherwise("12.50"), F.lit("0"))
    cells = F.when(k == 5, F.array(*map(F.lit, HEAD))).otherwise(cells)
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("row_no"), F.array(*map(F.lit, HEAD)).alias("headers"), cells.alias("cells"))
    return stitch.table_items(rows).select("doc_id", "description", "qty", "unit_rate", "category", "subcategory")
