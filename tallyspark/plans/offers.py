"""Registered queries from pages of tables to costed offers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.operators import costing, stitch, tables
from tallyspark.plans.catalog import _FACTORS_SQL, FACTOR_ROWS, _dealt, _read, _tasks, query
from tallyspark.sources import io

HEAD = ["Si.No", "Item Description", "Qty", "Unit Rate", "Total"]
PER_PAGE = 3
_LINES_SQL = f"""
li AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn,
  l_partkey AS p, floor(l_quantity)::BIGINT AS q, floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT AS c FROM lineitem)"""


def _lines(spark, d, kind=None):
    li = _dealt(spark, d, "lineitem", "l_orderkey")
    li = li if kind is None else li.where(F.col("l_orderkey") % 3 == kind)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5).cast("long")
    rate = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    cells = F.array(F.row_number().over(order).cast("string"), F.concat(F.lit("part number "), F.col("l_partkey").cast("string")), F.floor("l_quantity").cast("string"), rate, F.lit("0.00"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("rn"), cells.alias("cells"))
    last = F.count("*").over(Window.partitionBy("doc_id")) == F.col("rn")
    return rows.withColumns({"page": F.floor((F.col("rn") - 1) / PER_PAGE).cast("int"), "last": last})


def _grid(spark, d):
    """The orders as documents of several pages: a third each as markdown, as HTML, and as HTML in the blocks of a layout answer. Every page has the header
    again; HTML pages have a section's title below it, and HTML documents end with a row of totals. Lines, pages where
    they are sorted by their lines, and the rows of tables are dealt into partitions that follow the rows: they are small, so that few tasks would take them, but texts
    and patterns take long. Each third is made of its own lines only."""
    tasks = _tasks(spark, d, "lineitem")

    def pages(kind):
        page = _lines(spark, d, kind).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("rn", "cells"))).alias("r"), F.max("last").alias("last"))
        return page.select((F.col("doc_id") * 1000 + F.col("page")).alias("doc_id"), "last", F.transform("r", lambda x: x["cells"]).alias("r"))

    md = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.array(*map(F.lit, HEAD))
    markdown = F.concat(F.lit("Offer\n"), md(head), F.lit("\n|---|---|---|---|---|\n"), F.array_join(F.transform("r", md), "\n"))
    tr = lambda cells, tag="td": F.concat(F.lit(f"<tr><{tag}>"), F.array_join(cells, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))
    total = F.when(F.col("last"), tr(F.array(*map(F.lit, ["", "Total", "", "", "12.00"])))).otherwise("")
    html = lambda title="": F.concat(F.lit("<table>"), tr(head, "th"), F.lit(title), F.array_join(F.transform("r", lambda cells: tr(cells)), ""), total, F.lit("</table>"))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("table").alias("block_label"), html().alias("block_content"))).alias("parsing_res_list")).alias("prunedResult"))).alias(io.PAGE_KEYS[0])))
    blocks = io.layout_blocks(pages(2).select("doc_id", answer.alias("json"))).where("is_table").select("doc_id", F.col("content").alias("html"))
    cells = ["doc_id", "table_idx", "row_idx", "cells"]
    written = pages(0).select("doc_id", markdown.alias("md")).repartition(tasks, "doc_id")
    titled = pages(1).select("doc_id", html("<tr><td>ZONE A</td></tr><tr><td> </td></tr>").alias("html"))
    parts = [tables.markdown_grid(written), tables.html_grid(titled), tables.html_grid(blocks)]
    grid = parts[0].select(*cells).unionByName(parts[1].select(*cells)).unionByName(parts[2].select(*cells))
    return grid.select(F.floor(F.col("doc_id") / 1000).alias("doc_id"), (F.col("doc_id") % 1000).alias("page"), "table_idx", "row_idx", "cells").repartition(tasks, "doc_id")


_MONEY = "(c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0')"


@query(
    "U10_stitched",
    f"""WITH {_LINES_SQL}, r AS (SELECT doc_id, (rn - 1) // {PER_PAGE} AS page, 1 AS k, rn, rn || '|part number ' || p || '|' || q || '|' || {_MONEY} || '|0.00' AS cells FROM li
UNION ALL SELECT DISTINCT doc_id, (rn - 1) // {PER_PAGE}, 0, 0, 'ZONE A' FROM li WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, (max(rn) - 1) // {PER_PAGE}, 2, 0, '|Total|||12.00' FROM li WHERE doc_id % 3 > 0 GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, k, rn) AS row_no, cells FROM r""",
)
def u10(spark, d):
    return stitch.stitched(_grid(spark, d)).select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells"))


@query("X4_table_items", f"WITH {_LINES_SQL} SELECT doc_id, 'part number ' || p AS description, q::DOUBLE AS qty, c / 100.0::DOUBLE AS unit_rate, 'general' AS category FROM li")
def x4(spark, d):
    return stitch.table_items(stitch.stitched(_grid(spark, d))).select("doc_id", "description", "qty", "unit_rate", "category")


_COSTED = "floor(c / 100.0::DOUBLE * exchange_rate * (1 + freight / 100.0) * (1 + customs / 100.0) * (1 + installation / 100.0) * (1 + net_margin / 100.0) * (1 + additional / 100.0) * 100.0 + 0.5) / 100.0"


@query(
    "X2_costed_tables",
    f"WITH {_LINES_SQL}, {_FACTORS_SQL}, r AS (SELECT doc_id, scenario_id, q, {_COSTED} AS rate FROM li, factors) SELECT doc_id, scenario_id, sum(floor(q * rate * 100.0 + 0.5)::BIGINT)::BIGINT AS total_cents, sum(floor(rate * 100.0 + 0.5)::BIGINT)::BIGINT AS rate_cents FROM r GROUP BY ALL",
)
def x2(spark, d):
    from tallyspark.functions.text import cents, number

    rows = stitch.stitched(_grid(spark, d))
    numbered = rows.where(F.get("cells", F.lit(0)).rlike("^[0-9]+$"))  # the number has no price's header; above the scenarios cells would be costed once more for the test
    items = stitch.costed_rows(numbered, costing.scenarios(spark, FACTOR_ROWS))
    money = lambda i: F.sum(cents(number(F.get("cells", F.lit(i)))))
    return items.groupBy("doc_id", "scenario_id").agg(money(4).alias("total_cents"), money(3).alias("rate_cents"))


_TABLES_SQL = "t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS table_idx, l_quantity AS score, l_linenumber % 4 AS m FROM lineitem)"


@query(
    "T8_candidates",
    f"WITH {_TABLES_SQL}, r AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS best FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY score + CASE m WHEN 1 THEN 30 WHEN 2 THEN 25 WHEN 3 THEN 20 ELSE 0 END DESC, score DESC, table_idx)) SELECT doc_id, table_idx, rank FROM r WHERE score >= 0.9::DOUBLE * best",
)
def t8(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    names = F.array(*map(F.lit, ["plain", "unstructured", "layoutparser", "layout_preserving"]))
    t = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("table_idx"), F.col("l_quantity").alias("score"), F.get(names, F.col("l_linenumber") % 4).alias("method"))
    return stitch.candidates(t, ["doc_id"]).select("doc_id", "table_idx", F.col("rank").cast("long").alias("rank"))


@query("T4_latest", "SELECT o_custkey AS file_id, max(o_orderpriority || '_' || o_orderkey) AS name FROM orders GROUP BY 1")
def t4(spark, d):
    return stitch.latest(_read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.concat("o_orderpriority", F.lit("_"), F.col("o_orderkey").cast("string")).alias("name")), ["file_id"])


@query("P22_uploaded", "SELECT o_orderkey AS file_id, o_orderkey % 2 = 0 AS has_extraction, o_orderkey % 3 = 0 AS has_stitched, o_orderkey % 5 = 0 AS has_costed FROM orders WHERE o_orderstatus <> 'P'")
def p22(spark, d):
    made = lambda n: F.when(F.col("o_orderkey") % n == 0, F.lit("{}"))
    flag = F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "F", False)
    files = _read(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), flag.alias("multibudget"), made(2).alias("extraction"), made(3).alias("stitched"), made(5).alias("costed"))
    return stitch.uploaded(files).select("file_id", "has_extraction", "has_stitched", "has_costed")


@query("U9_first_strategy", "SELECT l_orderkey AS site, l_partkey AS link FROM lineitem QUALIFY l_linenumber % 3 = min(l_linenumber % 3) OVER (PARTITION BY l_orderkey)")
def u9(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("link"), (F.col("l_linenumber") % 3).alias("strategy"))
    return stitch.first_strategy(rows, ["site"]).select("site", "link")


@query("T5_from_top", "SELECT l_orderkey AS page, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS row_no FROM lineitem")
def t5(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("y"), F.col("l_partkey").alias("x"))
    return stitch.from_top(rows, ["page"]).select("page", "id", F.col("row_no").cast("long").alias("row_no"))


@query(
    "F4_price_in_prose",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || '.50' WHEN 1 THEN p_partkey || ',25' WHEN 2 THEN p_partkey::VARCHAR END AS price FROM part",
)
def f4(spark, d):
    n = F.col("p_partkey").cast("string")
    prose = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_name"), F.lit(" now AED "), n, F.lit(".50 only"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("for "), n, F.lit(",25 € each"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Price: "), n))
    return _read(spark, d, "part").select("p_partkey", stitch.price_in_prose(F.coalesce(prose, F.lit("ask for it"))).alias("price"))


@query(
    "F23_display",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN format('{:,}', doc_id * 1234) || '.50' WHEN length(text) > 800 THEN left(text, 797) || '...' ELSE text END AS shown FROM documents WHERE text IS NOT NULL",
)
def f23(spark, d):
    docs = _read(spark, d, "documents").where("text is not null")
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("AED "), (F.col("doc_id") * 1234).cast("string"), F.lit(".50"))).otherwise(F.col("text"))
    return docs.select("doc_id", stitch.display(text, even).alias("shown"))


_FOUND_SQL = "list_transform(list_filter([{}], lambda w: contains(lower(d), w)), lambda w: upper(w[1]) || w[2:])"
_MADE_SQL, _COLOURS_SQL = (_FOUND_SQL.format(", ".join(f"'{w}'" for w in words)) for words in (rules.MATERIALS, rules.COLOURS))


@query(
    "X11_submittal",
    f"""WITH p AS (SELECT p_partkey, p_size, p_brand || ' ' || p_name || ' 120 x 60 cm' || CASE p_partkey % 3 WHEN 0 THEN ' by sedus' WHEN 1 THEN ' steel' ELSE '' END AS d FROM part),
s AS (SELECT *, {_MADE_SQL} AS m, {_COLOURS_SQL} AS c FROM p)
SELECT p_partkey AS doc_id, d AS description, p_size::VARCHAR AS qty, 'pcs' AS unit, CASE p_partkey % 3 WHEN 0 THEN 'Sedus' ELSE 'Brand' END AS brand,
  concat_ws('; ', 'Dimensions: 120 x 60 cm', CASE WHEN len(m) > 0 THEN 'Materials: ' || array_to_string(m, ', ') END, CASE WHEN len(c) > 0 THEN 'Available Colors: ' || array_to_string(c, ', ') END) AS specifications,
  CASE WHEN p_partkey % 2 = 0 THEN 'imgs/' || p_partkey || '.png' END AS image, '5 Years' AS warranty FROM s""",
)
def x11(spark, d):
    key = F.col("p_partkey")
    end = F.when(key % 3 == 0, " by sedus").when(key % 3 == 1, " steel").otherwise("")
    about = F.concat(F.lit("<b>"), F.col("p_brand"), F.lit("</b> "), F.col("p_name"), F.lit(" 120 x 60 cm"), end)
    image = F.when(key % 2 == 0, F.concat(F.lit("<img src='imgs/"), key.cast("string"), F.lit(".png'>"))).otherwise("-")
    heads = F.array(*map(F.lit, ["Item", "Product Discription", "Image", "Qty", "Unit", "Unit Rate"]))
    rows = _read(spark, d, "part").select(key.alias("doc_id"), heads.alias("headers"), F.array(F.col("p_name"), about, image, F.col("p_size").cast("string"), F.lit("pcs"), F.lit("1.00")).alias("cells"))
    return stitch.submittal_items(rows).select("doc_id", "description", "qty", "unit", "brand", F.array_join("specifications", "; ").alias("specifications"), "image", "warranty")
