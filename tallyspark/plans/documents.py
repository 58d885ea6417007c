"""Registered queries about headers, page text, listings and collections, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import rules, text
from tallyspark.operators import catalogue, headers, pages
from tallyspark.plans.catalog import _CATALOGUE_SQL, _catalogue, _read, query
from tallyspark.sources import io

# The heads of the tables that the orders make, by order key.
HEADS = [["No", "Item Description", "Qty", "Item Description", "Unit Price"], ["Sr.No", "Remarks", "Quantity Required", " ", "Actions"], ["", "x", "y", "z", "Details"]]
_ROWS_SQL = "li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_idx, l_partkey AS p, l_suppkey AS s, floor(l_quantity)::BIGINT AS q FROM lineitem)"


def _heads():
    return F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in HEADS]), (F.col("o_orderkey") % 3 + 1).cast("int"))


def _lines(spark, d):
    """The orders' items as rows (doc_id, table_idx, row_idx, cells, headers)."""
    from pyspark.sql import Window

    li = _read(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("part number "), F.col("l_partkey").cast("string")), F.floor("l_quantity").cast("string"), F.lit("in stock"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".00")))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.row_number().over(order).alias("row_idx"), cells.alias("cells"))
    return rows.withColumn("o_orderkey", F.col("doc_id")).withColumn("headers", _heads()).drop("o_orderkey")


def _grid(spark, d):
    head = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), _heads().alias("cells"))
    return head.unionByName(_lines(spark, d).drop("headers"))


def _docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", "text")


@query("P1_ui_columns", f"WITH {_ROWS_SQL} SELECT doc_id, row_idx, concat_ws('|', n, 'part number ' || p, q, 'in stock', CASE WHEN doc_id % 3 <> 1 THEN s || '.00' END) AS cells FROM li")
def p1(spark, d):
    return headers.without_ui_columns(_lines(spark, d)).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.array_join("cells", "|").alias("cells"))


@query("P3_header_text", f"SELECT doc_id, regexp_matches(lower(regexp_replace(text, '<[^>]+>', '', 'g')), '{text.any_of(rules.HEADER_WORDS)}') AS is_header FROM documents")
def p3(spark, d):
    return _docs(spark, d).select("doc_id", headers.is_header_text(F.col("text")).alias("is_header"))


@query("P4_located_headers", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE -1 END AS header_row, CASE o_orderkey % 3 WHEN 0 THEN 'No|Item Description|Qty|Item Description|Unit Price' ELSE 'Column 1|Column 2|Column 3|Column 4|Column 5' END AS headers FROM orders")
def p4(spark, d):
    return headers.located_headers(_grid(spark, d)).select("doc_id", "header_row", F.array_join("headers", "|").alias("headers"))


@query("P5_detected_header", "SELECT o_orderkey AS doc_id, 0 AS header_row FROM orders")
def p5(spark, d):
    return headers.detected_header(_grid(spark, d)).select("doc_id", "header_row")


@query("P6_roles", f"WITH {_ROWS_SQL} SELECT doc_id, row_idx, CASE WHEN doc_id % 3 < 2 THEN n::VARCHAR END AS serial, CASE doc_id % 3 WHEN 0 THEN 'part number ' || p WHEN 2 THEN s || '.00' END AS description, CASE WHEN doc_id % 3 < 2 THEN q::VARCHAR END AS quantity, CASE WHEN doc_id % 3 = 1 THEN s || '.00' END AS actions FROM li")
def p6(spark, d):
    return headers.by_role(_lines(spark, d)).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "serial", "description", "quantity", "actions")


@query("P7_clean_headers", "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'No|Item Description|Quantity|Rate' WHEN 1 THEN 'Sr.No|Remarks|Quantity|Actions' ELSE 'x|y|z|Item Details' END AS headers FROM orders")
def p7(spark, d):
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(headers.clean_headers(_heads()), "|").alias("headers"))


@query("P8_aligned", f"WITH {_ROWS_SQL} SELECT doc_id, row_idx, CASE doc_id % 3 WHEN 0 THEN concat_ws('|', n, 'part number ' || p || ' in stock', q, s || '.00') WHEN 1 THEN concat_ws('|', n, 'part number ' || p, q, s || '.00') ELSE concat_ws('|', 'part number ' || p, q, 'in stock', s || '.00') END AS cells FROM li")
def p8(spark, d):
    cells = headers.aligned_cells(F.col("headers"), F.col("cells"))
    return _lines(spark, d).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.array_join(cells, "|").alias("cells"))


_OUTSIDE = "|".join([text.any_of(rules.NON_TABLE), *rules.NON_TABLE_PATTERNS])


@query("P10_non_table", f"SELECT doc_id, regexp_matches(lower(text), '{_OUTSIDE}') OR len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) < 2 AS non_table FROM documents")
def p10(spark, d):
    return _docs(spark, d).select("doc_id", headers.is_non_table_row(F.col("text")).alias("non_table"))


_ROLES_SQL = " + ".join(f"CAST(regexp_matches(lower(text), '{text.any_of(v)}') AS INTEGER)" for v in rules.ROLES.values())
_PAGE_SQL = " + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in rules.NON_TABLE_PAGE)


@query("P11_table_content", f"WITH x AS (SELECT doc_id, {_ROLES_SQL} AS r, {_PAGE_SQL} AS o, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents) SELECT doc_id, NOT (o > r AND r < 2) AND n >= 5 AS has_table FROM x")
def p11(spark, d):
    return _docs(spark, d).select("doc_id", headers.has_table_content(F.col("text")).alias("has_table"))


@query("P14_valid_rows", "SELECT l_orderkey AS doc_id, count(*) AS rows FROM lineitem GROUP BY 1")
def p14(spark, d):
    head = _grid(spark, d).where("row_idx = 0").select("doc_id", F.col("cells").alias("headers"))
    valid = _grid(spark, d).join(head, "doc_id").where(headers.is_valid_row(F.col("headers"), F.col("cells")))
    return valid.groupBy("doc_id").agg(F.count("*").alias("rows"))


@query("A15_text_columns", f"WITH {_ROWS_SQL} SELECT doc_id, CAST(avg(length('part number ' || p)) AS DOUBLE) AS mean_length, avg(length('part number ' || p)) > 15 AS is_text FROM li WHERE row_idx <= 4 GROUP BY doc_id")
def a15(spark, d):
    return headers.text_columns(_grid(spark, d)).where("col_idx = 1").select("doc_id", "mean_length", "is_text")


@query("A11_weighted_quality", f"WITH {_ROWS_SQL}, c AS (SELECT doc_id, count(*) AS r FROM li GROUP BY doc_id), h AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'no item description qty item description unit price' WHEN 1 THEN 'sr.no remarks quantity required   actions' ELSE ' x y z details' END AS text FROM orders), k AS (SELECT doc_id, {_ROLES_SQL} AS k FROM h) SELECT doc_id, CAST(least(2 * (coalesce(r, 0) + 1), 50) + 30 + 5 * k + least(4 * coalesce(r, 0), 30) + CASE WHEN r >= 1 THEN 10 ELSE 0 END AS DOUBLE) AS score FROM k LEFT JOIN c USING (doc_id)")
def a11(spark, d):
    return headers.weighted_quality(_grid(spark, d)).select("doc_id", F.col("score").cast("double").alias("score"))


@query("W2_carried_header", "WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS table_idx, CASE WHEN l_returnflag = 'R' THEN lower(l_linestatus) END AS h FROM lineitem), f AS (SELECT doc_id, page, table_idx, h, arg_min(h, (page, table_idx)) FILTER (h IS NOT NULL) OVER w AS header, count(h) OVER w AS k FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, table_idx, h NULLS LAST ROWS UNBOUNDED PRECEDING)) SELECT doc_id, page, table_idx, header, coalesce(k > 1 AND h = header, false) AS repeats FROM f")
def w2(spark, d):
    li = _read(spark, d, "lineitem")
    head = F.when(F.col("l_returnflag") == "R", F.array(F.lower("l_linestatus")))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("table_idx"), head.alias("headers"))
    return headers.carried_header(t).select("doc_id", "page", "table_idx", F.get("header", 0).alias("header"), "repeats")


@query("S6_sheet_rows", f"WITH {_ROWS_SQL} SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS row_idx FROM orders UNION ALL SELECT doc_id, row_idx FROM li")
def s6(spark, d):
    return headers.sheet_rows(_grid(spark, d)).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"))


@query("F24_rendered", f"WITH {_ROWS_SQL}, b AS (SELECT doc_id, string_agg('| ' || concat_ws(' | ', n, 'part number ' || p, q, 'in stock', s || '.00') || ' |', chr(10) ORDER BY row_idx) AS body FROM li GROUP BY doc_id) SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '| No | Item Description | Qty | Item Description | Unit Price |' WHEN 1 THEN '| Sr.No | Remarks | Quantity Required |  | Actions |' ELSE '|  | x | y | z | Details |' END || chr(10) || '| --- | --- | --- | --- | --- |' || coalesce(chr(10) || body, '') AS markdown FROM orders LEFT JOIN b ON o_orderkey = doc_id")
def f24(spark, d):
    return headers.rendered(_grid(spark, d)).select("doc_id", "markdown")


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(model), '{text.any_of(w)}') THEN '{c}'" for c, w in rules.CLASSES) + " ELSE 'General' END"


@query("X6_product_class", f"WITH {_CATALOGUE_SQL} SELECT {_CLASS_SQL} AS product_class, count(*) AS products FROM cat GROUP BY 1")
def x6(spark, d):
    return _catalogue(spark, d).groupBy(headers.product_class(F.col("model")).alias("product_class")).agg(F.count("*").alias("products"))


@query("J9_assigned", f"WITH {_CATALOGUE_SQL}, k AS (SELECT brand, CASE WHEN bool_or(category = 'seating') THEN 'Office Seating' ELSE 'Others' END AS name FROM cat GROUP BY brand) SELECT position, CASE WHEN name = 'Office Seating' AND category = 'seating' THEN name WHEN {_CLASS_SQL} = 'Desking' THEN 'Desking' ELSE 'General' END AS assigned FROM cat JOIN k USING (brand)")
def j9(spark, d):
    c = _catalogue(spark, d)
    first = F.when(F.bool_or(F.col("category") == "seating"), "Office Seating").otherwise("Others")
    names = c.groupBy("brand").agg(F.array(first, F.lit("General"), F.lit("Desking")).alias("n"))
    rows = c.withColumn("category", F.when(F.col("category") == "seating", "seating").otherwise("zz"))
    return catalogue.assigned(rows, names.select("brand", F.posexplode("n").alias("position", "name"))).select("position", "assigned")


@query("A9_refetch", f"WITH {_CATALOGUE_SQL} SELECT brand, CAST(count(*) FILTER (position % 2 = 0) AS BIGINT) AS products, count(*) AS categories, count(*) FILTER (position % 2 = 0) = 0 OR bool_or(position % 97 = 0) AS refetch FROM cat GROUP BY brand")
def a9(spark, d):
    c = _catalogue(spark, d)
    return catalogue.refetch(c.select("brand", "category", F.when(F.col("position") % 2 == 0, 1).otherwise(0).alias("products"), (F.col("position") % 97 == 0).alias("needs_script")))


@query("A8_outcomes", "SELECT count(*) FILTER (l_linestatus = 'F') AS successes, count(*) FILTER (l_linestatus <> 'F') AS failures, CAST(coalesce(sum(l_linenumber) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS products FROM lineitem")
def a8(spark, d):
    return catalogue.outcomes(_read(spark, d, "lineitem").select((F.col("l_linestatus") == "F").alias("success"), F.col("l_linenumber").alias("products")))


@query("A12_collections", f"WITH {_CATALOGUE_SQL} SELECT brand, tier, category || ' > ' || subcategory AS collection, count(*) AS n, arg_min(model, position) AS first_model FROM cat GROUP BY ALL")
def a12(spark, d):
    first = F.get("products", 0)
    pieces = catalogue.collection_pieces(_catalogue(spark, d))
    return pieces.groupBy("brand", "tier", "collection").agg(F.sum(F.size("products")).alias("n"), F.min_by(first["model"], first["position"]).alias("first_model"))


@query("X19_listing", f"WITH {_CATALOGUE_SQL} SELECT brand AS page_id, 'http://shop/product/' || position AS target, model AS title FROM cat WHERE NOT regexp_matches(lower(model), '{text.any_of(rules.LISTING_SKIP)}')")
def x19(spark, d):
    link = F.concat(F.lit("- ["), "model", F.lit("](http://shop/product/"), F.col("position").cast("string"), F.lit(")"))
    page = _catalogue(spark, d).groupBy(F.col("brand").alias("page_id")).agg(F.array_join(F.collect_list(link), "\n").alias("markdown"))
    return pages.listing_products(page)


_HOST, _PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))", "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"


@query("X29_site_kind", f"SELECT page_id, CASE WHEN contains({_HOST}, 'architonic.com') THEN 'portal' WHEN contains({_PATH}, '/collections/') OR (contains({_PATH}, '/b/') AND contains({_PATH}, '/products')) THEN 'collections' WHEN ({_HOST} LIKE '%.it' AND regexp_matches({_PATH}, 'prodotti|products|collezioni|collections')) OR regexp_matches({_HOST}, '{text.any_of(pages.ITALIAN_MAKERS)}') THEN 'italian' ELSE 'other' END AS kind FROM pages")
def x29(spark, d):
    return _read(spark, d, "pages").select("page_id", pages.site_kind(F.col("url")).alias("kind"))


@query("X24_features", f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(html, '(?is)<nav[^>]*>.*?</nav>', '', 'g'), '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: length(x) > 2)[1:10], '|') AS features FROM pages")
def x24(spark, d):
    return pages.features(_read(spark, d, "pages")).select("page_id", F.array_join("features", "|").alias("features"))


@query("W10_split_repaired", "SELECT l_orderkey AS doc_id, l_linenumber AS n, concat_ws('|', l_linenumber, 'part number ' || l_partkey || ' in stock', '', l_returnflag, floor(l_quantity)::BIGINT) AS cells FROM lineitem")
def w10(spark, d):
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("part number "), F.col("l_partkey").cast("string")), F.lit("in stock"), "l_returnflag", F.floor("l_quantity").cast("string"))
    head = F.array(*map(F.lit, ["No", "Item Description", "", "", "Qty"]))
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), head.alias("headers"), cells.alias("cells"))
    return headers.split_repaired(rows).select("doc_id", "n", F.array_join("cells", "|").alias("cells"))


@query("S5_layout_blocks", "SELECT doc_id, md5(coalesce(text, '')) AS content, coalesce(text, '') <> '' AND (doc_id % 3 = 0 OR regexp_matches(lower(coalesce(text, '')), '<table|<tr>|<td>') OR len(regexp_extract_all(coalesce(text, ''), '[|]')) > 2) AS is_table FROM documents")
def s5(spark, d):
    label = F.when(F.col("doc_id") % 3 == 0, "Table").otherwise("text")
    page = F.array(F.struct(F.struct(F.array(F.struct(label.alias("block_label"), F.col("text").alias("block_content"))).alias("parsing_res_list")).alias("prunedResult")))
    shapes = [F.to_json(F.struct(page.alias(k))) for k in io.PAGE_KEYS] + [F.to_json(F.struct(F.struct(page.alias("pages")).alias("result"))), F.to_json(page)]
    json = F.coalesce(*[F.when(F.col("doc_id") % len(shapes) == i, s) for i, s in enumerate(shapes)])
    blocks = io.layout_blocks(_docs(spark, d).select("doc_id", json.alias("json")))
    return blocks.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"), "is_table")


@query("X15_organised", f"WITH {_CATALOGUE_SQL}, m AS (SELECT *, CASE WHEN position % 4 = 0 THEN 'General' ELSE subcategory END AS sub, CASE WHEN position % 10 > 0 THEN split_part(model, ' ', 1) WHEN position % 20 = 10 THEN 'Nova Nr ' || position END AS name FROM cat WHERE position % 30 <> 7), k AS (SELECT brand, tier, category, sub, name, max(position) AS position FROM m WHERE name IS NOT NULL GROUP BY ALL) SELECT position, name AS model, sub AS subcategory FROM k QUALIFY sub <> 'General' OR NOT bool_or(sub <> 'General') OVER (PARTITION BY category, name)")
def x15(spark, d):
    c = _catalogue(spark, d)
    n = F.col("position")
    word = F.split_part("model", F.lit(" "), F.lit(1))
    model = F.when(n % 10 == 0, " ").when(n % 30 == 7, "Select options").when(n % 30 == 8, F.concat(word, F.lit(" (Contact for price)"))).otherwise(word)
    url = F.when(n % 20 == 10, F.concat(F.lit("http://shop/p/nova-nr-"), n.cast("string"), F.lit("/"))).otherwise(F.col("source_url"))
    return catalogue.organised(c.withColumns({"model": model, "source_url": url, "subcategory": F.when(F.col("position") % 4 == 0, "General").otherwise(F.col("subcategory"))})).select("position", "model", "subcategory")


@query("X12_flattened", f"WITH {_CATALOGUE_SQL} SELECT brand, category || ' > ' || subcategory AS collection, position, model FROM cat")
def x12(spark, d):
    nested = catalogue.collection_pieces(_catalogue(spark, d)).select("brand", "tier", F.array(F.struct("collection", "products")).alias("collections"))
    return io.flattened(nested).select("brand", "collection", "position", "model")
