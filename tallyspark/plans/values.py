"""Registered queries about single values, cells, links and tables of pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import rules, text
from tallyspark.operators import catalogue, costing, headers, items, layout, pages, tables
from tallyspark.plans.catalog import _dealt, _read, query
from tallyspark.sources import io


def _cat(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _key():
    return F.col("p_partkey")


def _no():
    return _key().cast("string")


def _name():
    return F.col("p_name")


def _case(n, *values):
    """The value at ``p_partkey`` modulo ``n``; the last one for all that follow."""
    out = F.when(_key() % n == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(_key() % n == i, v)
    return out.otherwise(values[-1])


def _cells(spark, d):
    """Line items as cells under Total, Amount (below zero for odd parts), Total_original and Item; every seventh line is a sum."""
    cell = lambda h, t: F.struct(F.lit(h).alias("header"), t.cast("string").alias("text"))
    amount = F.when(F.col("l_partkey") % 2 == 0, "7").otherwise("-5")
    item = F.when(F.col("l_linenumber") == 7, "Grand Total").otherwise("desk")
    rows = F.array(cell("Total", F.floor("l_quantity")), cell("Amount", amount), cell("Total_original", F.lit("99")), cell("Item", item))
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row_no"), F.inline(rows))


@query("A2_excel_subtotal", "SELECT l_orderkey AS doc_id, sum(floor(l_quantity))::DOUBLE AS subtotal FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def a2(spark, d):
    return costing.cell_subtotal(_cells(spark, d), "excel").select("doc_id", "subtotal")


@query("A3_browser_subtotal", "SELECT l_orderkey AS doc_id, sum(greatest(floor(l_quantity), 0) + CASE WHEN l_partkey % 2 = 0 THEN 7 ELSE 0 END)::DOUBLE AS subtotal FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def a3(spark, d):
    return costing.cell_subtotal(_cells(spark, d), "browser").select("doc_id", "subtotal")


@query("F1_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey || '5')::DOUBLE END AS number, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey || '5')::DOUBLE ELSE 0 END AS or_zero FROM part")
def f1(spark, d):
    x = F.when(_key() % 5 > 0, _cat("QAR ", _no(), ",5")).otherwise("n/a")
    return _read(spark, d, "part").select("p_partkey", text.number(x).alias("number"), text.number_or_zero(x).alias("or_zero"))


@query("F3_price", "SELECT p_partkey, p_partkey + 0.25::DOUBLE AS price FROM part")
def f3(spark, d):
    x = _cat(_name(), " from ", F.floor(_key() / 1000).cast("string"), ",", F.lpad((_key() % 1000).cast("string"), 3, "0"), ".25 to 9")
    return _read(spark, d, "part").select("p_partkey", text.price(x).alias("price"))


@query("F5_range_mid", "SELECT p_partkey, (p_size * 2 + p_partkey % 7) / 2.0::DOUBLE AS mid FROM part")
def f5(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.range_mid(_cat(F.col("p_size").cast("string"), "-", (F.col("p_size") + _key() % 7).cast("string"))).alias("mid"))


@query("F6_price_range", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Contact for price' ELSE floor(p_retailprice)::BIGINT || '-' || floor(p_retailprice * 1.5::DOUBLE)::BIGINT END AS price_range FROM part")
def f6(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.price_range(F.when(_key() % 10 == 0, 0.0).otherwise(F.col("p_retailprice"))).alias("price_range"))


@query("F8_image_sources", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'imgs/' || p_partkey || '.png' ELSE 'a.jpg|imgs/' || p_partkey || '.png' END AS images FROM part")
def f8(spark, d):
    one = _cat("<img alt='x' src='imgs/", _no(), ".png'>")
    return _read(spark, d, "part").select("p_partkey", F.array_join(text.image_sources(_case(3, _name(), one, _cat('<img src="a.jpg">', one))), "|").alias("images"))


@query("F11_clean_title", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '-x' END AS strict, p_name AS loose FROM part")
def f11(spark, d):
    x = _case(2, _cat(_name(), " ACME (oak) - buy"), _cat(_name(), "-x"))
    return _read(spark, d, "part").select("p_partkey", text.clean_title(x, "Acme").alias("strict"), text.clean_title(x, "Acme", strict=False).alias("loose"))


@query("F16_english_url", "SELECT page_id, CASE WHEN contains(url, '/it/') THEN replace(url, '/it/', '/en/') WHEN contains(url, '?') THEN url || '&lang=en' ELSE url || '?lang=en' END AS url FROM pages")
def f16(spark, d):
    return _read(spark, d, "pages").select("page_id", text.english_url(F.col("url")).alias("url"))


@query("F17_first_url", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'http://i/' || p_partkey WHEN 1 THEN 'https://t/' || p_partkey END AS url FROM part")
def f17(spark, d):
    made = lambda image, thumb: F.create_map(F.lit("size"), F.lit("9"), F.lit("thumb"), thumb, F.lit("image"), image)
    values = _case(3, made(_cat("http://i/", _no()), _cat("https://t/", _no())), made(F.lit("none"), _cat("https://t/", _no())), made(F.lit(""), F.lit("x")))
    return _read(spark, d, "part").select("p_partkey", text.first_url(values, ["image", "large"]).alias("url"))


@query("F18_brand", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Vitra' WHEN 1 THEN 'Brand' ELSE 'none' END AS brand FROM part")
def f18(spark, d):
    x = _case(3, _cat("Desk by VITRA ", _name()), _cat(_name(), " ", F.col("p_brand")), _name())
    return _read(spark, d, "part").select("p_partkey", text.brand_in(x, rules.KNOWN_MAKERS, "none").alias("brand"))


@query("F20_safe_key", "SELECT p_partkey, regexp_replace(replace(p_name || ' ' || p_brand, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') AS key FROM part")
def f20(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.safe_key(_cat(_name(), " ", F.col("p_brand"))).alias("key"))


@query("F25_listed", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS items FROM part")
def f25(spark, d):
    return _read(spark, d, "part").select("p_partkey", F.array_join(text.listed(_cat(_name(), " , ", F.col("p_brand"), ";; ", F.col("p_type"))), "|").alias("items"))


@query("P15_price_headers", f"SELECT p_partkey, regexp_matches(lower(CASE p_partkey % 4 WHEN 0 THEN 'Unit Rate' WHEN 1 THEN 'Total Price' WHEN 2 THEN 'Amount (AED)' ELSE p_name END), '{text.any_of(rules.PRICE_HEADERS)}') AS is_price FROM part")
def p15(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.is_price_header(_case(4, F.lit("Unit Rate"), F.lit("Total Price"), F.lit("Amount (AED)"), _name())).alias("is_price"))


@query("P2_blank_rows", "SELECT p_partkey, p_name AS cell FROM part WHERE p_partkey % 3 > 0")
def p2(spark, d):
    cells = F.when(_key() % 3 == 0, F.array(F.lit("<b> </b>"), F.lit("&nbsp;\t"))).otherwise(F.array(_name(), F.lit("")))
    return layout.without_blank_rows(_read(spark, d, "part").select("p_partkey", cells.alias("cells"))).select("p_partkey", F.get("cells", F.lit(0)).alias("cell"))


@query("P9_padded", "SELECT p_partkey, 'a b|' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|' ELSE '||' END AS cells FROM part")
def p9(spark, d):
    rows = _read(spark, d, "part").select("p_partkey", F.array(F.lit(" a    b "), _name()).alias("cells"), (_key() % 2 + 3).cast("int").alias("width"))
    return layout.padded(rows).select("p_partkey", F.array_join("cells", "|").alias("cells"))


@query("W5_serial", "SELECT p_partkey, CASE WHEN p_partkey * 7 BETWEEN 1 AND 10000 THEN (p_partkey * 7)::INTEGER END AS serial FROM part")
def w5(spark, d):
    return _read(spark, d, "part").select("p_partkey", tables.serial(_cat("No. ", (_key() * 7).cast("string"), "/3")).alias("serial"))


@query("S3_html_grid", "SELECT p_partkey AS doc_id, 0 AS table_idx, 0 AS row_idx, 'No|Item' AS cells FROM part UNION ALL SELECT p_partkey, 0, 1, p_partkey || '|' || p_name FROM part UNION ALL SELECT p_partkey, 1, 0, p_brand FROM part")
def s3(spark, d):
    html = _cat("<p>x</p><table class='a'><tr><th>No</th><th>Item</th></tr>\n<TR><td>", _no(), "</td><td><b>", _name(), "</b></td></TR></table><table><tr><td>", F.col("p_brand"), "</td></tr></table>")
    return tables.html_grid(_read(spark, d, "part").select(_key().alias("doc_id"), html.alias("html"))).select("doc_id", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("S4_delimited", "SELECT p_partkey AS doc_id, 1 AS row_idx, 'No|Item' AS cells FROM part UNION ALL SELECT p_partkey, 2, p_partkey || '|' || p_name FROM part")
def s4(spark, d):
    cut = _case(3, F.lit("\t"), F.lit(" | "), F.lit("   "))
    x = _cat("title\nNo", cut, "Item\n", _no(), cut, _name(), "\n")
    return tables.delimited_grid(_read(spark, d, "part").select(_key().alias("doc_id"), x.alias("text"))).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query(
    "S6_live_columns",
    """SELECT p_partkey AS doc_id, 2 AS row_idx, CASE WHEN p_partkey % 2 = 0 THEN 'No|Description|Image|Qty' ELSE 'No|Image|Qty' END AS cells FROM part
UNION ALL SELECT p_partkey, 4, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_name ELSE '' END || '||2' FROM part""",
)
def s6(spark, d):
    row = lambda i, *cells: F.struct(F.lit(i).alias("row_idx"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells"))
    rows = F.array(row(0, "Offer", "", "", "", ""), row(1, "Item", "of", "", "", ""), row(2, "No", "Description", "Image", "Remarks", "Qty"), row(3, "", " ", "", "", ""), row(4, _no(), F.when(_key() % 2 == 0, _name()).otherwise(""), "", " ", "2"))
    grid = _read(spark, d, "part").select(_key().alias("doc_id"), F.lit(0).alias("table_idx"), F.inline(rows))
    return headers.live_columns(grid).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("X13_split", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Chairs' WHEN 1 THEN p_type ELSE 'A > B > C' END AS category, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'general' END AS subcategory FROM part")
def x13(spark, d):
    x = _case(3, _cat("Chairs > ", _name(), "\nmore"), F.col("p_type"), F.lit("A > B > C"))
    return catalogue.split_collections(_read(spark, d, "part").withColumn("collection", x)).select("p_partkey", "category", "subcategory")


_TREE_SQL = "t AS (SELECT p_partkey, p_brand AS category, CASE WHEN p_size % 2 = 0 AND p_brand LIKE '%1%' THEN p_type WHEN p_size % 7 = 1 THEN p_brand END AS subcategory FROM part WHERE p_size % 7 <> 1 OR p_brand LIKE '%1%')"


@query("X14_tree", f"WITH {_TREE_SQL} SELECT p_partkey, category, subcategory FROM (SELECT *, max((subcategory IS NOT NULL)::INT) OVER (PARTITION BY category) AS h FROM t) WHERE (subcategory IS NOT NULL OR h = 0) AND category IS DISTINCT FROM subcategory")
def x14(spark, d):
    one = F.contains("p_brand", F.lit("1"))
    sub = F.when((F.col("p_size") % 2 == 0) & one, F.col("p_type")).when(F.col("p_size") % 7 == 1, F.col("p_brand"))
    rows = _read(spark, d, "part").where((F.col("p_size") % 7 != 1) | one)
    return catalogue.tree(rows.select("p_partkey", F.col("p_brand").alias("category"), sub.alias("subcategory")))


@query("X22_crumbs", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS category, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS subcategory FROM part")
def x22(spark, d):
    trail = _cat('<div class="top breadcrumb"><a href="/">Home</a> / <a href="/c">', F.col("p_type"), '</a><a href="/s"><b>', _name(), "</b></a></div>")
    return pages.crumbs(_read(spark, d, "part").select(_key().alias("page_id"), _case(2, trail, F.lit("<p>none</p>")).alias("html"))).select("page_id", "category", "subcategory")


@query(
    "X27_subcategory_links",
    "SELECT p_partkey AS page_id, p_name AS name, 'http://h/chairs/item-' || p_partkey AS target FROM part UNION ALL SELECT p_partkey, p_type, 'http://h/category/' || p_partkey FROM part",
)
def x27(spark, d):
    a = lambda href, name: _cat('<a href="', href, '">', name, "</a>")
    html = _cat("<h1>Chairs</h1>", a("/chairs/all", "Chairs"), a("/chairs/", "Again"), a(_cat("/chairs/item-", _no()), _name()), a("/chairs/later", _name()), a("/other", "Other"), a(_cat("/category/", _no()), F.col("p_type")))
    return pages.subcategory_links(_read(spark, d, "part").select(_key().alias("page_id"), F.lit("http://h/chairs?x=1").alias("url"), html.alias("html")))


@query(
    "X28_collection_links",
    "SELECT p_partkey AS page_id, 'typologies' AS kind, 'http://h/typologies/big-desks' AS target, 'Big Desks' AS name FROM part UNION ALL SELECT p_partkey, 'collection', 'http://h/collection/nova/' || p_partkey, p_name FROM part",
)
def x28(spark, d):
    html = _cat('<a href="/typologies/big-desks"></a><a href="/collection/nova">x</a><a href="/collection/nova/', _no(), '">', _name(), "</a>")
    return pages.collection_links(_read(spark, d, "part").select(_key().alias("page_id"), F.lit("http://h/a").alias("url"), html.alias("html")))


@query("X30_link_title", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE 'Nova Chair' END AS title FROM part")
def x30(spark, d):
    heading, data = F.when(_key() % 4 == 1, F.col("p_type")).otherwise(" "), F.when(_key() % 4 == 2, F.col("p_brand"))
    shown = F.when(_key() % 4 == 0, _name()).otherwise("View")
    return _read(spark, d, "part").select("p_partkey", pages.link_title(shown, heading, data, F.lit("http://h/acme-nova-chair-20111?x=1"), F.lit("image"), "acme").alias("title"))


@query("J11_found_image", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'imgs/' || p_partkey || '.png' WHEN 1 THEN 'imgs/first.png' END AS image FROM part")
def j11(spark, d):
    images = F.when(_key() % 3 < 2, F.array(F.lit("imgs/first.png"), _cat("imgs/", _no(), ".png"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, d, "part").select("p_partkey", catalogue.found_image(F.when(_key() % 3 == 0, _cat("/", _no(), ".png")).otherwise(""), images).alias("image"))


@query("X26_path_links", "SELECT p_partkey AS page_id, 'http://h/product/' || p_partkey AS target, 0 AS pos FROM part UNION ALL SELECT p_partkey, 'http://h/it/scheda-' || p_partkey, 2 FROM part")
def x26(spark, d):
    html = _cat("<a class=x href='/product/", _no(), "'>a</a><a href=/product-category/product/", _no(), '>b</a><a href="/it/scheda-', _no(), '"><b>c</b></a><a data-href="/p/1" name="n">d</a><a HREF = "/product/', _no(), '">again</a><a href="/other">e</a>')
    return pages.product_links(_read(spark, d, "part").select(_key().alias("page_id"), F.lit("http://h/a").alias("url"), html.alias("html")))


@query(
    "W1_merged_pages",
    """WITH t AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page, l_orderkey % 3 AS kind, (l_orderkey + l_linenumber) % 3 AS k FROM lineitem),
n AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY doc_id ORDER BY page) = 1 AND (kind <> 1 OR k = 1) THEN 0 ELSE 1 END AS fresh FROM t)
SELECT doc_id, page, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS merged_id, fresh = 0 AND kind = 2 AS header_is_data FROM n""",
)
def w1(spark, d):
    heads = lambda *h: F.array(*map(F.lit, h))
    kind, k = F.col("doc_id") % 3, (F.col("doc_id") + F.col("page")) % 3
    same = heads("No", "Item", "Qty")
    turns = F.when(k == 0, same).when(k == 1, heads("", " ", "")).otherwise(heads("Ref", "Name"))
    t = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    t = t.withColumns({"table_idx": F.lit(0), "headers": F.when(kind == 0, same).when(kind == 1, turns).otherwise(heads("1", "Desk", "20.50"))})
    return tables.merge_pages(t).select("doc_id", "page", "merged_id", "header_is_data")


@query(
    "W13_word_grid",
    """WITH w AS (SELECT l_orderkey AS doc_id, 100 + 20.0::DOUBLE * l_linenumber AS top, unnest([1, 2, 3])::BIGINT AS column_no, unnest([l_linenumber::VARCHAR, 'oak', floor(l_quantity)::BIGINT::VARCHAR]) AS text, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT doc_id, top, column_no, string_agg(text, ' ' ORDER BY text) AS text FROM w WHERE 3 * n >= 10 GROUP BY doc_id, top, column_no""",
)
def w13(spark, d):
    word = lambda x0, t: F.struct(F.lit(x0).alias("x0"), t.cast("string").alias("text"))
    row = F.array(word(30.0, F.col("l_linenumber")), word(80.0, F.lit("oak")), word(200.0, F.floor("l_quantity")))
    words = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 20 + 100.02).alias("top"), F.inline(row))
    return layout.word_grid(words).select("doc_id", "top", "column_no", "text")


@query(
    "J5_overlapped",
    """WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem), x AS (SELECT a.doc_id, a.n, b.n AS below FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.n = a.n + 1)
SELECT doc_id, n * 3 AS img_id, coalesce(below, n) AS row_idx FROM x UNION ALL SELECT doc_id, n * 3 + 1, coalesce(below, n) FROM x UNION ALL SELECT doc_id, n * 3 + 2, n FROM x""",
)
def j5(spark, d):
    r = _dealt(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("n")).distinct()
    boxes = r.select("doc_id", "page", F.col("n").alias("row_idx"), (F.col("n") * 100).alias("y0"), (F.col("n") * 100 + 60).alias("y1"))
    image = lambda k, y0, y1: F.struct((F.col("n") * 3 + k).alias("img_id"), (F.col("n") * 100 + y0).alias("y0"), (F.col("n") * 100 + y1).alias("y1"))
    images = r.select("doc_id", "page", F.inline(F.array(image(0, 50, 120), image(1, 72, 92), image(2, 62, 70))))
    return items.images_by_overlap(images, boxes).select("doc_id", "img_id", "row_idx")


@query("U6_similar_tables", "SELECT p_partkey AS doc_id, 1 AS table_idx FROM part WHERE p_partkey % 2 = 0")
def u6(spark, d):
    table = lambda i, *cells: F.struct(F.lit(i).alias("table_idx"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells"))
    rows = F.array(table(0, "Oak desk", "two of", "them"), table(1, _case(2, F.lit("OAK desk"), F.lit("w x y")), "two of", _case(2, F.lit("them"), F.lit("z"))), table(2, "quite another", "one"))
    grid = _read(spark, d, "part").select(_key().alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("row_idx"), F.inline(rows))
    return layout.similar_tables(grid).select("doc_id", "table_idx")


@query(
    "J13_linked_models",
    "SELECT a.site, a.model, arg_min('/' || b.p_partkey, b.p_partkey) AS target FROM (SELECT DISTINCT p_brand AS site, p_name AS model FROM part) a JOIN part b ON a.site = b.p_brand AND contains(b.p_name, a.model) GROUP BY ALL",
)
def j13(spark, d):
    part = _read(spark, d, "part")
    found = part.select(F.col("p_brand").alias("site"), _key().alias("page_id"), F.lit(0).alias("pos"), _cat("/", _no()).alias("target"), _cat("see the ", F.upper(_name())).alias("text"))
    return pages.linked_models(part.select(F.col("p_brand").alias("site"), _name().alias("model")), found)


@query(
    "S10_text_rows",
    """SELECT p_partkey AS doc_id, 0 AS table_idx, 0 AS row_idx, p_name AS cells FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 0, 0, p_brand FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 0, 2, p_type FROM part WHERE p_partkey % 3 > 0""",
)
def s10(spark, d):
    part = _read(spark, d, "part")
    grid = part.where("p_partkey % 3 = 0").select(_key().alias("doc_id"), F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), F.array("p_name").alias("cells"))
    texts = part.select(_key().alias("doc_id"), _cat(F.col("p_brand"), "\n \n", F.col("p_type")).alias("text"))
    return io.with_text_rows(grid, texts).select("doc_id", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))
