"""Registered queries about crawled links, listings and pages of words, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import strip_tags
from tallyspark.operators import crawl, pages
from tallyspark.plans.catalog import _ANCHOR_SQL, _dealt, _read, _strip_sql, query


@query(
    "P21_category_links",
    f"""WITH n AS (SELECT page_id, html AS h FROM pages), l AS (SELECT page_id, unnest({_ANCHOR_SQL.format(1)}) AS href, unnest({_ANCHOR_SQL.format(2)}) AS txt FROM n),
t AS (SELECT page_id, href, lower(href) AS h, lower({_strip_sql('txt')}) AS t FROM l)
SELECT page_id, href, NOT (h = '' OR t = '' OR regexp_matches(h, '{crawl.NO_CATEGORY}') OR regexp_matches(t, '{crawl.NO_CATEGORY}')) AND (regexp_matches(h, '{crawl.CATEGORY_WORDS}') OR length(t) BETWEEN 2 AND 50) AS is_category FROM t""",
)
def p21(spark, d):
    return pages.links(_read(spark, d, "pages")).select("page_id", "href", crawl.is_category_link(F.col("href"), strip_tags(F.col("text"))).alias("is_category"))


@query("F13_url_id", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_partkey::VARCHAR ELSE replace(p_name, ' ', '-') END AS url_id FROM part")
def f13(spark, d):
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("p/oak-desk-"), n, F.lit("/"))).when(k == 1, F.concat(F.lit("products/"), n)).when(k == 2, F.concat(F.lit("product/desk-"), n, F.lit("/")))
    url = F.concat(F.lit("http://shop/"), F.coalesce(path, F.concat(F.lit("item/"), F.replace("p_name", F.lit(" "), F.lit("-")))))
    return _read(spark, d, "part").select("p_partkey", crawl.url_id(url).alias("url_id"))


@query(
    "R5_new_by_page",
    """WITH p AS (SELECT l_orderkey AS site, l_linenumber AS page, l_partkey % 3 AS u FROM lineitem), f AS (SELECT site, u, min(page) AS page FROM p GROUP BY ALL),
c AS (SELECT s.site, s.page, count(f.u) AS new FROM (SELECT DISTINCT site, page FROM p) s LEFT JOIN f ON s.site = f.site AND s.page = f.page GROUP BY ALL)
SELECT site, page, new, coalesce(page < min(page) FILTER (new = 0) OVER (PARTITION BY site), true) AS wanted FROM c""",
)
def r5(spark, d):
    listed = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).alias("source_url"))
    return crawl.new_by_page(listed)


@query(
    "W14_table_region",
    "SELECT l_orderkey AS doc_id, 100::DOUBLE AS header_y, 95::DOUBLE AS top, max(120 + 20 * l_linenumber)::DOUBLE AS bottom, 10::DOUBLE AS left, 320::DOUBLE AS right FROM lineitem GROUP BY 1 HAVING 3 * count(*) + 2 >= 10",
)
def w14(spark, d):
    li = _dealt(spark, d, "lineitem", "l_orderkey")
    word = lambda x0, x1, top, text: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), top.cast("double").alias("top"), text.cast("string").alias("text"))
    y = F.col("l_linenumber") * 20 + 100
    row = li.select(F.col("l_orderkey").alias("doc_id"), F.inline(F.array(word(30.0, 40.0, y, F.col("l_linenumber")), word(80.0, 160.0, y, F.lit("oak")), word(200.0, 220.0, y, F.floor("l_quantity")))))
    head = li.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.inline(F.array(word(30.0, 60.0, F.lit(100), F.lit("Item")), word(200.0, 300.0, F.lit(100), F.lit("Quantity")))))
    box = {c: F.lit(v) for c, v in (("page", 1), ("page_left", 0.0), ("page_top", 0.0), ("page_right", 600.0), ("page_bottom", 800.0))}
    return crawl.table_region(row.unionByName(head).withColumns(box)).select("doc_id", "header_y", "top", "bottom", "left", "right")


@query(
    "S8_crawl_products",
    """WITH p AS (SELECT *, p_partkey % 3 AS k FROM part)
SELECT p_partkey AS page_id, 'http://shop/chairs/oak/product/item-' || p_partkey AS source_url, p_name || ' by' AS model, 'http://i/' || p_partkey || '.png' AS image_url, p_partkey || '.50' AS price, 'about ' || p_brand AS description, 'Chairs > Oak' AS collection FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 'http://shop/desks/product/' || p_partkey, p_name, 'http://i/' || p_partkey || '.jpg', '12', p_type, 'Desks > ' || p_partkey FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 'http://shop/product/' || x || '-' || p_partkey, p_name || ' ' || x, NULL, NULL, NULL, 'Product Category > Sofas' FROM p, (VALUES ('one'), ('two')) v(x) WHERE k = 2""",
)
def s8(spark, d):
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    link = lambda x: F.concat(F.lit("["), F.col("p_name"), F.lit(f" {x}](http://shop/product/{x}-"), n, F.lit(")"))
    url = F.when(k == 0, F.concat(F.lit("http://shop/chairs/oak/product/item-"), n)).when(k == 1, F.concat(F.lit("http://shop/desks/product/"), n)).otherwise(F.concat(F.lit("http://shop/product-category/sofas/"), n))
    prose = F.concat(F.lit("# "), F.col("p_name"), F.lit("\n\n"), F.col("p_type"), F.lit("\n\nUSD 12 ![a](http://i/"), n, F.lit(".jpg)"))
    text = F.when(k == 0, F.concat(F.lit("Price: "), n, F.lit(".50"))).when(k == 1, prose).otherwise(F.concat_ws(" ", link("one"), link("two"), link("one"), F.lit("[Next page](http://shop/product-category/sofas/2)")))
    meta = F.create_map(F.lit("title"), F.concat("p_name", F.lit(" by Acme | Shop")), F.lit("ogImage"), F.concat(F.lit("http://i/"), n, F.lit(".png")), F.lit("description"), F.concat(F.lit("about "), F.col("p_brand")))
    crawl_pages = _read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), url.alias("url"), text.alias("markdown"), F.when(k == 0, meta).alias("metadata"))
    return crawl.crawled_products(crawl_pages, "Acme").select("page_id", "source_url", "model", "image_url", "price", "description", "collection")
