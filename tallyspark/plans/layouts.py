"""Registered query about brand documents of four layouts, made one per part, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.catalog import _read, query
from tallyspark.sources import brands


@query(
    "X12_four_layouts",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS f, p_brand AS brand, p_type AS t, p_name AS n FROM part)
SELECT brand, t AS category, 'General' AS subcategory, n AS model, k + 0.5::DOUBLE AS price, 'Contact for price' AS price_range, '' AS description, '' AS product_id, 's/' || k AS url, '' AS image_url, 'oak, blue' AS features, 'categories' AS layout, 0 AS position FROM p WHERE f = 0
UNION ALL SELECT brand, t, 'General', n || ' 2', 7, '7-9', '', k || '', '', 'i.png', 'one, two', 'categories', 1 FROM p WHERE f = 0
UNION ALL SELECT brand, t, 'general', n, NULL, 'Contact for price', 'about', '', 'u/' || k, '', '', 'collections', 0 FROM p WHERE f = 1
UNION ALL SELECT brand, t, 'general', n || ' 2', k, 'Contact for price', '', '', '', '', '', 'collections', 1 FROM p WHERE f = 1
UNION ALL SELECT brand, t, n, n || ' 3', NULL, 'Contact for price', '', '', '', '', '', 'all_products', 0 FROM p WHERE f = 2
UNION ALL SELECT brand, 'General', 'General', n, NULL, 'Contact for price', '', '', '', '', '', 'all_products', 0 FROM p WHERE f = 2
UNION ALL SELECT brand, t, brand, n || ' ' || x, NULL, 'Contact for price', '', '', '', '', '', 'category_tree', x FROM p, (VALUES (0), (1)) v(x) WHERE f = 3
UNION ALL SELECT brand, t, 'General', n, NULL, 'Contact for price', '', '', '', '', '', 'categories', 0 FROM p WHERE f = 3
UNION ALL SELECT brand, t, 'Oak', n || ' ' || x, NULL, 'Contact for price', '', '', '', '', '', 'categories', x FROM p, (VALUES (0), (1)) v(x) WHERE f = 3""",
)
def x12_layouts(spark, d):
    """Products of lists, objects and texts; prices as numbers and texts, features as lists and texts."""
    k, t, n, b = F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_name"), F.col("p_brand")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    f = F.col("p_partkey") % 4
    categories = text('{"categories":{"', t, '\\n10 items":{"products":[{"model":"', n, '","price":', k, '.5,"source_url":"s/', k, '","features":["oak","blue"]},{"name":"', n, ' 2","price":"7","price_range":"7-9","product_id":', k, ',"image_url":"i.png","features":"one, two"},"text"]},"Odd":5}}')
    collections = text('{"collections":{"', t, '":{"products":[{"name":"', n, '","model":"x","price":null,"description":"about","url":"u/', k, '"},{"model":"', n, ' 2","price":', k, '}]},"Bad":{"products":{}}}}')
    loose = text('{"all_products":[{"name":"', n, ' 3","category":"', t, '","subcategory":"', n, '"},7,{"model":"', n, '"}]}')
    tree = text('{"category_tree":{"', t, '":{"subcategories":{"', b, '":{"products":[{"name":"', n, ' 0"},{"name":"', n, ' 1"}]}}}},"categories":{"', t, '":{"url":"z","List":["', n, '"],"Oak":{"products":[{"model":"', n, ' 0"},{"model":"', n, ' 1"}]}}}}')
    doc = F.when(f == 0, categories).when(f == 1, collections).when(f == 2, loose).otherwise(tree)
    docs = _read(spark, d, "part").select(b.alias("brand"), F.lit("mid_range").alias("tier"), F.try_parse_json(doc).alias("doc"))
    return brands.products(docs).drop("tier")
