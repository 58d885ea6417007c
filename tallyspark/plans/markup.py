"""Registered queries over parsed HTML, with their SQL twins. Pages with products and menus are made from ``part``, one per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import any_of
from tallyspark.operators import crawl, dom
from tallyspark.plans import catalog
from tallyspark.plans.catalog import _PLACED_SQL, _TARGET_SQL, _clean_sql, _read, _strip_sql, query
from tallyspark.sources import html

_ROOT = "http://shop.example.com"


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


def _page(spark, d, *parts):
    """Pages made of expressions, literal texts and columns of ``part`` (``$name``)."""
    text = _text(*parts)
    return catalog._dealt(spark, d, "part", "p_partkey", rows=catalog.PAGES).select(F.col("p_partkey").alias("page_id"), F.lit(f"{_ROOT}/en/").alias("url"), text.alias("html"))


@query(
    "X20_container_products",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_name AS n, p_brand AS b, p_partkey AS k, NOT regexp_matches(lower(p_name), '{any_of(rules.PRODUCT_NOISE)}') AS ok FROM part)
SELECT page_id, n AS model, '{_ROOT}/i/' || k || '.jpg' AS image_url, '1,' || k || '.50' AS price, '{_ROOT}/product/' || k AS source_url, 'grid' AS kind FROM p WHERE ok
UNION ALL SELECT page_id, n, '{_ROOT}/i/' || k || '.jpg', '1,' || k || '.50', '{_ROOT}/product/' || k, 'card' FROM p WHERE ok
UNION ALL SELECT page_id, b || ' ' || n, NULL, NULL, '{_ROOT}/en/', 'item' FROM p WHERE ok
UNION ALL SELECT page_id, b || ' open', NULL, k || '', '{_ROOT}/p/' || k, 'item' FROM p""",
)
def x20_containers(spark, d):
    """Nested cards, list items without end tags, and items that lead to a category or carry a control's name."""
    card = ['<div class="grid-item"><div class="product-card"><div><a href="/product/', "$p_partkey", '"><img data-src="/i/', "$p_partkey", '.jpg"></a></div><h3 class="product-title">', "$p_name", '</h3><div><span class="price">USD 1,', "$p_partkey", ".50</span></div></div></div>"]
    items = ['<ul><li class="item type-product"><h4><b>', "$p_brand", "</b> ", "$p_name", "</h4><p>about it", '<li class="item type-product"><a href=/p/', "$p_partkey", "><span>", "$p_brand", "</span> open</a><div class=price>", "$p_partkey"]
    none = ['<li class="item type-product"><a href="/product-category/x">', "$p_name", '</a><li class="item type-product"><a href="/p/1">Add to cart</a></ul>', '<div class="product-grid-item"><a href="/p/2">', "$p_partkey", "</a></div>"]
    page = _page(spark, d, *card, *items, *none)
    got = dom.container_products(page)
    kind = F.when(F.col("container") == 0, "grid").when(F.col("container") == 1, "card").otherwise("item")
    return got.select("page_id", "model", "image_url", "price", "source_url", kind.alias("kind"))


@query(
    "X20_elements",
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(p|li|article|h1|nav|footer)[ >]', 1)) AS tag FROM pages) SELECT page_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY ALL""",
)
def x20_elements(spark, d):
    """Elements of the given pages by tag."""
    found = html.elements(_read(spark, d, "pages")).where(F.col("tag").isin("p", "li", "article", "h1", "nav", "footer"))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "X21_menu_tree",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_partkey % 4 AS k, replace(p_brand, '#', ' ') AS b, p_type AS t, p_name AS n, '{_ROOT}/c/' || p_partkey AS u FROM part)
SELECT page_id, 'menu' AS strategy, b AS category, NULL AS parent, b AS name, 1 AS depth, u AS target FROM p WHERE k = 0
UNION ALL SELECT page_id, 'menu', b, b, t, 2, u || '/t' FROM p WHERE k = 0
UNION ALL SELECT page_id, 'menu', b, t, n, 3, u || '/t/n' FROM p WHERE k = 0
UNION ALL SELECT page_id, 'cards', t, NULL, t, 1, u FROM p WHERE k = 1
UNION ALL SELECT page_id, 'footer', b, NULL, b, 1, u FROM p WHERE k = 2
UNION ALL SELECT page_id, 'links', n, NULL, n, 1, '{_ROOT}/products/' || page_id FROM p WHERE k = 3""",
)
def x21_tree(spark, d):
    """Menus of three levels, and pages where a later strategy is the first with results."""
    at = lambda tail="": ['<a href="/c/', "$p_partkey", f'{tail}">']
    brand = F.translate("p_brand", "#", " ")
    menu = _text("<nav><ul><li><a href='/'>Home</a><li>", *at(), brand, '</a><ul class="sub"><li>', *at("/t"), "$p_type", "</a><ul><li>", *at("/t/n"), "$p_name", "</a></ul></ul></ul></nav>")
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    link = lambda name: F.concat(F.lit('<a href="/c/'), key, F.lit('">'), name, F.lit("</a>"))
    cards = F.concat(F.lit('<div class="category-card">'), link(F.col("p_type")), F.lit('<a href="/c/second">Second</a></div>'))
    footer = F.concat(F.lit("<footer><p>"), link(brand), F.lit('<a href="/login">Login</a></p></footer>'))
    loose = F.concat(F.lit('<p><a href="/products/'), key, F.lit('">'), F.col("p_name"), F.lit('</a><a href="/news/1">News item</a><a href="/products/a/b/c/d">Deep one</a>'))
    nothing = F.lit('<nav><a href="/login">Login</a><a href="http://other.example.com/c/1">Elsewhere</a></nav>')
    body = F.when(k == 0, F.concat(menu, cards, footer)).when(k == 1, F.concat(nothing, cards, footer, loose)).when(k == 2, F.concat(nothing, footer, loose)).otherwise(F.concat(nothing, loose))
    return dom.site_categories(_page(spark, d, body)).drop("site", "pos")


_SKIP_SQL = ", ".join(f"'{x}'" for x in rules.MENU_SKIP)
_HOST_SQL, _PATH_SQL = "lower(regexp_extract({}, '^[a-zA-Z]+://([^/?#]+)', 1))", "regexp_extract(lower({}), '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    "X21_site_menus",
    f"""WITH n AS (SELECT page_id, url, array_to_string(regexp_extract_all(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), ' ') AS h FROM pages), l AS ({_PLACED_SQL}),
c AS (SELECT page_id, pos, url, lower(href) AS h, {_strip_sql("replace(txt, '&quot;', chr(34))")} AS txt, {_TARGET_SQL} AS target FROM l), d AS (SELECT *, {_clean_sql('txt')} AS name FROM c)
SELECT page_id, {_HOST_SQL.format('url')} AS site, 'menu' AS strategy, arg_min(name, pos) AS category, arg_min(name, pos) AS name, 1 AS depth, target FROM d
WHERE h <> '' AND txt <> '' AND NOT regexp_matches(h, '{crawl.NO_CATEGORY}') AND NOT regexp_matches(lower(txt), '{crawl.NO_CATEGORY}') AND (regexp_matches(h, '{crawl.CATEGORY_WORDS}') OR length(txt) BETWEEN 2 AND 50)
  AND length(name) >= 2 AND lower(name) NOT IN ({_SKIP_SQL}) AND lower(txt) NOT IN ({_SKIP_SQL}) AND {_HOST_SQL.format('target')} = {_HOST_SQL.format('url')}
  AND regexp_replace(target, '/$', '') <> regexp_replace(url, '/$', '') AND length(regexp_replace({_PATH_SQL.format('target')}, '/$', '')) > 0
GROUP BY page_id, url, target""",
)
def x21_menus(spark, d):
    """Menus of the given pages."""
    return dom.site_categories(_read(spark, d, "pages")).drop("pos", "parent")


@query(
    "X23_needs_script",
    f"""WITH t AS (SELECT page_id, html, length({_strip_sql("replace(replace(replace(regexp_replace(regexp_replace(html, '&amp([^;])', '&amp;\\1', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '&copy;', 'c'), '&middot;', '.'), '&quot;', '.')")}) AS text_chars FROM pages)
SELECT page_id, text_chars, (page_id % 5)::INTEGER AS empty_containers, text_chars < 500 OR page_id % 5 >= 3 OR regexp_matches(lower(html), '{any_of(dom.SCRIPT_WORDS)}') AS needs_script FROM t""",
)
def x23_boxes(spark, d):
    """The given pages, each with up to four empty containers at its end."""
    boxes = F.repeat(F.lit('<div class="card"><p></p></div>'), (F.col("page_id") % 5).cast("int"))
    return dom.needs_script(_read(spark, d, "pages").withColumn("html", F.concat("html", boxes)))


_P_SQL = "list_transform(string_split(replace(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '&quot;', chr(34)), '<p>')[2:], lambda x: " + _strip_sql("regexp_extract(x, '(?is)^(.*?)(?:</p>|$)', 1)") + ")"


@query(
    "X25_main_text",
    f"""WITH p AS (SELECT page_id, trim(array_to_string(list_filter({_P_SQL}, lambda t: length(t) > 100 AND NOT regexp_matches(lower(t), '{crawl.MAIN_NOISE}')), ' ')) AS text FROM pages),
s AS (SELECT page_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS pos FROM p),
f AS (SELECT page_id, arg_min(s, pos) AS s, min(pos) AS pos FROM s WHERE trim(s) <> '' GROUP BY page_id, lower(trim(s))) SELECT page_id, left(string_agg(s, '. ' ORDER BY pos), 1500) AS about FROM f GROUP BY page_id""",
)
def x25_article(spark, d):
    return dom.main_text(_read(spark, d, "pages"))


@query(
    "X25_nested_text",
    """WITH p AS (SELECT p_partkey AS page_id, p_partkey % 3 AS k, p_name || ' of ' || p_brand || ' with a frame of oak and a seat of wool, made by hand' AS t FROM part)
SELECT page_id, CASE k WHEN 0 THEN t || ' first. ' || t || ' second.' WHEN 1 THEN t || ' below' ELSE t || ' in a box of text' END AS about FROM p""",
)
def x25_nested(spark, d):
    """Texts behind an inner end tag, below a heading about the product, and in a block of text."""
    t = F.concat(F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" with a frame of oak and a seat of wool, made by hand"))
    k = F.col("p_partkey") % 3
    inner = F.concat(F.lit('<div class="product-description"><div><p>'), t, F.lit(" first.</p></div><p>"), t, F.lit(" second.</p></div>"))
    heading = F.concat(F.lit('<section><h2>About this product</h2><div><p class="text">'), t, F.lit(" below<p>not classed</div></section>"))
    box = F.concat(F.lit('<div class="cmpboxtxt"><p>'), t, F.lit(" in a box of text</p><p>short</p></div>"))
    return dom.main_text(_page(spark, d, F.when(k == 0, inner).when(k == 1, heading).otherwise(box)))
