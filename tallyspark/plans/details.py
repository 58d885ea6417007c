"""Registered queries about details of pages, tables and texts made from ``part``, where the rules have several outcomes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import rules, text
from tallyspark.operators import catalogue, crawl, dom, headers, layout, pages
from tallyspark.plans.catalog import _CATALOGUE_SQL, _catalogue, _read, query
from tallyspark.plans.markup import _ROOT, _page, _text


@query(
    "X18_product_page",
    f"""WITH p AS (SELECT *, p_partkey % 2 AS k FROM part)
SELECT p_partkey AS page_id, CASE k WHEN 0 THEN p_name || ' chair' ELSE p_brand END AS title, '{_ROOT}' || CASE k WHEN 0 THEN '/o.png' ELSE '/en.png' END AS image_url, CASE k WHEN 0 THEN '1,' || p_partkey || '.50' END AS price, CASE k WHEN 0 THEN p_type || ' as said' ELSE left(repeat(p_name || ' ', 40), 200) END AS description FROM p""",
)
def x18_page(spark, d):
    declared = _text("<title>Shop</title><meta property='og:image' content='/o.png'><meta name='description' content='", "$p_type", " as said'><h1>", "$p_name", " <b>chair</b></h1><img src=i.png><div class='price-box'>USD 1,", "$p_partkey", ".50</div><p>first")
    plain = _text("<title>", "$p_brand", "</title><img data-src='/en.png'><p> </p><p>", F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40)))
    return dom.product(_page(spark, d, F.when(F.col("p_partkey") % 2 == 0, declared).otherwise(plain)))


@query(
    "X24_classed_features",
    """WITH p AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part), i AS (SELECT *, unnest(generate_series(1, least(s, 10))) AS j FROM p)
SELECT k AS page_id, string_agg(n || ' ' || j, '|' ORDER BY j) || CASE WHEN k % 2 = 0 THEN '|size: ' || s ELSE '' END AS features FROM i GROUP BY k, n, s""",
)
def x24_classed(spark, d):
    """Lists of one to fifty items, of which ten count, and a table of specifications in every other page."""
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda j: F.concat(F.lit("<li>"), "p_name", F.lit(" "), j.cast("string"))), "")
    table = F.when(F.col("p_partkey") % 2 == 0, _text("<table class='details'><tr><th>size<td>", "$p_size", "<tr><td>alone</table>")).otherwise("")
    return dom.features(_page(spark, d, "<ul class='menu'><li>Home</ul><ul class='features'>", items, "</ul>", table)).select("page_id", F.array_join("features", "|").alias("features"))


@query(
    "X26_links_or_containers",
    f"""SELECT p_partkey AS page_id, '{_ROOT}/product/' || p_partkey AS target, 'path' AS strategy FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, '{_ROOT}/chairs/' || p_partkey, 'containers' FROM part WHERE p_partkey % 2 = 1""",
)
def x26_fallback(spark, d):
    boxes = _text('<div class="card"><a href="/chairs/', "$p_partkey", '">', "$p_name", '</a><a href="/second">x</a></div><li class="item"><a href="/typologies/x">Desks</a>')
    link = F.when(F.col("p_partkey") % 2 == 0, _text('<a href="/product/', "$p_partkey", '">a</a><a href="/product/', "$p_partkey", '">b</a><a href="/collection/product/1">c</a>')).otherwise("")
    return dom.product_links(_page(spark, d, boxes, link)).drop("pos")


@query(
    "X28_collection_counts",
    f"""SELECT p_partkey AS page_id, p_name AS name, p_size AS products, '{_ROOT}/collection/nova/' || p_partkey AS target FROM part
UNION ALL SELECT p_partkey, p_brand || ' line', 0, '{_ROOT}/en/b/x/collection/oak/7' FROM part""",
)
def x28_counts(spark, d):
    page = _page(spark, d, '<div><a href="/collection/nova/', "$p_partkey", '">', "$p_name", "</a><b>", "$p_size", ' Products</b></div><li><a href="/en/b/x/collection/oak/7"></a><i>', "$p_brand", '</i> line</li><a href="/collection/bare">none</a><a href="/collection/ab/1">ab</a>')
    return dom.collections(page).drop("pos").withColumn("products", F.coalesce("products", F.lit(0)))


@query(
    "X19_sections",
    """SELECT p_partkey AS page_id, 'http://h/product/' || p_partkey AS target, p_name AS title, NULL AS image_url, NULL AS description FROM part
UNION ALL SELECT p_partkey, 'http://h/product/x' || p_partkey, p_brand, 'http://i/' || p_partkey || '.png', 'made of oak ![i](http://i/' || p_partkey || '.png)' || chr(10) || '(http://h/product/x' || p_partkey || ')' FROM part""",
)
def x19_sections(spark, d):
    md = _text("[", "$p_name", "](http://h/product/", "$p_partkey", ")\n### [", "$p_brand", "](x)\nmade of oak ![i](http://i/", "$p_partkey", ".png)\n(http://h/product/x", "$p_partkey", ")\n### Again\n(http://h/product/", "$p_partkey", ")\n### Sort by\n(http://h/product/z)\n### No link\nwords")
    return pages.listing(_read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), md.alias("markdown")))


@query(
    "X17_declared_kinds",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'product' WHEN 1 THEN 'category' WHEN 2 THEN 'product' WHEN 3 THEN 'category' WHEN 4 THEN 'other' ELSE 'category' END AS kind FROM part",
)
def x17_declared(spark, d):
    """By the URL, by the declared type, by a listing's URL in spite of it, by three product links, and by none of these."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    url = F.when(k == 0, F.concat(F.lit("http://h/product/n-"), n)).when(k == 1, F.concat(F.lit("http://h/category/p/"), n)).when(k == 5, F.lit("http://h/shop")).otherwise(F.concat(F.lit("http://h/z/"), n))
    link = F.concat(F.lit("[a](http://h/product/"), n, F.lit(") "))
    md = F.when(k == 3, F.concat(link, link, link)).when(k == 4, F.concat(link, link))
    og = F.when(k.isin(1, 2), "product")
    return _read(spark, d, "part").select("p_partkey", crawl.page_kind(url, md, og).alias("kind"))


_WORDS_SQL = "w AS (SELECT p_partkey AS k, unnest(string_split(rtrim(repeat(p_name || ' ' || p_type || ' ', p_size)), ' ')) AS word, generate_subscripts(string_split(rtrim(repeat(p_name || ' ' || p_type || ' ', p_size)), ' '), 1) AS i FROM part)"


@query(
    "F9_wide_cells",
    f"""WITH RECURSIVE {_WORDS_SQL}, n AS (SELECT k, max(i) AS n, sum(length(word) + 1) - 1 AS chars FROM w GROUP BY k),
f AS (SELECT k, i, word AS out, length(word) + 1 AS used FROM w WHERE i = 1
UNION ALL SELECT w.k, w.i, CASE WHEN f.used + length(w.word) + 1 <= 120 THEN f.out || ' ' || w.word ELSE f.out || '<br>' || w.word END, CASE WHEN f.used + length(w.word) + 1 <= 120 THEN f.used + length(w.word) + 1 ELSE length(w.word) END FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1)
SELECT f.k AS p_partkey, md5(CASE WHEN chars > 200 THEN out ELSE replace(out, '<br>', ' ') END) AS wrapped FROM f JOIN n ON n.k = f.k AND n.n = f.i""",
)
def f9_wide(spark, d):
    """Cells of over 200 characters in lines of 120."""
    cell = F.rtrim(F.repeat(F.concat_ws(" ", "p_name", "p_type", F.lit("")), F.col("p_size")))
    return _read(spark, d, "part").select("p_partkey", F.md5(text.wrapped_cell(cell, 200, 120).cast("binary")).alias("wrapped"))


@query(
    "F19_submittal_lines",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Material: As specified; Finish: As specified; Color: As per approved sample; Compliance: Meet relevant standards' WHEN 1 THEN 'Finish: As specified; Material/Finish: Per manufacturer standard; Color: As per approved sample; Compliance: Meet relevant standards' ELSE 'Material/Finish: Per manufacturer standard; Color: As per approved sample; Compliance: Meet relevant standards' END AS lines FROM part",
)
def f19_lines(spark, d):
    about = F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, " of Steel, glossy").when(F.col("p_partkey") % 3 == 1, " Powder Coated").otherwise(" plain"))
    return _read(spark, d, "part").select("p_partkey", F.array_join(text.submittal_specifications(about), "; ").alias("lines"))


@query("F14_slug_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(left(p_name, 1)) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) END AS name FROM part")
def f14_names(spark, d):
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://h/p/"), F.translate("p_name", " ", "-"), F.lit("/?x=1"))).otherwise("http://h/p/abc")
    return _read(spark, d, "part").select("p_partkey", text.slug_name(url).alias("name"))


@query("A14_extraction", "SELECT l_orderkey AS doc_id, max(l_linenumber)::BIGINT AS pages, count(*) FILTER (l_linenumber % 2 = 1) AS tables, (2 * count(*) FILTER (l_linenumber % 2 = 1))::BIGINT AS rows, count(*) FILTER (l_linenumber % 2 = 0) AS images FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_linenumber FROM lineitem) GROUP BY 1")
def a14_extraction(spark, d):
    """Each line is a page: odd ones with a table of two rows, even ones with an image."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("page"), F.lit(0).alias("table_idx"))
    grid = rows.where("page % 2 = 1").withColumn("row_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    return layout.extraction_counts(grid, rows.where("page % 2 = 0"))


@query("A12_pieces", f"WITH {_CATALOGUE_SQL} SELECT brand, tier, category || ' > ' || subcategory AS collection, count(*) AS n, true AS bounded, arg_min(model, position) AS first_model FROM cat GROUP BY ALL")
def a12_pieces(spark, d):
    """Collections in pieces of five products at most."""
    pieces = catalogue.collection_pieces(_catalogue(spark, d), most=5)
    first = F.get("products", 0)
    return pieces.groupBy("brand", "tier", "collection").agg(F.sum(F.size("products")).alias("n"), (F.max(F.size("products")) <= 5).alias("bounded"), F.min_by(first["model"], first["position"]).alias("first_model"))


def _tables(spark, d, *rows):
    """One table per part: rows of expressions for cells."""
    every = F.array(*[F.struct(F.lit(k).alias("row_idx"), F.array(*[F.coalesce(c.cast("string"), F.lit("")) if not isinstance(c, str) else F.lit(c) for c in cells]).alias("cells")) for k, cells in enumerate(rows)])
    return _read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.inline(every))


def _by(n, *values):
    out, k = None, F.col("p_partkey") % n
    for i, v in enumerate(values):
        v = F.lit(v) if isinstance(v, str) else v.cast("string")
        out = F.when(k == i, v) if out is None else out.when(k == i, v)
    return out


@query("P5_varied_headers", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 IN (1, 2, 4) THEN 1 ELSE 0 END AS header_row FROM part")
def p5_varied(spark, d):
    """A header first, below data, below a title, none above data, and a plain second row below data."""
    size, name = F.col("p_size"), F.col("p_name")
    top = [_by(5, "No", size, "Offer for you", "made for", size), _by(5, "Description", name, "of today", name, name), _by(5, "Qty", "2.00", "", "", "3.00")]
    second = [_by(5, size, "No", "No", size, "about"), _by(5, name, "Description", "Description", name, "our goods"), _by(5, "2.00", "Qty", "Qty", "2.00", "")]
    return headers.detected_header(_tables(spark, d, top, second, [size, name, F.lit("7.50")])).select("doc_id", "header_row")


@query("P14_varied_rows", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END::BIGINT AS rows FROM part")
def p14_varied(spark, d):
    """Repeated headers and rows with nothing in them are no valid rows."""
    head = ["No", "Item"]
    rows = [head, [F.col("p_partkey"), F.col("p_name")], [_by(3, "NO ", "8", "nan"), _by(3, "item", "desk", "None")], [_by(3, "9", "", ""), _by(3, "lamp", "sofa", " ")]]
    grid = _tables(spark, d, *rows)
    return grid.where(headers.is_valid_row(F.array(*map(F.lit, head)), F.col("cells"))).groupBy("doc_id").agg(F.count("*").alias("rows"))


@query("S6_varied_sheets", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '2,4' ELSE '0,2,4' END AS rows FROM part")
def s6_varied(spark, d):
    """Sheets that begin below a title and a blank row, and sheets without a head; blank rows go, numbers stay."""
    rows = [["Offer", "", ""], ["", " ", ""], [_by(2, "No", "1"), _by(2, "Description", "oak"), _by(2, "Qty", "x")], ["", "", ""], [F.col("p_partkey"), F.col("p_name"), F.lit("2")]]
    found = headers.sheet_rows(_tables(spark, d, *rows))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("row_idx")), ",").alias("rows"))



@query(
    "X22_crumbs_after_parent",
    f"SELECT p_partkey AS page_id, p_type AS name, '{_ROOT}/c/' || p_partkey AS target FROM part WHERE p_partkey % 3 < 2",
)
def x22_after(spark, d):
    """The crumb after the parent, by its whole name, by a part of it, and pages whose parent is in no crumb."""
    trail = ["<nav class='breadcrumb'><ol><li><a href='/'>Home</a><li>»<li><div><a href='/c'>", "$p_name", "</a></div><li><a href='/c/", "$p_partkey", "'>", "$p_type", " (7)</a><li>", "$p_brand", "</ol></nav>"]
    k = F.col("p_partkey") % 3
    parents = _read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.when(k == 0, F.upper("p_name")).when(k == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise("nowhere").alias("parent"))
    return dom.crumb_subcategories(_page(spark, d, *trail).join(parents, "page_id"))


@query(
    "X27_listed_subcategories",
    f"""SELECT p_partkey AS page_id, p_name AS name, '{_ROOT}/product-category/' || p_partkey AS target FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, '{_ROOT}/category/side/' || p_partkey FROM part WHERE p_partkey % 2 = 1""",
)
def x27_listed(spark, d):
    """Lists of categories; in every other page a sidebar leads the same name elsewhere."""
    side = F.when(F.col("p_partkey") % 2 == 1, _text('<aside class="sidebar"><div><a href="/category/side/', "$p_partkey", '">', "$p_name", "</a></div></aside>")).otherwise("")
    page = _page(spark, d, '<ul class="product-categories"><li><a href="/product-category/', "$p_partkey", '">', "$p_name", ' (3)</a><li><a href="/product-category/x">', "$p_brand", '</a><li><a href="/other">Other</a></ul>', side, '<p><a href="/category/loose">Loose</a>')
    return dom.subcategories(page.join(_read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("parent")), "page_id"))
