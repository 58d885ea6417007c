from pyspark.sql import functions as F

from tallyspark.operators import dom
from tallyspark.sources import html

URL = "https://shop.example.com/en/"


def pages(spark, *texts):
    return spark.createDataFrame([(k, URL, t) for k, t in enumerate(texts)], "page_id long, url string, html string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_id", *[c for c in ("container", "pos", "node") if c in df.columns]).collect()]


def test_nodes_are_in_order_and_contain_a_slice(spark):
    df = pages(spark, "<div class='a b'><p>one <b>two</b><p>three<ul><li>x<li>y<ul><li>z</ul></ul></div>after<br/><img src=i.png>", None, "", "</p><script>var x='<p>'</script><![bad[ <p>gone")
    got = rows(html.elements(df).where("page_id = 0"), "node", "parent", "last", "depth", "tag", "text")
    assert [g[4:] for g in got] == [("div", None), ("p", None), ("#text", "one"), ("b", None), ("#text", "two"), ("p", None), ("#text", "three"), ("ul", None), ("li", None), ("#text", "x"), ("li", None), ("#text", "y"), ("ul", None), ("li", None), ("#text", "z"), ("#text", "after"), ("br", None), ("img", None)]
    assert [g[0] for g in got] == list(range(18))
    for node, parent, last, depth, *_ in got:
        inside = {n for n, *_ in got if node < n <= last}
        children = {n for n, p, *_ in got if p == node}
        assert children <= inside and all(d > depth for n, _, _, d, *_ in got if n in inside)
        assert parent == -1 or got[parent][2] >= last
    assert rows(html.elements(df).where("page_id in (1, 2)"), "node") == []
    assert ("p", None) not in rows(html.elements(df).where("page_id = 3"), "tag", "text")[:1] and html.elements(df).where("text like '%var x%'").count() == 0
    two = html.parsed(df).select(dom.words(dom.below(F.col("nodes"), F.get("nodes", 0))).alias("t")).where("t <> ''").collect()
    assert [r.t for r in two] == ["one two three x y z"]


CARD = '<div class="product-card {c}"><a href="/product/{n}"><img data-src="/i/{n}.jpg"></a><div class="info"><h3 class="product-title">Chair {n}</h3><span class="price">QAR 1,{n}.50</span></div></div>'


def test_products_of_nested_cards(spark):
    nested = '<div class="grid-item"><div>' + CARD.format(n=1, c="") + "</div>" + CARD.format(n=2, c="big") + "</div>"
    got = rows(dom.container_products(pages(spark, nested)), "model", "image_url", "price", "source_url")
    one = [(f"Chair {n}", f"https://shop.example.com/i/{n}.jpg", f"1,{n}.50", f"https://shop.example.com/product/{n}") for n in (1, 2)]
    # the grid around them is a container by the last kind of class, and begins with the first card
    assert got == [one[0], *one]


def test_products_of_malformed_cards(spark):
    broken = '<ul><li class="product type-x"><a href=/product/7>Desk <b>Oak</a><span class=price>12</span><li class="product type-x"><h4>Sofa</h4><p>text</ul><li class="product type-x"><a href="/p/9"></a>'
    assert rows(dom.container_products(pages(spark, broken)), "model", "price", "source_url") == [("Desk Oak", "12", "https://shop.example.com/product/7"), ("Sofa", None, URL)]


def test_titles_and_targets_that_do_not_count(spark):
    item = lambda href, text: f'<article class="product"><a href="{href}">{text}</a></article>'
    page = "".join(item(*x) for x in [("/product-category/x", "Chairs"), ("/typologies/desks", "Desks"), ("/typologies/desks/nova", "Nova"), ("/product/1", "Add to cart"), ("/product/2", "42"), ("/product/3", "x"), ("/product/4", "Lamp")])
    assert rows(dom.container_products(pages(spark, page)), "model") == [("Nova",), ("Lamp",)]


def test_kinds_of_containers_are_tried_until_enough(spark):
    first = "".join(f'<li class="product x"><a href="/product/{k}">Item number {k}</a></li>' for k in range(21))
    late = '<div class="card"><a href="/product/99">Late one</a></div>'
    assert len(rows(dom.container_products(pages(spark, first + late)), "model")) == 21
    assert len(rows(dom.container_products(pages(spark, first[: first.rindex("<li")] + late)), "model")) == 21
    assert ("Late one",) in rows(dom.container_products(pages(spark, first[: first.rindex("<li")] + late)), "model")


MENU = """<nav><ul><li><a href="/">Home</a><li><a href="/seating">Seating</a><ul class="sub"><li><a href="/seating/chairs">Chairs (10)</a>
<ul><li><a href="/seating/chairs/office">Office</a><ul><li><a href="/seating/chairs/office/x">Too deep</a></ul></ul><li><a href="/seating/sofas">Sofas</a></ul>
<li><button>Desks</button><div class="dropdown"><ul><li><a href="/desks/oak">Oak</a></li></ul></div><li><a href="https://other.example.com/z">Other</a><li><a href="#">Here</a></ul></nav>"""
FOOTER = '<footer><ul><li><a href="/lamps">Lamps</a></li><li><a href="/login">Login</a></li></ul></footer>'


def test_menus_of_three_levels(spark):
    got = rows(dom.site_categories(pages(spark, MENU + FOOTER)), "strategy", "category", "parent", "name", "depth", "target")
    root = "https://shop.example.com"
    assert got == [
        ("menu", "Seating", None, "Seating", 1, f"{root}/seating"),
        ("menu", "Seating", "Seating", "Chairs", 2, f"{root}/seating/chairs"),
        ("menu", "Seating", "Chairs", "Office", 3, f"{root}/seating/chairs/office"),
        ("menu", "Seating", "Seating", "Sofas", 2, f"{root}/seating/sofas"),
        ("menu", "Desks", "Desks", "Oak", 2, f"{root}/desks/oak"),
    ]


def test_strategies_stop_at_the_first_with_results(spark):
    cards = '<div class="category-card"><a href="/c/tables">Tables</a><a href="/c/second">Second</a></div>'
    loose = '<p><a href="/products/a/b">Alpha</a><a href="/products/a/b/c/d">Deep</a><a href="/news/x">News item</a></p>'
    empty = '<nav><a href="/login">Login</a></nav>'
    got = rows(dom.site_categories(pages(spark, empty + cards + FOOTER + loose, empty + FOOTER + loose, empty + loose, empty)), "page_id", "strategy", "name", "depth")
    assert got == [(0, "cards", "Tables", 1), (1, "footer", "Lamps", 1), (2, "links", "Alpha", 1)]


def test_needs_script(spark):
    long = "<p>" + "words of a page that has enough of them " * 20 + "</p>"
    box = '<div class="card"></div>'
    got = dom.needs_script(pages(spark, long, "<p>short</p>", long + box * 3, long + box * 2, long + "<script>window.__vue__</script>", None, long + '<div class="card">text of ten</div>' * 5 + box * 3)).orderBy("page_id").collect()
    assert [r.needs_script for r in got] == [False, True, True, False, True, True, False]
    assert [r.empty_containers for r in got] == [0, 0, 3, 2, 0, 0, 0] and got[5].text_chars == 0


def about(spark, text):
    got = dom.main_text(pages(spark, text)).collect()
    return got[0].about if got else None


def test_text_behind_an_inner_end_tag_is_kept(spark):
    long = "This chair has a frame of oak and a seat of wool, made by hand in small numbers"
    page = f'<div class="product-description"><div><p>{long} one.</p></div><p>{long} two.</p></div>'
    assert about(spark, page) == f"{long} one. {long} two."


def test_steps_of_the_main_text(spark):
    x = lambda n, c: (f"{c} " * n).strip()
    meta = f'<meta name="description" content="{x(30, "meta")}">'
    section = f'<section><h2>About this product</h2><div><p class="text">{x(8, "below")}</p><p>{x(9, "unclassed")}</p></div></section>'
    assert about(spark, meta + section) == f"{x(30, 'meta')} {x(8, 'below')}"
    assert about(spark, section + f"<article><p>{x(40, 'main')}</p></article>") == x(8, "below")
    assert about(spark, f'<div class="detail"></div><div class="info"><p>{x(12, "cookie")}</p><p>{x(12, "good")}</p></div>') == f"{x(12, 'good')}"
    assert about(spark, f'<div class="cmptxt"><p>{x(8, "boxed")}</p></div>') == x(8, "boxed")
    assert about(spark, f"<main><p>{x(30, 'main')}</p><p>{x(30, 'login')}</p><p>short</p></main>") == x(30, "main")
    assert about(spark, f"<article><p>{x(300, 'longer')}</p></article>") == x(300, "longer")[:1500]
    assert about(spark, "<p>nothing</p>") is None and about(spark, None) is None


def test_main_text_of_pages(spark):
    long = "A chair of oak with a seat of wool. " * 4
    rows = [
        (1, f"<meta name='description' content='{'good chair ' * 6}'><section><h2>About this product</h2><p class='content'>Made by hand in small series.</p><p>short</p></section><article><p>{long}</p></article>"),
        (2, f'<div class="product-info"><p>{"Soft seat, firm back and legs of steel, " * 2}</p><p>{"We use a cookie to see what you do here. " * 2}</p></div><main><p>{long}</p></main>'),
        (3, f"<main><p>{long}</p><p>menu {long}</p></main>"),
        (4, "<p>no main part</p>"),
        (5, None),
    ]
    got = {r.page_id: r.about for r in dom.main_text(spark.createDataFrame(rows, "page_id int, html string").withColumn("url", F.lit(URL))).collect()}
    assert got == {1: ("good chair " * 6).strip() + " Made by hand in small series.", 2: ("Soft seat, firm back and legs of steel, " * 2).strip(), 3: "A chair of oak with a seat of wool. A chair of oak with a seat of wool."}


def test_features_of_classed_lists_and_tables(spark):
    items = lambda c, n: f'<ul class="{c}">' + "".join(f"<li>{c} {k}" for k in range(n)) + "</ul>"
    table = '<table class="spec">' + "".join(f"<tr><th>name {k}<td>value {k}" for k in range(12)) + "<tr><td>alone</table>"
    page = items("menu", 3) + items("product-features", 12) + items("benefits", 2) + items("specs", 2) + table
    got = dom.features(pages(spark, page, "<ul><li>x</ul>", table + f'<ul class="feature"><li>{"y" * 200}<li>ok</ul>')).orderBy("page_id").collect()
    assert got[0].features == [f"product-features {k}" for k in range(10)] + ["benefits 0", "benefits 1"] + [f"name {k}: value {k}" for k in range(3)]
    assert got[1].features == [] and got[2].features == ["ok"] + [f"name {k}: value {k}" for k in range(10)]


def test_collections_with_their_counts(spark):
    page = '<div><a href="/en/collection/nova/12">Nova</a><span>14 products</span></div><li><a href="/collection/oak/7"></a><b>Oak line</b> 3 Products</li><a href="/collection/bare/9">Bare 2 products</a><a href="/collection/x">x</a><a href="/collection/ab/1">ab</a>'
    assert rows(dom.collections(pages(spark, page)), "name", "products", "target") == [("Nova", 14, "https://shop.example.com/en/collection/nova/12"), ("Oak line 3 Products", 3, "https://shop.example.com/collection/oak/7"), ("Bare 2 products", 2, "https://shop.example.com/collection/bare/9")]


def test_product_links_and_their_fallback(spark):
    box = '<div class="card"><a href="/chairs/nova">Nova</a><a href="/second">x</a></div><div class="card"><a href="/typologies/x">Desks</a></div>'
    got = rows(dom.product_links(pages(spark, box + '<a href="/product/1">a</a><a href="/product/1">b</a>', box, "<a href='/x'>x</a>")), "page_id", "target", "strategy")
    assert got == [(0, "https://shop.example.com/product/1", "path"), (1, "https://shop.example.com/chairs/nova", "containers")]


def test_product_of_a_page(spark):
    whole = '<head><title>Shop</title><meta property="og:image" content="/o.png"><meta name="description" content="said"></head><h1>Nova <b>Chair</b></h1><img src="/i.png"><div class="price-box">USD 1,250.50</div><p>first</p>'
    got = dom.product(pages(spark, whole, "<title>Only</title><img data-src='a.png'><p> </p><p>" + "x" * 300, None)).orderBy("page_id").collect()
    assert tuple(got[0])[1:] == ("Nova Chair", "https://shop.example.com/o.png", "1,250.50", "said")
    assert tuple(got[1])[1:] == ("Only", "https://shop.example.com/a.png", None, "x" * 200) and tuple(got[2])[1:] == (None,) * 4


def test_breadcrumbs(spark):
    trail = '<div class="path"><span>/</span></div><nav class="breadcrumb"><ol><li><a href="/">Home</a></li><li>»</li><li><a href="/c/seating">Seating</a></li><li><div><a href="/c/chairs">Chairs (4)</a></div></li><li><span>Nova</span></li></ol></nav>'
    got = dom.breadcrumbs(pages(spark, trail, '<div id="the-breadcrumb"><a href="/x">X1</a></div>', "<p>x", None)).orderBy("page_id").collect()
    assert got[0].crumbs == ["Seating", "Chairs (4)", "Nova"] and [tuple(x) for x in got[0].links] == [("Seating", "/c/seating"), ("Chairs (4)", "/c/chairs")]
    assert got[1].crumbs == ["X1"] and got[2].crumbs == [] and got[3].links == []
    parents = pages(spark, trail, trail, trail, trail).withColumn("parent", F.element_at(F.array(F.lit("seating"), F.lit("Chairs"), F.lit("none"), F.lit(None)), (F.col("page_id") + 1).cast("int")))
    assert rows(dom.crumb_subcategories(parents), "page_id", "name", "target") == [(0, "Chairs", "https://shop.example.com/c/chairs")]


def test_subcategories_of_lists(spark):
    page = '<ul class="product-categories"><li><a href="/product-category/desks">Desks (3)</a></li><li><a href="/product-category/seating">Seating</a><li><a href="/other">Other</a></ul><aside class="sidebar"><div><a href="/category/desks2">Desks</a><a href="/category/x">x</a></div></aside><p><a href="/category/loose">Loose</a>'
    got = dom.subcategories(pages(spark, page, "<p>none").withColumn("parent", F.lit("Seating")))
    assert rows(got, "page_id", "name", "target") == [(0, "Desks", "https://shop.example.com/category/desks2")]


def test_cut_references_count_as_written(spark):
    """As the SQL of X23 has it: a title that is cut within a reference."""
    got = dom.needs_script(pages(spark, "a &quot; b", "a &quot", "<title>a = &quot</title><p>b &copy; c", "a &amp b &am", "a &lt b &#39", "<a href='?x=1&lang=2'>a</a>")).orderBy("page_id").collect()
    assert [r.text_chars for r in got] == [5, 7, 15, 9, 12, 1]


def test_all_containers_of_a_kind_count(spark):
    one = lambda k: f'<li class="product x"><a href="/product/{k}">Item number {k}</a></li>'
    got = rows(dom.container_products(pages(spark, "".join(map(one, range(450))), "".join(map(one, range(201))) + '<div class="card"><a href="/product/0">Late</a></div>')), "page_id", "model")
    assert sorted(got) == sorted([(0, f"Item number {k}") for k in range(450)] + [(1, f"Item number {k}") for k in range(201)])
