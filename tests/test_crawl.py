from pyspark.sql import functions as F

from tallyspark.operators import crawl, pages


def test_links_and_pages(spark):
    rows = [("/shop/chairs", "x" * 60), ("/login", "Chairs"), ("/a.pdf", "List"), ("/x", "About us"), ("/x", "Lamps"), ("/x", "y"), (None, "Lamps"), ("/x", "")]
    got = spark.createDataFrame(rows, "h string, t string").coalesce(1).select(crawl.is_category_link(F.col("h"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False, False, False]
    links = "[a](http://h/product/1) [b](/product/2)\n[c](/product/3)"
    rows = [("http://h/product/nova/", None, None), ("http://h/product-category/p/x", None, "product"), ("http://h/x-12.html", "", ""), ("http://h/z", None, "product"), ("http://h/z", links, None), ("http://h/z", links[:-3], None), ("http://h/shop", None, None), (None, None, None)]
    got = spark.createDataFrame(rows, "u string, m string, o string").coalesce(1).select(crawl.page_kind(F.col("u"), F.col("m"), F.col("o"))).collect()
    assert [r[0] for r in got] == ["product", "category", "product", "product", "category", "other", "category", "other"]


def test_url_id(spark):
    want = {"http://h/p/a-b-207/": "207", "http://h/products/31": "31", "http://h/product/n-5/": "5", "http://h/product/x/1234567/y": "1234567", "http://h/item/77": "77", "http://h/item/nova/": "nova"}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", crawl.url_id(F.col("u"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_table_region(spark):
    box = (0.0, 0.0, 600.0, 800.0)
    words = [(50.0, 90.0, 20.0, "Quantity"), (30.0, 60.0, 200.0, "Item"), (80.0, 160.0, 200.0, "Description"), (500.0, 590.0, 200.02, "Qty")]
    words += [(x, x + 20, 240.0, t) for x, t in ((30.0, "1"), (80.0, "Desk"), (500.0, "2"))] + [(30.0, 90.0, 300.0, "Thanks"), (100.0, 120.0, 300.0, "7"), (30.0, 50.0, 790.0, "9")]
    rows = [(1, 1, *w, *box) for w in words] + [(1, 2, *w, *box) for w in words[:9]] + [(2, 1, 10.0 + i, 12.0, 300.0 + i, "zzz", *box) for i in range(12)]
    kinds = "doc_id int, page int, x0 double, x1 double, top double, text string, page_left double, page_top double, page_right double, page_bottom double"
    got = crawl.table_region(spark.createDataFrame(rows, kinds)).collect()
    assert [(r.doc_id, r.page, r.header_y, r.top, r.bottom, r.left, r.right) for r in got] == [(1, 1, 200.0, 195.0, 260.0, 10.0, 600.0)]
    assert crawl.table_region(spark.createDataFrame([], kinds)).count() == 0


def test_new_by_page(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x")]
    got = crawl.new_by_page(spark.createDataFrame(rows, "site string, page int, source_url string")).collect()
    assert sorted((r.site, r.page, r.new, r.wanted) for r in got) == [("a", 1, 2, True), ("a", 2, 0, False), ("a", 3, 1, False), ("b", 1, 1, True)]


def test_crawled_products(spark):
    rows = [
        (1, "http://h/chairs/oak/product/nova", "Now AED 20", {"title": "Nova - Acme", "ogImage": "http://i/1"}),
        (2, "http://h/x", "# Buy Luna\n\nA desk.\n\n![x](http://i/2)", {"ogType": "product"}),
        (3, "http://h/product-category/", "[Sola](http://h/product/sola) [View all](http://h/product/all) [Sola again](http://h/product/sola)", None),
        (4, "http://h/product/x", None, {"title": "x"}),
        (5, "http://h/news", "nothing", None),
        (6, None, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, markdown string, metadata map<string,string>")
    got = {r.page_id: r for r in crawl.crawled_products(pages, "Acme").collect()}
    assert {k: (r.model, r.image_url, r.price, r.description, r.collection) for k, r in got.items()} == {
        1: ("Nova", "http://i/1", "20", None, "Chairs > Oak"),
        2: ("Luna", "http://i/2", None, "A desk.", "X"),
        3: ("Sola", None, None, None, "Product Category > general"),
    }
    assert got[3].source_url == "http://h/product/sola" and crawl.crawled_products(pages.where("false"), "Acme").count() == 0


def test_links_of_any_quotes(spark):
    html = "<a href='/a'>A</a><a class=x href=/b>B</a><A rel=\"n\" HREF = \"/c?x='1'\"><b>C</b></A><a data-href='/no'>D</a><abbr href='/no'>E</abbr><a href=\"\">F</a>"
    got = pages.links(spark.createDataFrame([(1, "http://h/x", html), (2, "http://h/x", None)], "page_id int, url string, html string")).orderBy("pos").collect()
    assert [(r.href, r.text) for r in got] == [("/a", "A"), ("/b", "B"), ("/c?x='1'", "C"), ("", "F")]


def test_linked_models_meet_few_links(spark):
    n = 3000
    models = spark.range(n).select(F.lit("s").alias("site"), F.format_string("Model %05d", (F.col("id") * 7919) % 100_000).alias("model"))
    links = models.select("site", F.xxhash64("model").alias("page_id"), F.lit(0).alias("pos"), F.concat(F.lit("/"), "model").alias("target"), F.concat(F.lit("see the new "), F.upper("model"), F.lit(" now")).alias("text"))
    assert pages.model_candidates(models, links).count() < 3 * n
    got = pages.linked_models(models, links)
    assert got.count() == n and got.where(F.col("target") != F.concat(F.lit("/"), "model")).count() == 0


def test_linked_models_like_all_pairs(spark):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 12)))
    models = [(rng.choice("st"), word()) for _ in range(150)] + [("s", ""), ("s", "Ünï"), ("u", "nowhere")]
    links = [(rng.choice("st"), k, 0, f"/{k}", word() + word()) for k in range(150)] + [("s", 900, 1, "/900", "ÜNÏcode")]
    want = {(s, m): next((t for ls, _, _, t, x in links if ls == s and m.lower() in x.lower()), None) for s, m in models}
    got = pages.linked_models(spark.createDataFrame(models, "site string, model string"), spark.createDataFrame(links, "site string, page_id int, pos int, target string, text string"))
    assert {(r.site, r.model): r.target for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_listing_with_sections(spark):
    text = "[Nova](http://h/product/1)\n### [Oak desk](x)\nmade of oak ![i](http://i/2.png)\n(http://h/product/2)\n### Nova again\n(http://h/product/1)\n### Sort by\n(http://h/product/3)\n### Empty\nno link\n###   Late\n\n[x](http://h/product/4)"
    got = {r.target: r for r in pages.listing(spark.createDataFrame([(1, text), (2, None)], "page_id int, markdown string")).collect()}
    assert {k: v.title for k, v in got.items()} == {"http://h/product/1": "Nova", "http://h/product/2": "Oak desk", "http://h/product/4": "Late"}
    assert got["http://h/product/2"].image_url == "http://i/2.png" and got["http://h/product/2"].description.startswith("made of oak") and got["http://h/product/4"].image_url is None
