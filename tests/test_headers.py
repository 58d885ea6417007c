from pyspark.sql import functions as F

from tallyspark.operators import catalogue, headers, pages
from tallyspark.plans import catalog


def grid(spark, *tables):
    return spark.createDataFrame([(1, t, i, r) for t, rows in enumerate(tables) for i, r in enumerate(rows)], "doc_id long, table_idx int, row_idx int, cells array<string>")


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_located_headers(spark):
    g = grid(spark, [["LOBBY", "", ""], ["S.N", "Item", "", "Qty"], ["1", "Chair", "", "2"]], [["1", "Chair"], ["2", "Desk"]], [["", ""]])
    got = {r.table_idx: (r.header_row, r.headers) for r in headers.located_headers(g).collect()}
    assert got == {0: (1, ["S.N", "Item", "Column 3", "Qty"]), 1: (-1, ["Column 1", "Column 2"]), 2: (-1, ["Column 1", "Column 2"])}


def test_detected_header(spark):
    g = grid(spark, [["1", "Chair", "x"], ["Item", "Qty", "Rate"], ["2", "Desk", "y"]], [["foo", "bar"], ["Item", "zap"]], [["1", "x"], ["2", "y"], ["3", "z"]], [["a", "b"]])
    assert {r.table_idx: r.header_row for r in headers.detected_header(g).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_roles(spark):
    got = values(spark, headers.role, ["Sr. No.", " QTY ", "Unit Price (QAR)", "Net Amount", "Make", "Remarks", "", None, "Item No"])
    assert got == ["serial", "quantity", "unit", "amount", "supplier", None, None, None, "serial"]


def test_header_arrays(spark):
    df = spark.createDataFrame([(["Qty", "", "Name", "qty", "Action"], ["1", "x", None, "2", "b"]), ([], []), (["A"], ["1", "2"])], "headers array<string>, cells array<string>")
    got = df.select(headers.clean_headers(F.col("headers")).alias("h"), headers.aligned_cells(F.col("headers"), F.col("cells")).alias("c")).collect()
    assert [(r.h, r.c) for r in got] == [(["Quantity", "Item Name", "Action"], ["1 2", "", "b"]), ([], []), (["A"], ["1"])]
    assert [(r.headers, r.cells) for r in headers.without_ui_columns(df.limit(1)).collect()] == [(["Qty", "", "Name", "qty"], ["1", "x", None, "2"])]
    valid = df.select(headers.is_valid_row(F.col("headers"), F.col("cells")).alias("v")).collect()
    assert [r.v for r in valid] == [True, False, True]


def test_rows_outside_tables(spark):
    assert values(spark, headers.is_non_table_row, ["Valid for 30 days", "Executive chair black", "Chair", "VAT at 5 %", ""]) == [True, False, True, True, True]
    assert values(spark, headers.has_table_content, ["item qty rate 1 2 3 4 5", "item qty 1 2", "cover letter this is 1 2 3 4 5"]) == [True, False, False]


def test_regions_and_sheets(spark):
    a = grid(spark, [["item", "qty", "rate"], ["1", "2", "3"]], [["foo", "bar", "zap"], ["9", "8", "7"]])
    assert [r.table_idx for r in headers.in_region(a, grid(spark, [["Rate", "item qty"]])).collect()] == [0]
    assert headers.in_region(a, a.limit(0)).count() == 2
    sheet = grid(spark, [["Project", ""], ["Item", "Qty", "Unit"], ["", " ", ""], ["1", "2", "m"]], [["a"], ["b"]])
    assert sorted((r.table_idx, r.row_idx) for r in headers.sheet_rows(sheet).collect()) == [(0, 1), (0, 3), (1, 0), (1, 1)]


def test_sheets_are_not_broadcast(spark, sf_dir):
    """There are as many heads as sheets: no table of them goes through the driver."""
    got = catalog.queries()["S6_live_columns"](spark, sf_dir)
    assert got.collect() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    sheet = grid(spark, [["", "", ""], ["a", "Image", ""], ["1", "", "x"]], [["Offer", "", "", ""], ["No", "Qty", "Image", "Note"], ["", "5", "", " "]])
    assert sorted((r.table_idx, r.row_idx, r.cells) for r in headers.live_columns(sheet).collect()) == [
        (0, 1, ["a", "Image", ""]), (0, 2, ["1", "", "x"]), (1, 1, ["Qty", "Image"]), (1, 2, ["5", ""]),
    ]


def test_rendered(spark):
    got = headers.rendered(grid(spark, [["a", "b|c"], ["<b>1</b>", "x"]])).first().markdown
    assert got == "| a | b\\|c |\n| --- | --- |\n| 1 | x |"


def test_pages(spark):
    html = (
        '<h1>Chairs</h1><div class="breadcrumb x"><a href="/">Home</a> <a href="/c">Chairs</a><a href="/c/t">Task</a></div>'
        '<a href="/chairs/task">Task (4)</a><a href="/product-category/sofas">Chairs</a><a href="/typologies/lounge-seats"></a>'
        '<a href="/collection/nova/12">Nova</a><table><tr><th>Width</th><td>60 cm</td></tr></table><ul><li>Steel base</li></ul>'
    )
    df = spark.createDataFrame([(1, "http://a.b/chairs/", html), (2, "http://a.b/x", ""), (3, None, None)], "page_id int, url string, html string")
    assert [tuple(r) for r in pages.subcategory_links(df).collect()] == [(1, "Task", "http://a.b/chairs/task")]
    got = sorted(tuple(r) for r in pages.collection_links(df).collect())
    assert got == [(1, "collection", "http://a.b/collection/nova/12", "Nova"), (1, "typologies", "http://a.b/typologies/lounge-seats", "Lounge Seats")]
    assert pages.crumbs(df).where("page_id = 1").first()[1:] == (["Home", "Chairs", "Task"], "Chairs", "Task")
    assert pages.features(df).where("page_id = 1").first().features == ["Steel base", "Width: 60 cm"]
    links = pages.links(df).withColumn("site", F.lit("a.b"))
    models = spark.createDataFrame([("a.b", "nova"), ("a.b", "none"), ("c.d", "task")], "site string, model string")
    assert [tuple(r) for r in pages.linked_models(models, links).collect()] == [("a.b", "nova", "http://a.b/collection/nova/12")]
    title = pages.link_title(F.lit("View"), F.lit(None).cast("string"), F.lit(""), F.lit("http://a.b/acme-nova-chair-12345"), F.lit("x"), "acme")
    assert spark.range(1).select(title.alias("t")).first().t == "Nova Chair"
    kinds = values(spark, pages.site_kind, ["https://www.architonic.com/x", "http://a.com/en/b/x/products", "http://x.it/prodotti", "http://estel.com", "http://a.b/c", None])
    assert kinds == ["portal", "collections", "italian", "italian", "other", "other"]


def test_listing(spark):
    md = "[Nova Chair](https://a.b/product/nova) [Add to cart](https://a.b/product/x) [Nova](https://a.b/product/nova) [Ola](http://a.b/product/ola/tag/z)"
    df = spark.createDataFrame([(1, md), (2, ""), (3, None)], "page_id int, markdown string")
    assert [tuple(r) for r in pages.listing_products(df).collect()] == [(1, "https://a.b/product/nova", "Nova Chair")]


def test_catalogue(spark, tmp_path):
    p = spark.createDataFrame([(1, "A", "budgetary", "Chairs", "Task", "m1", 1.0), (2, "A", "budgetary", "Chairs", "", "oak desk", 2.0), (3, "B", "budgetary", None, None, "m3", None)], "position int, brand string, tier string, category string, subcategory string, model string, price double")
    kinds = spark.createDataFrame([("A", 1, "Office chairs"), ("A", 0, "Desking")], "brand string, position int, name string")
    got = {r.position: r.assigned for r in catalogue.assigned(p, kinds).collect()}
    assert got == {1: "Office chairs", 2: "Office chairs", 3: None}
    path = str(tmp_path / "c")
    catalogue.write_collections(p, path)
    catalogue.write_collections(p.where("brand = 'A'"), path)
    back = spark.read.json(path)
    assert sorted((r.brand, r.collection or "", len(r.products)) for r in back.collect()) == [("A", "Chairs", 1), ("A", "Chairs > Task", 1), ("B", "", 1)]
    image = catalogue.found_image(F.lit("b.png"), F.array(F.lit("x/a.png"), F.lit("x/b.png")))
    assert spark.range(1).select(image.alias("i")).first().i == "x/b.png"
    none = spark.createDataFrame([], "brand string, category string, products int, needs_script boolean")
    assert catalogue.refetch(none).count() == 0


def test_light_plans(spark, sf_dir):
    """P5 sorts no table, it counts rows; P10 counts no words, it looks for a second one."""
    plan = lambda name: catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" in plan("P5_detected_header") and "count(1) windowspecdefinition" not in plan("P5_detected_header")
    assert "regexp_count" not in plan("P10_non_table").lower() and "regexp_extract_all" not in plan("P10_non_table").lower()
    assert values(spark, headers.is_non_table_row, [None, "oak\ndesk", " oak "]) == [None, False, True]
