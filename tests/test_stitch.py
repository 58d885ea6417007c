"""Stitched tables, line items, totals on text and the choice between candidates, on literal rows."""

from pyspark.sql import functions as F

from tallyspark.operators import costing, stitch

HEAD = ["Si.No", "Item Description", "Qty", "Unit Rate", "Total"]


def grid(spark):
    rows = [
        (1, 0, 0, 0, ["Offer for you", "", ""]),
        (1, 0, 1, 0, HEAD),
        (1, 0, 1, 1, ["ZONE A"]),
        (1, 0, 1, 2, ["1", "Executive chair", "3", "100.00", "1"]),
        (1, 1, 0, 0, ["SI.NO", "Item description", "QTY", "Unit rate", "Total"]),
        (1, 1, 0, 1, [" ", "<b> </b>", "​", "", ""]),
        (1, 1, 0, 2, ["2", "Item description of a unit desk", "2", "TBA", "-"]),
        (1, 1, 0, 3, ["1", "Executive chair", "3", "100.00", "1"]),
        (1, 1, 0, 4, ["", "Total", "", "", "12"]),
        (2, 0, 0, 0, ["nothing", "here"]),
    ]
    return spark.createDataFrame(rows, "doc_id long, page int, table_idx int, row_idx int, cells array<string>").repartition(3)


def test_stitched(spark):
    rows = stitch.stitched(grid(spark)).where("doc_id = 1").orderBy("row_no").collect()
    assert [r.cells[0] for r in rows] == ["Offer for you", "ZONE A", "1", "2", "1", ""] and all(r.headers == HEAD for r in rows)
    assert [r.row_no for r in rows] == [1, 2, 3, 4, 5, 6]
    assert stitch.stitched(grid(spark), dedup=True).where("doc_id = 1").count() == 5
    none = stitch.stitched(grid(spark)).where("doc_id = 2").collect()
    assert [(r.headers, r.cells, r.row_no) for r in none] == [(None, ["nothing", "here"], 1)]


def test_stitching_loses_no_rows(spark):
    rows = [
        (1, 0, 0, 0, ["Ref", "Colour"]), (1, 0, 0, 1, ["A1", "oak"]),
        (2, 0, 0, 0, ["a letter"]), (2, 0, 1, 0, ["Item", "Qty"]), (2, 0, 1, 1, ["desk", "2"]), (2, 0, 1, 2, ["unit and price as agreed", ""]), (2, 0, 1, 3, [None, " "]),
        (2, 1, 0, 0, ["Total amount"]), (2, 2, 0, 0, ["QTY", "Rate"]), (2, 2, 0, 1, ["chair", "1"]), (2, 2, 0, 2, ["Item", "Qty"]),
        (3, 0, 0, 0, ["x", "y"]), (3, 0, 0, 1, ["Item", "z"]),
    ]
    out = stitch.stitched(spark.createDataFrame(rows, "doc_id long, page int, table_idx int, row_idx int, cells array<string>").repartition(5)).orderBy("doc_id", "row_no").collect()
    got = {d: [(r.cells[0], r.headers) for r in out if r.doc_id == d] for d in (1, 2, 3)}
    assert got[1] == [("A1", ["Ref", "Colour"])]
    # a letter above the header, a note in the middle, a header that is all of its table, and one that is no first row
    assert got[2] == [(x, ["Item", "Qty"]) for x in ("a letter", "desk", "unit and price as agreed", "Total amount", "chair", "Item")]
    assert got[3] == [("x", None), ("Item", None)]


def test_items_and_totals(spark):
    rows = stitch.stitched(grid(spark)).where("doc_id = 1").withColumn("row_no", F.col("row_no") - 1)
    items = stitch.table_items(rows).orderBy("row_no").collect()
    # as the original: a data row with one of the words of a header goes too
    assert stitch.table_items(rows, strict=False).count() == 2
    again = spark.createDataFrame([(1, 1, HEAD, ["Si.No", "Item", "Qty", "Unit", "Price"]), (1, 2, HEAD, ["1", "oak desk", "2", "3", "6"]), (1, 3, None, ["1", "oak desk", "2", "3", "6"])], "doc_id int, row_no int, headers array<string>, cells array<string>")
    assert [r.row_no for r in stitch.table_items(again).collect()] == [2]
    assert [(r.description, r.qty, r.unit_rate, r.category) for r in items] == [("Executive chair", 3.0, 100.0, "seating"), ("Item description of a unit desk", 2.0, 0.0, "desking"), ("Executive chair", 3.0, 100.0, "seating")]
    factors = costing.scenarios(spark, [("a", 20.0, 10.0, None, None, 2.0, None), ("b", None, None, None, None, None, None)])
    out = {(r.scenario_id, r.row_no): r.cells for r in stitch.costed_rows(rows, factors).collect()}
    assert out["a", 2] == ["1", "Executive chair", "3", "264.00", "792.00"] and out["b", 2][3:] == ["100.00", "300.00"]
    assert out["a", 3][3:] == ["TBA", "-"] and out["a", 5][4] == "31.68" and out["a", 1] == ["ZONE A"]
    grand = spark.createDataFrame([(["Qty", "Unit Price", "Grand Total"], ["2", "5", "1"])], "headers array<string>, cells array<string>")
    assert stitch.recomputed(grand).first().cells == ["2", "5", "1"]


def test_field_by_priority(spark):
    row = spark.createDataFrame([(["Item code", "Full description", "Item"], ["c", "d", "i"])], "headers array<string>, cells array<string>")
    got = row.select(stitch.field("headers", "cells", ["description", "item"]), stitch.field("headers", "cells", ["item"]), stitch.field("headers", "cells", ["none"])).first()
    assert tuple(got) == ("d", "c", None)


def test_candidates_and_text(spark):
    scored = spark.createDataFrame([(1, 0, "plain", 80.0), (1, 1, "unstructured", 70.0), (1, 2, "layoutparser", 62.0), (1, 3, "plain", 63.0)], "page int, table_idx int, method string, score double")
    assert [(r.table_idx, r["rank"]) for r in stitch.candidates(scored, ["page"]).orderBy("rank").collect()] == [(1, 1), (0, 3), (3, 4)]
    texts = spark.createDataFrame([("Price: 12.50 AED", False), ("only 30 €", False), ("AED1250.5", True), ("x" * 900, False), ("none", True)], "t string, n boolean")
    got = [tuple(r) for r in texts.select(stitch.price_in_prose(F.col("t")), stitch.display(F.col("t"), F.col("n"))).collect()]
    assert [g[0] for g in got] == ["12.50", "30", "1250", None, None]
    assert [g[1] for g in got] == ["Price: 12.50 AED", "only 30 €", "1,250.50", "x" * 797 + "...", "none"]


def test_submittal_items(spark):
    rows = [
        (["Item", "Description", "Quantity", "Unit", "Unit Rate"], ["a", "Oak <b>desk</b> by knoll<img src='x.png'>", "2", "pcs", "9"]),
        (["Product", "Qty"], ["lamp of glass <img src='a.png'><img src=\"b.png\">", "3"]),
        (["Item", "Description"], ["a", ""]),
        (["Name"], ["a"]),
        (["Item", "Description"], ["short row"]),
    ]
    got = stitch.submittal_items(spark.createDataFrame(rows, "headers array<string>, cells array<string>").coalesce(1)).collect()
    assert [(r.description, r.qty, r.unit, r.brand, r.image, len(r.images)) for r in got] == [("Oak desk by knoll", "2", "pcs", "Knoll", "x.png", 1), ("lamp of glass", "3", None, "To be specified", "a.png", 2)]
    assert got[1].specifications == ["Materials: Glass"] and got[0].specifications == ["Oak desk by knoll"]


def test_costing_of_odd_rows(spark):
    """Headers that are shorter or longer than their rows, null or missing, and texts that are no number."""
    heads = ["No", "Quantity", "Unit Price (QAR)", " TOTAL ", None]
    rows = spark.createDataFrame(
        [(1, 1, heads, ["1", "2 pcs", "QAR 10.005", "x"]), (1, 2, heads[:3], ["1", "2", "3", "4", "5"]), (1, 3, None, ["1", "2", "3"]), (1, 4, heads, ["1", "none", "-2.5", "7", "8"]), (1, 5, heads, ["1", None, "", None])],
        "doc_id int, row_no int, headers array<string>, cells array<string>",
    )
    out = {r.row_no: r.cells for r in stitch.costed_rows(rows, costing.scenarios(spark, [("a", 10.0, None, 0.0, 0.0, 2.0, 0.0)])).collect()}
    assert out == {1: ["1", "2 pcs", "22.01", "44.02"], 2: ["1", "2", "6.60", "4", "5"], 3: ["1", "2", "3"], 4: ["1", "none", "-5.50", "15.40", "8"], 5: ["1", None, "", None]}
