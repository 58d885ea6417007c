import json

from pyspark.sql import functions as F

from tallyspark.operators import catalogue, headers, layout
from tallyspark.sources import io


def test_layout_blocks(spark):
    block = {"block_label": "text", "block_content": "a | b | c | d"}
    typed = {"block_type": "Table", "block_content": "x"}
    answers = [
        {"layoutParsingResults": [{"prunedResult": {"parsing_res_list": [block]}}, {"prunedResult": {"parsing_res_list": [typed, {"block_label": "table"}]}}]},
        {"result": {"results": [{"pruned_result": {"parsing_res_list": [{"block_content": "<TD>1</TD>"}]}}]}},
        [{"parsing_res_list": [{"block_label": "text", "block_content": "plain"}]}],
        {"pages": []},
    ]
    rows = [(i, json.dumps(a)) for i, a in enumerate(answers)] + [(8, "no json"), (9, None), (10, "")]
    got = io.layout_blocks(spark.createDataFrame(rows, "doc_id int, json string"))
    assert sorted((r.doc_id, r.page, r.block, r.is_table) for r in got.collect()) == [(0, 0, 0, True), (0, 1, 0, True), (0, 1, 1, False), (1, 0, 0, True), (2, 0, 0, False)]


def test_split_repaired(spark):
    rows = [
        (1, ["No", "Item", "Details", "", "", "Qty", "Note"], ["1", "", "Oak", "desk", "x", "3", "tail"]),
        (2, ["Details", "", ""], ["Oak", "LF12", "late"]),
        (3, ["Item", "", "Details"], ["Oak", "desk", "wide"]),
        (4, ["No", "Qty"], ["1", "2"]),
        (5, [], []),
        (6, ["Details"], [None]),
    ]
    got = {r.i: r.cells for r in headers.split_repaired(spark.createDataFrame(rows, "i int, headers array<string>, cells array<string>")).collect()}
    assert got[1] == ["1", "", "Oak desk", "", "x", "3", "tail"]
    assert got[2] == ["Oak", "LF12", "late"]
    assert got[3] == ["Oak desk", "", "wide"]
    assert (got[4], got[5], got[6]) == (["1", "2"], [], [None])


def test_brand_files(spark, tmp_path):
    one = {"brand": "Acme", "collections": [{"collection": "Chairs > Task", "products": [{"position": 1, "model": "m1", "price": 2.5}, {"position": 2, "model": "m2", "price": None}]}]}
    (tmp_path / "Ac_me_mid_range.json").write_text(json.dumps(one))
    (tmp_path / "Other_mid_range.json").write_text("{}")
    (tmp_path / "Third_budgetary.json").write_text("{}")
    files = io.brand_files(spark, str(tmp_path), "mid_range")
    assert sorted(r.brand for r in files.collect()) == ["Acme", "Other"]
    flat = io.flattened(files)
    assert sorted(tuple(r) for r in flat.collect()) == [("Acme", "mid_range", "Chairs > Task", 1, "m1", 2.5), ("Acme", "mid_range", "Chairs > Task", 2, "m2", None)]
    split = catalogue.split_collections(flat)
    assert {(r.category, r.subcategory) for r in split.collect()} == {("Chairs", "Task")}


def test_organised_and_batch(spark):
    kinds = "position int, brand string, tier string, category string, subcategory string, model string, source_url string"
    rows = [(1, "A", "t", "Chairs (3)", "Task", "m", "u/1"), (2, "A", "t", "Chairs", "Task", "m", "u/2"), (3, "A", "t", "Chairs", "General", "m", "u/3"), (4, "A", "t", "Desks", "General", " ", "http://s/p/oak-desk"), (5, "A", "t", "Desks", "General", None, None)]
    got = catalogue.organised(spark.createDataFrame(rows, kinds))
    assert sorted((r.position, r.category, r.model) for r in got.collect()) == [(2, "Chairs", "m"), (4, "Desks", "Oak Desk")]
    a = spark.createDataFrame([(1, "u", "")], "position int, source_url string, model string")
    b = spark.createDataFrame([(2, "u", "own"), (3, "v", None)], "position int, source_url string, model string")
    details = spark.createDataFrame([(1, "u", "found")], "position int, source_url string, model string")
    both = catalogue.enriched_batch({"costed": a, "extracted": b}, details, ["model"])
    assert sorted((r.origin, r.position, r.model) for r in both.collect()) == [("costed", 1, "found"), ("extracted", 2, "own"), ("extracted", 3, None)]


def test_delimited_grid(spark):
    from tallyspark.operators import tables

    df = spark.createDataFrame([(1, "a\tb\n1\t2\nlone"), (2, "a  b\nc   d"), (3, "a|b"), (4, ""), (5, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.row_idx, r.cells) for r in tables.delimited_grid(df).collect()) == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"]), (2, 0, ["a", "b"]), (2, 1, ["c", "d"])]
    assert tables.delimited_grid(df.select("doc_id", F.col("text").alias("t")), "t").count() == 4


def test_tables_by_page_and_text_rows(spark, tmp_path):
    grid = spark.createDataFrame([(1, 0, 0, 0, ["a", "b"]), (1, 2, 1, 0, ["c"])], "doc_id int, page int, table_idx int, row_idx int, cells array<string>")
    texts = spark.createDataFrame([(1, "not read"), (2, "one\n \ntwo"), (3, ""), (4, None)], "doc_id int, text string")
    io.write_tables(io.with_text_rows(grid, texts), str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out").parent) for p in (tmp_path / "out").rglob("*.parquet")) == ["doc_id=1/page=0/table_idx=0", "doc_id=1/page=2/table_idx=1", "doc_id=2/page=0/table_idx=0"]
    got = spark.read.parquet(str(tmp_path / "out")).where("doc_id = 2").orderBy("row_idx").collect()
    assert [(r.row_idx, r.cells) for r in got] == [(0, ["one"]), (2, ["two"])]
    assert io.with_text_rows(grid.drop("page"), texts).columns == ["doc_id", "table_idx", "row_idx", "cells"]


def by_hand(positions, reach, fewest, apart):
    """Columns by a loop over the sorted positions."""
    xs, clusters, current = sorted(set(positions)), [], []
    for x in xs:
        if current and x - sum(current) / len(current) >= reach:
            clusters.append(current)
            current = []
        current.append(x)
    centres = [sum(c) / len(c) for c in [*clusters, current] if len(c) >= fewest]
    return [c for k, c in enumerate(centres) if apart is None or k == 0 or c - centres[k - 1] > apart]


def test_running_columns(spark):
    import random

    rng = random.Random(8)
    rows = []
    for page in range(60):
        for _ in range(rng.randrange(1, 25)):
            x0 = rng.choice([10, 60, 75, 200, 230]) + rng.randrange(-9, 9)
            rows.append((1, page, float(x0), float(x0 + rng.randrange(4, 60)), rng.choice([100.0, 101.5, 103.0, 120.0, 140.0]), 100.0 if page % 3 else 500.0))
    df = spark.createDataFrame(rows, "doc_id int, page int, x0 double, x1 double, top double, header_top double")
    for mode, (reach, fewest, apart) in layout.COLUMN_MODES.items():
        got = {}
        for r in layout.running_columns(df, ["doc_id", "page"], mode).orderBy("column_no").collect():
            got.setdefault(r.page, []).append(r.centre)
        for page in range(60):
            own = [r for r in rows if r[1] == page]
            if mode != "all":
                own = [r for r in own if abs(r[4] - r[5]) < 2 or abs(r[4] - r[5]) >= 5]
            if mode == "header" and not any(abs(r[4] - r[5]) < 2 for r in own):
                own = []
            spots = [(r[2] + r[3]) / 2 for r in own] + ([] if mode == "alignment" else [r[2] for r in own])
            assert got.get(page, []) == (by_hand(spots, reach, fewest, apart) if own else []), (mode, page)
    assert layout.running_columns(df.limit(0), ["doc_id", "page"]).collect() == []


def test_extraction_counts(spark):
    grid = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 0, 1), (1, 2, 0), (2, 0, 0)], "doc_id int, page int, table_idx int")
    images = spark.createDataFrame([(1, 0), (1, 5), (3, 1)], "doc_id int, page int")
    assert sorted(tuple(r) for r in layout.extraction_counts(grid, images).collect()) == [(1, 3, 3, 4, 2), (2, 1, 1, 1, 0), (3, 1, 0, 0, 1)]
    assert sorted(tuple(r) for r in layout.extraction_counts(grid).collect()) == [(1, 2, 3, 4, 0), (2, 1, 1, 1, 0)]


def test_collections_in_pieces(spark, tmp_path):
    rows = [("A", "t", "Chairs", "Task" if k % 3 else "", k, f"m{k % 50}", float(k)) for k in range(2500)] + [("B", "t", "Desks", None, 1, "x", None)] * 7
    df = spark.createDataFrame(rows, "brand string, tier string, category string, subcategory string, position long, model string, price double")
    pieces = catalogue.collection_pieces(df, most=100)
    assert pieces.where(F.size("products") > 100).count() == 0 and pieces.count() >= 26
    assert catalogue.collection_pieces(df, most=5).where("brand = 'B'").agg(F.sum(F.size("products")), F.max(F.size("products"))).first()[:] == (7, 5)
    path = str(tmp_path / "out")
    catalogue.write_collections(df, path)
    catalogue.write_collections(df.where("brand = 'A' and position < 2000"), path)
    got = catalogue.read_collections(spark, path).collect()
    name = lambda r: r[2] if not r[3] else f"{r[2]} > {r[3]}"
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], r[1], name(r), *r[4:])) for r in rows if r[0] == "B" or r[4] < 2000)
