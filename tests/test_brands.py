import json

from pyspark.sql import functions as F

from tallyspark.sources import brands

P = {"model": "m", "name": "n", "price": 12.5, "price_range": "12-18", "description": "d", "product_id": 7, "url": "u", "source_url": "s", "image_url": "i", "features": ["a", "b"]}
DOC = {
    "brand": "Acme",
    "categories": {
        "Chairs\n10 Products": {"products": [P, "text", {"name": "only name", "features": "x, y"}], "subcategory": None, "url": "z"},
        "Desks": {"url": "z", "Oak": {"products": [{"model": "o1"}, {"model": "o2", "price": "7"}], "product_count": 2}, "List": ["plain", {"name": "l2", "price": None}, 5], "Odd": 3, "None": {"count": 1}},
        "Broken": "text",
    },
    "collections": {"Sofas\n2": {"products": [{**P}, {"model": "c2"}]}, "Bad": {"products": {"a": 1}}, "Worse": 1},
    "all_products": [{**P, "category": "A", "subcategory": "B"}, {"name": "x"}, "no"],
    "category_tree": {"T": {"subcategories": {"S": {"products": [{"name": "t1"}, {"name": "t2"}]}, "E": []}}, "U": {}},
}


def rows(spark, *docs):
    df = spark.createDataFrame([("Acme", "mid_range", json.dumps(d) if not isinstance(d, str) else d) for d in docs], "brand string, tier string, json string")
    return brands.products(df.select("brand", "tier", F.try_parse_json("json").alias("doc"))).collect()


def test_every_product_of_every_layout(spark):
    got = rows(spark, DOC)
    key = sorted((r.layout, r.category, r.subcategory, r.model, r.price) for r in got)
    assert key == sorted([
        ("categories", "Chairs", "General", "m", 12.5), ("categories", "Chairs", "General", "only name", None), ("categories", "Desks", "Oak", "o1", None), ("categories", "Desks", "Oak", "o2", 7.0),
        ("categories", "Desks", "General", "plain", None), ("categories", "Desks", "General", "l2", None), ("collections", "Sofas", "general", "n", 12.5), ("collections", "Sofas", "general", "c2", None),
        ("all_products", "A", "B", "n", 12.5), ("all_products", "General", "General", "x", None), ("category_tree", "T", "S", "t1", None), ("category_tree", "T", "S", "t2", None),
    ])
    whole = next(r for r in got if r.model == "m")
    assert [whole[c] for c in brands.COLUMNS] == ["Acme", "Chairs", "General", "m", 12.5, "12-18", "d", "7", "s", "i", "a, b"]
    assert next(r for r in got if r.layout == "collections" and r.model == "n").url == "u"
    bare = next(r for r in got if r.model == "only name")
    assert (bare.price_range, bare.url, bare.features) == ("Contact for price", "", "x, y")


def test_documents_without_products(spark):
    assert rows(spark, "{}", "[]", "not json", '{"categories": [], "collections": null, "all_products": {}, "category_tree": 5}') == []


def test_brands_of_a_tier(spark, tmp_path):
    (tmp_path / "Ac_me_mid_range.json").write_text(json.dumps({"brand": "ACME", "website": "file"}))
    (tmp_path / "Other_MID_RANGE.json").write_text(json.dumps({"category_tree": {"Lamps": {}}, "categories": {"Desks": {}}}))
    (tmp_path / "Third_budgetary.json").write_text("{}")
    (tmp_path / "broken_mid_range.json").write_text("{")
    (tmp_path / brands.REGISTRY).write_text(json.dumps({"brands": [{"name": "Acme", "website": "w", "country": "IT", "tier": "Mid-Range", "categories": {"Chairs": {}}}, {"name": "Else", "tier": "high_end"}]}))
    got = {r.name: r for r in brands.listed(spark, str(tmp_path), "mid_range").collect()}
    assert {k: (r.website, r.country, r.categories, r.source) for k, r in got.items()} == {"Acme": ("w", "IT", ["Chairs"], "registry"), "Other": ("", "Unknown", ["Lamps"], "file")}
    assert [r.name for r in brands.listed(spark, str(tmp_path), "mid_range", "lamps").collect()] == ["Other"]
    assert [r.name for r in brands.listed(spark, str(tmp_path), "high_end").collect()] == ["Else"]
