"""Brand documents: JSON whose keys are data and whose values vary in type, read as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "brands_dynamic.json"
NO_PRICE = "Contact for price"
# Keys of a category that are no subcategories.
NOT_NESTED = ["url", "category", "subcategory", "product_count", "products", "category_tree", "collections", "all_products"]
COLUMNS = ["brand", "category", "subcategory", "model", "price", "price_range", "description", "product_id", "url", "image_url", "features"]


def documents(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """(brand, tier, doc) of the files ``<brand>_<tier>.json`` (without case) under a folder. The name in the file wins over the file's; files that are no JSON go."""
    files = spark.read.option("wholetext", True).text(f"{path}/*.json").select("value", F.col("_metadata.file_name").alias("file"))
    named = files.where(F.col("file").rlike(rf"(?i)^.+_{tier}\.json$") & (F.col("file") != REGISTRY)).withColumn("doc", F.try_parse_json("value")).where("doc is not null")
    stem = F.regexp_extract("file", rf"(?i)^(.+)_{tier}\.json$", 1)
    return named.select(F.coalesce(_text(F.col("doc"), "brand"), stem).alias("brand"), F.lit(tier).alias("tier"), "doc")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries (name, website, country, tier, doc) of the registry under a folder, tiers in one spelling; none where there is no such file."""
    files = spark.read.option("wholetext", True).text(f"{path}/*.json").where(F.col("_metadata.file_name") == REGISTRY)
    doc = files.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.brands", "array<variant>")).alias("doc"))
    tier = F.replace(F.lower(F.coalesce(_text(F.col("doc"), "tier"), F.lit(""))), F.lit("-"), F.lit("_"))
    return doc.select(*[F.coalesce(_text(F.col("doc"), c), F.lit(d)).alias(c) for c, d in (("name", "Unknown"), ("website", ""), ("country", "Unknown"))], tier.alias("tier"), "doc")


def listed(spark: SparkSession, path: str, tier: str, category: str | None = None) -> DataFrame:
    """The brands of a tier: (name, website, country, tier, categories, source). Those of the registry come first; a file adds its brand if the registry has none of
    that name (without case). Categories are those of the tree, else of ``categories``; with ``category`` only brands that have it (without case)."""
    tree, flat = _map(F.col("doc"), "$.category_tree"), _map(F.col("doc"), "$.categories")
    names = F.map_keys(F.when(F.size(tree) > 0, tree).otherwise(F.coalesce(flat, F.create_map().cast("map<string,variant>"))))
    own = registry(spark, path).where(F.col("tier") == tier).select("name", "website", "country", "tier", names.alias("categories"), F.lit("registry").alias("source"))
    of_files = documents(spark, path, tier).select(F.col("brand").alias("name"), *[F.coalesce(_text(F.col("doc"), c), F.lit(d)).alias(c) for c, d in (("website", ""), ("country", "Unknown"))], "tier", names.alias("categories"), F.lit("file").alias("source"))
    known = own.select(F.lower("name").alias("_k")).distinct()
    out = own.unionByName(of_files.join(known, F.lower("name") == F.col("_k"), "left_anti"))
    return out if category is None else out.where(F.exists("categories", lambda c: F.lower(c) == category.lower()))


def _map(v: Column, path: str = "$") -> Column:
    """An object as a map, null for any other value; keys are in order of code points."""
    return F.try_variant_get(v, path, "map<string,variant>")


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, key: str) -> Column:
    """A value as text; null where it is missing, null or empty."""
    return F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))


def _product(p: Column, names: tuple[str, ...], urls: tuple[str, ...]) -> Column:
    """The columns that a product brings itself. A text in place of an object is a model."""
    blank = F.lit("")
    model = F.coalesce(*[_text(p, k) for k in names], F.when(_map(p).isNull(), F.try_variant_get(p, "$", "string")), blank)
    many = F.array_join(F.transform(_list(p, "$.features"), lambda f: F.try_variant_get(f, "$", "string")), ", ")
    return F.struct(
        model.alias("model"), F.try_variant_get(p, "$.price", "double").alias("price"), F.coalesce(_text(p, "price_range"), F.lit(NO_PRICE)).alias("price_range"),
        F.coalesce(_text(p, "description"), blank).alias("description"), F.coalesce(_text(p, "product_id"), blank).alias("product_id"),
        F.coalesce(*[_text(p, k) for k in urls], blank).alias("url"), F.coalesce(_text(p, "image_url"), blank).alias("image_url"), F.coalesce(many, _text(p, "features"), blank).alias("features"),
    )


def _rows(groups: DataFrame, layout: str, names: tuple[str, ...], urls: tuple[str, ...], texts: bool = False) -> DataFrame:
    """Groups (brand, tier, category, subcategory, products) as rows of one layout; ``texts``: products may be texts."""
    rows = groups.select("brand", "tier", "category", "subcategory", F.posexplode("products").alias("position", "_p"))
    ok = _map(F.col("_p")).isNotNull()
    if texts:
        ok = ok | (F.schema_of_variant("_p") == "STRING")
    return rows.where(ok).withColumn("_x", _product(F.col("_p"), names, urls)).select("brand", "tier", "category", "subcategory", "_x.*", F.lit(layout).alias("layout"), "position")


def products(docs: DataFrame) -> DataFrame:
    """Documents (brand, tier, doc) of any of four layouts, or of several, as one row per product: ``COLUMNS``, and tier, layout and position.

    ``categories``: products of a category, or of the groups within it, lists (subcategory General; a text is a model) or objects with products; ``collections``: products of a
    collection (subcategory general); ``all_products``: each with its own category; ``category_tree``: products of subcategories. Every product of a group is one row; values that are
    neither objects nor lists where those are expected give none. Names of categories and collections end at a line feed.
    """
    base = docs.select("brand", "tier", "doc")
    cut = F.trim(F.substring_index("_k", "\n", 1))
    clean = F.when(F.contains("_k", F.lit("\n")), cut).otherwise(F.col("_k"))
    entry = lambda rows, path: rows.select("brand", "tier", F.explode(_map(F.col("doc"), path)).alias("_k", "_v")).where(_map(F.col("_v")).isNotNull())
    by_name, by_model = ("name", "model"), ("model", "name")
    own_url, source = ("url", "source_url"), ("source_url", "url")

    cats = entry(base, "$.categories").withColumn("_has", F.array_contains(F.map_keys(_map(F.col("_v"))), "products"))
    direct = cats.where("_has").select("brand", "tier", clean.alias("category"), F.coalesce(_text(F.col("_v"), "subcategory"), F.lit("General")).alias("subcategory"), _list(F.col("_v"), "$.products").alias("products"))
    inner = cats.where("not _has").select("brand", "tier", F.col("_k").alias("category"), F.explode(_map(F.col("_v"))).alias("_s", "_g")).where(~F.col("_s").isin(NOT_NESTED))
    flat = inner.where(_list(F.col("_g")).isNotNull()).select("brand", "tier", "category", F.lit("General").alias("subcategory"), _list(F.col("_g")).alias("products"))
    nested = inner.where(_list(F.col("_g")).isNull()).select("brand", "tier", "category", F.col("_s").alias("subcategory"), _list(F.col("_g"), "$.products").alias("products"))
    colls = entry(base, "$.collections").select("brand", "tier", clean.alias("category"), F.lit("general").alias("subcategory"), _list(F.col("_v"), "$.products").alias("products"))
    loose = base.select("brand", "tier", F.posexplode(_list(F.col("doc"), "$.all_products")).alias("position", "_p"))
    one = loose.select("brand", "tier", "position", *[F.coalesce(_text(F.col("_p"), c), F.lit("General")).alias(c) for c in ("category", "subcategory")], F.array("_p").alias("products"))
    alone = _rows(one.select("brand", "tier", "category", "subcategory", "products"), "all_products", by_name, own_url)
    tree = entry(base, "$.category_tree").select("brand", "tier", F.col("_k").alias("category"), F.explode(_map(F.col("_v"), "$.subcategories")).alias("subcategory", "_g"))
    tree = tree.select("brand", "tier", "category", "subcategory", _list(F.col("_g"), "$.products").alias("products"))
    parts = [_rows(direct, "categories", by_model, source), _rows(flat, "categories", by_model, source, texts=True), _rows(nested, "categories", by_model, source), _rows(colls, "collections", by_name, own_url), alone, _rows(tree, "category_tree", by_name, own_url)]
    return reduce(DataFrame.unionByName, parts)
