"""Catalogues of brands and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import clean_category, slug_name


def normal_tier(tier):
    """P19."""
    return F.regexp_replace(F.lower(tier), "[ -]", "_")


def models(catalogue: DataFrame, tier: str | None = None, brand: str | None = None, category: str | None = None, subcategory: str | None = None) -> DataFrame:
    """Filters that reach the scan; categories match whole or in part, without case."""
    out = catalogue
    if tier:
        out = out.where(F.col("tier") == tier.lower().replace(" ", "_").replace("-", "_"))
    if brand:
        out = out.where(F.lower("brand") == brand.lower())
    for name, value in (("category", category), ("subcategory", subcategory)):
        if value:
            out = out.where(F.contains(F.lower(name), F.lit(value.lower())))
    return out


def counts(catalogue: DataFrame) -> DataFrame:
    """Products by category and subcategory, with all sums in one pass."""
    return catalogue.rollup("category", "subcategory").agg(F.count("*").alias("products"), F.grouping_id().cast("int").alias("level"))


def top_products(catalogue: DataFrame, limit: int = 100) -> DataFrame:
    """The first products of each brand and category."""
    rank = F.row_number().over(Window.partitionBy("brand", "category", "subcategory").orderBy("position"))
    return catalogue.withColumn("rank", rank).where(F.col("rank") <= limit)


def upsert_brands(registry: DataFrame, news: DataFrame) -> DataFrame:
    """By lower-cased name and tier; new values win field by field, the first added_date stays."""
    key = lambda d: d.withColumn("_k", F.lower("name"))
    a, b = key(registry).alias("a"), key(news).alias("b")
    both = a.join(b, (F.col("a._k") == F.col("b._k")) & F.col("a.tier").eqNullSafe(F.col("b.tier")), "full_outer")
    new_first = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("website", "country", "updated_date")]
    return both.select(F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.tier", "b.tier").alias("tier"), *new_first, F.coalesce("a.added_date", "b.added_date").alias("added_date"))


def insert_absent(catalogue: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """U2."""
    return catalogue.unionByName(news.join(catalogue.select(*keys).distinct(), keys, "left_anti"))


def first_seen(products: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return products.withColumn("_r", rank).where("_r = 1").drop("_r")


def one_per_url(products: DataFrame) -> DataFrame:
    """Each URL once, in a collection with a subcategory if there is one; rows without a URL go."""
    return first_seen(products.where("source_url is not null"), ["source_url"], F.col("subcategory").isNull(), "position")


def without_general(products: DataFrame) -> DataFrame:
    """A product of General goes if its model is in a specific subcategory of that category."""
    special = F.max((F.col("subcategory") != "General").cast("int")).over(Window.partitionBy("category", "model"))
    return products.withColumn("_s", special).where((F.col("subcategory") != "General") | (F.col("_s") == 0)).drop("_s")


def split_collections(products: DataFrame) -> DataFrame:
    """``Cat > Sub`` to two columns; one level gives general; names end at a line feed."""
    parts = F.split(F.col("collection"), ">")
    two = F.size(parts) == 2
    clean = lambda c: F.trim(F.substring_index(c, "\n", 1))
    return products.withColumns({"category": clean(F.when(two, parts[0]).otherwise(F.col("collection"))), "subcategory": F.when(two, clean(F.try_element_at(parts, F.lit(2)))).otherwise("general")})


def tree(categories: DataFrame) -> DataFrame:
    """A parent goes if it has subcategories; equal names are no pair."""
    has = F.max(F.col("subcategory").isNotNull().cast("int")).over(Window.partitionBy("category"))
    return categories.withColumn("_h", has).where("(subcategory is not null or _h = 0) and not category <=> subcategory").drop("_h")


def reprice(catalogue: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices by trimmed, lower-cased name; of repeated names the last row counts."""
    key = lambda c: F.lower(F.trim(c))
    last = prices.groupBy(key(F.col("name")).alias("_k")).agg(F.max_by("price", "row_no").alias("_p"))
    joined = catalogue.join(last, key(F.col("model")) == F.col("_k"), "left")
    return joined.withColumn("price", F.coalesce("_p", "price")).withColumn("repriced", F.col("_p").isNotNull()).drop("_k", "_p")


def duplicate_parents(products: DataFrame, share: float = 0.8) -> DataFrame:
    """Categories of whose own products (no subcategory) strictly more than ``share`` are in their subcategories."""
    urls = products.groupBy("category", "source_url").agg(F.max(F.col("subcategory").isNull()).alias("own"), F.max(F.col("subcategory").isNotNull()).alias("child"))
    out = urls.where("own").groupBy("category").agg(F.count("*").alias("urls"), F.count_if("child").alias("shared"))
    return out.withColumn("duplicate", F.col("shared") / F.col("urls") > share)


def listing(catalogue: DataFrame, columns: list[str], **equal: str) -> DataFrame:
    """The distinct values of ``columns`` among products that equal the given values, without case."""
    for name, value in equal.items():
        catalogue = catalogue.where(F.lower(name) == value.lower())
    return catalogue.select(*columns).distinct()


def merge_fragments(products: DataFrame, fields: list[str], url: str = "source_url", position: str = "position") -> DataFrame:
    """One row per URL, each field from the first fragment that has it; rows without a URL go."""
    has = lambda c: F.when(F.trim(c) != "", F.col(position))
    first = [F.min_by(F.col(c), has(c)).alias(c) for c in fields]
    return products.where(F.col(url).isNotNull()).groupBy(url).agg(*[F.when(F.count(has(c)) > 0, f).alias(c) for c, f in zip(fields, first, strict=True)])


def enriched(rows: DataFrame, details: DataFrame, fields: list[str], url: str = "source_url", position: str = "position") -> DataFrame:
    """Missing and blank fields are filled from the details of the same URL, the first of several."""
    one = merge_fragments(details, fields, url, position).select(F.col(url).alias("_url"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = rows.join(one, rows[url] == one["_url"], "left")
    filled = {c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_new_{c}"), F.col(c)) for c in fields}
    return joined.withColumns(filled).select(*rows.columns)


def with_image(selection: DataFrame, images: DataFrame) -> DataFrame:
    """The image of the product with the same brand, category, subcategory and trimmed model, else of one with that brand and model; the first by position."""
    model, exact, loose = F.trim("model"), ["brand", "category", "subcategory", "_model"], ["brand", "_model"]
    named = images.withColumn("_model", model)
    a = named.groupBy(*exact).agg(F.min_by("image_url", "position").alias("_a"))
    b = named.groupBy(*loose).agg(F.min_by("image_url", "position").alias("_b"))
    joined = selection.withColumn("_model", model).join(a, exact, "left").join(b, loose, "left")
    return joined.select(*selection.columns, F.coalesce("_a", "_b").alias("image_url"))


def registry_first(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry's brands, and those of files whose name (without case) it lacks."""
    known = registry.select(F.lower("name").alias("_k")).distinct()
    return registry.unionByName(files.join(known, F.lower("name") == F.col("_k"), "left_anti"))


def reprice_audit(catalogue: DataFrame, prices: DataFrame) -> DataFrame:
    """How many names of the price list there are, how many match, and how many products get a price."""
    key = F.lower(F.trim("name")).alias("_k")
    hits = catalogue.groupBy(F.lower(F.trim("model")).alias("_k")).agg(F.count("*").alias("_n"))
    return prices.select(key).where("_k is not null").distinct().join(hits, "_k", "left").agg(F.count("*").alias("names"), F.count("_n").alias("matched"), F.coalesce(F.sum("_n"), F.lit(0)).alias("updated"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts (success, products) in one row: successes, failures, products of the successes."""
    won = F.coalesce("success", F.lit(False))
    return attempts.agg(F.count_if(won).alias("successes"), F.count_if(~won).alias("failures"), F.coalesce(F.sum(F.when(won, F.col("products"))), F.lit(0)).cast("long").alias("products"))


def refetch(brands: DataFrame) -> DataFrame:
    """Brands (brand, category, products, needs_script) that are to be fetched anew: no products, or none in any category, or a page that needs scripts."""
    g = brands.groupBy("brand").agg(F.sum("products").alias("products"), F.count_if((F.col("category").isNotNull()) & (F.col("products") > 0)).alias("filled"), F.count("category").alias("categories"), F.coalesce(F.bool_or("needs_script"), F.lit(False)).alias("needs_script"))
    again = F.col("needs_script") | (F.coalesce("products", F.lit(0)) == 0) | ((F.col("categories") > 0) & (F.col("filled") == 0))
    return g.select("brand", "products", "categories", again.alias("refetch"))


#: Products of one piece of a collection.
PIECE = 1000


def collection_pieces(products: DataFrame, most: int = PIECE) -> DataFrame:
    """Collections in pieces of ``most`` products at most: (brand, tier, collection, piece, products), each piece in order of position. Products are dealt by a hash first and
    numbered within it, so no task holds a whole collection; a collection is the union of its pieces."""
    name = F.when(F.coalesce("subcategory", F.lit("")) == "", F.col("category")).otherwise(F.concat("category", F.lit(" > "), "subcategory"))
    rows = products.select("brand", "tier", name.alias("collection"), F.struct("position", "model", "price").alias("p"))
    keys = ["brand", "tier", "collection"]
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    dealt = rows.join(sizes, same).select(*keys, "p", "_n", F.pmod(F.xxhash64("p"), F.col("_n")).alias("_g"))
    part = F.floor((F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("p")) - 1) / most)
    numbered = dealt.withColumn("piece", F.col("_g") + F.col("_n") * part)
    return numbered.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list("p")).alias("products"))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """The products (brand, tier, collection, position, model, price) that ``write_collections`` wrote."""
    schema = "collection string, piece long, products array<struct<position:long,model:string,price:double>>, tier string, brand string"
    return spark.read.schema(schema).json(path).select("brand", "tier", "collection", F.inline("products"))


def assigned(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products (brand, model, category) with ``assigned``: the first category of their brand (name, position) that contains theirs or is contained in it
    (without case), else their product class if the brand has it, else General if the brand has it, else the brand's first; null without categories.
    A brand's categories are one short array, so the match stays within the row."""
    from tallyspark.operators.headers import product_class

    of_brand = categories.groupBy("brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda c: c["name"]).alias("_c"))
    own = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    near = F.filter("_c", lambda n: (own != "") & (F.contains(F.lower(n), own) | F.contains(own, F.lower(n))))
    has = lambda n: F.when(F.array_contains("_c", n), n)
    rows = products.join(of_brand, "brand", "left").withColumn("_k", product_class(F.col("model")))
    return rows.withColumn("assigned", F.coalesce(F.get(near, 0), has(F.col("_k")), has(F.lit("General")), F.get("_c", 0))).drop("_c", "_k")


def found_image(reference, images):
    """Of an array of image paths the first that contains the reference or is contained in it, else the first."""
    near = F.filter(images, lambda i: (reference != "") & (F.contains(i, reference) | F.contains(reference, i)))
    return F.coalesce(F.get(near, 0), F.get(images, 0))


def write_collections(products: DataFrame, path: str) -> None:
    """Pieces of nested collections as JSON, one folder per tier and brand, a large brand by several tasks; a rewrite replaces the folders that it has rows for as a whole."""
    out = collection_pieces(products).repartition("tier", "brand", "collection", "piece")
    out.write.partitionBy("tier", "brand").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def organised(products: DataFrame) -> DataFrame:
    """Products with a name (the model, else the last part of the URL if that has more than three characters, F14; names of controls go, and the note on the price goes off a name), labels of controls cleaned off their categories; of equal
    (brand, tier, category, subcategory, model) the last by position stays, and General gives way to a specific subcategory."""
    own = F.trim(F.regexp_replace("model", r"(?i)\(contact for price\)|contact for price", ""))
    own = F.when(~F.lower(F.trim("model")).isin(rules.NO_MODEL), own)
    named = products.withColumns({"model": F.coalesce(F.nullif(own, F.lit("")), F.when(F.coalesce(F.trim("model"), F.lit("")) == "", slug_name(F.col("source_url")))), "category": clean_category(F.col("category")), "subcategory": clean_category(F.col("subcategory"))})
    keys = ["brand", "tier", "category", "subcategory", "model"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("position")))
    kept = named.where("model is not null").withColumn("_r", rank).where("_r = 1").drop("_r")
    return without_general(kept)


def enriched_batch(tables: dict[str, DataFrame], details: DataFrame, fields: list[str]) -> DataFrame:
    """The tables of one batch of uploads in one relation, tagged by ``origin`` and enriched together, so that the details are merged once."""
    parts = [t.withColumn("origin", F.lit(name)) for name, t in tables.items()]
    return enriched(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), details, fields)
