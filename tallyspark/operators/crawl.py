"""Kinds of crawled pages and links, product ids of URLs, and where a page of words has its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import any_of, category_from_url, clean_title, subcategory_from_url
from tallyspark.operators.pages import listing_products
from tallyspark.operators.stitch import price_in_prose

# Patterns of links and pages.
NO_CATEGORY = r"#|javascript:|mailto:|tel:|login|register|account|cart|checkout|contact|about|faq|facebook|twitter|instagram|linkedin|youtube|\.(pdf|jpg|png|gif|zip)"
CATEGORY_WORDS = "category|collection|product|shop|furniture|chair|desk|table|sofa|storage|office"
NO_PRODUCT_PAGE = "/product-category/|/category/|/archive|/page/[0-9]+"
PRODUCT_PAGE = r"/(product|item|p)/[^/]+/?$|-[0-9]+\.html$"
CATEGORY_PAGE = "/product-category/|/category/|/product-tag/|/collection/|/shop/?$|/products/?$"
ABOUT = "about\\s+this\\s+product|description|über\\s+das\\s+produkt"
NOISE, MAIN_NOISE = "cookie|privacy|terms|menu|navigation|skip to", "cookie|privacy|menu|navigation|login|register"
PRODUCT_LINK = r"\[[^\n]*?\]\([^\n]*?/product/[^\n]*?\)"


def is_category_link(href: Column, text: Column) -> Column:
    """Links to a catalogue by their href, or else with a text of 2 to 50 characters; never those of accounts, social sites, files or
    scripts, by href or text. Links without href or text are none."""
    h, t = F.lower(F.coalesce(href, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    out = (h == "") | (t == "") | h.rlike(NO_CATEGORY) | t.rlike(NO_CATEGORY)
    return ~out & (h.rlike(CATEGORY_WORDS) | F.length(t).between(2, 50))


def page_kind(url: Column, markdown: Column, og_type: Column) -> Column:
    """``product`` by its URL or declared type unless the URL is a listing's, else ``category`` by its URL or three product links, else ``other``."""
    low = F.lower(F.coalesce(url, F.lit("")))
    product = ~low.rlike(NO_PRODUCT_PAGE) & (low.rlike(PRODUCT_PAGE) | (F.coalesce(og_type, F.lit("")) == "product"))
    listing = low.rlike(CATEGORY_PAGE) | (F.regexp_count(F.coalesce(markdown, F.lit("")), F.lit(PRODUCT_LINK)) >= 3)
    return F.when(product, "product").when(listing, "category").otherwise("other")


def url_id(url: Column) -> Column:
    """the number that ends a ``/p/`` name, a ``/product/`` number, the number that ends a ``/product/`` name, six digits anywhere in a
    product's URL, a number as last part; else the last part itself."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    ends = [found(p) for p in ("/p/[^/]+-([0-9]+)/?$", "/products?/([0-9]+)/?$", "/products?/[^/]+-([0-9]+)/?$")]
    return F.coalesce(*ends, F.when(url.rlike("/p/|/product"), found("([0-9]{6,})")), found("/([0-9]+)/?$"), found("/([^/]+)/?$"))


def table_region(words: DataFrame, fewest: int = 10) -> DataFrame:
    """Where each page of words (doc_id, page, x0, x1, top, text; page_left, page_top, page_right, page_bottom) has its table.

    Rows are words of one rounded ``top``; the outer tenths of the page are left out. The first row that names a column is the head: the table begins
    5 above it and spans its words and 20 to either side, within the page. It ends 20 below the last later row of three words or more with
    a digit, else where the lowest tenth begins. Pages of fewer than ``fewest`` words, or without a head, give nothing.
    """
    page, box = ["doc_id", "page"], ["page_left", "page_top", "page_right", "page_bottom"]
    tenth = (F.col("page_bottom") - F.col("page_top")) * 0.1
    w = words.withColumn("_n", F.count("*").over(Window.partitionBy(*page))).where(F.col("_n") >= fewest)
    w = w.withColumns({"low": F.col("page_top") + tenth, "high": F.col("page_bottom") - tenth}).where(F.col("top").between(F.col("low"), F.col("high")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: F.lower(x["text"])), " ")
    rows = w.withColumn("y", F.round("top", 1)).groupBy(*page, "y").agg(text.alias("line"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*box, "high")])
    names = any_of([v for role in rules.ROLES.values() for v in role])
    rows = rows.withColumn("head", F.min(F.when(F.col("line").rlike(names), F.col("y"))).over(Window.partitionBy(*page))).where("y >= head")
    data = F.when((F.col("y") > F.col("head")) & (F.col("n") >= 3) & F.col("line").rlike("[0-9]"), F.col("y"))
    at_head = F.col("y") == F.col("head")
    found = rows.groupBy(*page).agg(
        F.min("head").alias("header_y"), (F.min("head") - 5).alias("top"), F.coalesce(F.max(data) + 20, F.first("high")).alias("bottom"),
        F.greatest(F.first("page_left"), F.min(F.when(at_head, F.col("x0"))) - 20).alias("left"), F.least(F.first("page_right"), F.max(F.when(at_head, F.col("x1"))) + 20).alias("right"),
    )
    return found


def new_by_page(products: DataFrame, key: str = "source_url", page: str = "page") -> DataFrame:
    """How many products each page of a listing brings that no earlier one had, and whether the listing is read up to it: it ends with the
    first page that brings nothing new. (site, page, new, wanted)"""
    first = products.groupBy("site", key).agg(F.min(page).alias("_first"))
    seen = products.select("site", page).distinct()
    counted = seen.join(first.groupBy("site", F.col("_first").alias(page)).agg(F.count("*").alias("new")), ["site", page], "left").fillna(0, ["new"])
    ends = counted.groupBy("site").agg(F.min(F.when(F.col("new") == 0, F.col(page))).alias("_end"))
    return counted.join(ends, "site").select("site", page, "new", (F.col("_end").isNull() | (F.col(page) < F.col("_end"))).alias("wanted"))


def _meta(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("metadata", F.lit(name))), F.lit(""))


def _group(text: Column, pattern: str) -> Column:
    """The first group of the pattern's first match; null where it is missing or empty."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def crawled_products(pages: DataFrame, brand: str) -> DataFrame:
    """Products of the pages (page_id, url, markdown, metadata) of a crawl, each with its collection.

    A product's page (``page_kind``) gives one: title, image and description from the metadata, else the first heading, image and paragraph (200
    characters) of its text, and the price in its text. A listing gives those that it links to. Titles of fewer than three characters, and
    pages that are neither, give none. Collections are ``category > subcategory`` by the page's URL; a listing without one is ``general``.
    """
    text = F.coalesce("markdown", F.lit(""))
    read = pages.withColumns({"_kind": page_kind(F.col("url"), F.col("markdown"), _meta("ogType")), "category": category_from_url(F.col("url")), "subcategory": subcategory_from_url(F.col("url"))})
    one = read.where("_kind = 'product'").select(
        "page_id", F.col("url").alias("source_url"), clean_title(F.coalesce(_meta("title"), _group(text, r"(?m)^#\s+(.+)$")), brand, strict=False).alias("model"),
        F.coalesce(_meta("ogImage"), _group(text, r"!\[.*?\]\((https?://[^)]+)\)")).alias("image_url"), price_in_prose(text).alias("price"),
        F.coalesce(_meta("description"), F.left(_group(text, r"(?s)\n\n(.+?)\n\n"), F.lit(200))).alias("description"), "category", "subcategory",
    ).where(F.length("model") >= 3)
    listed = read.where("_kind = 'category'").select("page_id", "markdown", "category", F.coalesce("subcategory", F.lit("general")).alias("subcategory"))
    inner = listing_products(listed.withColumn("page_id", F.struct("page_id", "category", "subcategory")))
    many = inner.select("page_id.page_id", F.col("target").alias("source_url"), F.col("title").alias("model"), "page_id.category", "page_id.subcategory")
    return one.unionByName(many, allowMissingColumns=True).withColumn("collection", F.concat_ws(" > ", "category", "subcategory"))
