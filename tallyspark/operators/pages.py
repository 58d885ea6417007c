"""Links, categories and products out of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import absolute_url, any_of, clean_category, strip_tags, title_case

#: The first group keeps its quotes, if it has any.
ANCHOR = r"(?is)<a\s(?:[^>]*\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)[^>]*>(.*?)</a>"
# Paths of products and of categories.
PRODUCT_PATH = "/product/|/products/|/item/|/detail/|/p/|prodotto|scheda"
CATEGORY_PATH = "/product-category/|/category/|/categories/|/collection/|/collections/"
# Makers whose hosts are routed alike.
ITALIAN_MAKERS = ["martex", "manerba", "las", "frezza", "fantoni", "della valentina", "bralco", "ibebi", "estel", "arcadia", "unifor"]


def links(pages: DataFrame, within: str | None = None) -> DataFrame:
    """(page_id, url, pos, href, target, text) of every anchor, or of those in one element such as ``nav``."""
    html = F.col("html") if within is None else F.array_join(F.regexp_extract_all("html", F.lit(f"(?is)<{within}[^>]*>(.*?)</{within}>"), 1), " ")
    spans = pages.select("page_id", "url", html.alias("_h"))
    href = F.transform(F.regexp_extract_all("_h", F.lit(ANCHOR), 1), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    pair = F.arrays_zip(href.alias("href"), F.regexp_extract_all("_h", F.lit(ANCHOR), 2).alias("text"))
    rows = spans.select("page_id", "url", F.posexplode(pair).alias("pos", "a"))
    return rows.select("page_id", "url", "pos", F.col("a.href").alias("href"), absolute_url(F.col("a.href"), F.col("url")).alias("target"), strip_tags(F.col("a.text")).alias("text"))


def page_kind(url):
    """By the patterns of the URL."""
    return F.when(F.lower(url).rlike(CATEGORY_PATH), "category").when(F.lower(url).rlike(PRODUCT_PATH), "product").otherwise("other")


def categories(pages: DataFrame) -> DataFrame:
    """Navigation links with a fitting name, each once per site, the first seen."""
    found = links(pages, "nav").withColumns({"site": F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1), "category": clean_category(F.col("text"))})
    found = found.where(F.length("category").between(2, 50) & ~F.lower("href").rlike("^(mailto|tel|javascript):|^#"))
    rank = F.row_number().over(Window.partitionBy("site", "category").orderBy("page_id", "pos"))
    return found.withColumn("_r", rank).where("_r = 1").select("site", "category", "target", "page_id")


def sentences_once(docs: DataFrame, text: str, cap: int = 1500) -> DataFrame:
    """U8: of equal sentences (without case) the first stays, in order; the result is cut at ``cap`` characters."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.col(text), r"\. ")).alias("pos", "s")).withColumn("_k", F.lower(F.trim("s")))
    first = rows.groupBy("doc_id", "_k").agg(F.min("pos").alias("pos"), F.min_by("s", "pos").alias("s")).where("_k <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), ". ")
    return first.groupBy("doc_id").agg(F.left(joined, F.lit(cap)).alias("about"), F.count("*").alias("sentences"))


def product_links(pages: DataFrame) -> DataFrame:
    """Links of a page whose path looks like a product's and not like a category's, each target once, the first seen."""
    found = links(pages).where(F.lower("target").rlike(PRODUCT_PATH) & ~F.lower("target").rlike(CATEGORY_PATH))
    return found.groupBy("page_id", "target").agg(F.min("pos").alias("pos"))


def product(pages: DataFrame, most: int = 200) -> DataFrame:
    """Title from the first heading, else the page's title; description from the first paragraph, ``most`` characters; null where there is none."""
    inner = lambda tag: F.nullif(strip_tags(F.regexp_extract("html", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    return pages.select("page_id", F.coalesce(inner("h1"), inner("title")).alias("title"), F.left(inner("p"), F.lit(most)).alias("description"))


def site_kind(url):
    """Which kind of site a URL is from, the first that fits: a design portal, a page of collections, an Italian maker, other."""
    host, path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    collections = F.contains(path, F.lit("/collections/")) | (F.contains(path, F.lit("/b/")) & F.contains(path, F.lit("/products")))
    italian = (F.endswith(host, F.lit(".it")) & path.rlike("prodotti|products|collezioni|collections")) | host.rlike(any_of(ITALIAN_MAKERS))
    return F.when(F.contains(host, F.lit("architonic.com")), "portal").when(collections, "collections").when(italian, "italian").otherwise("other")


def listing_products(pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Links of a markdown page to ``/product/`` pages: (page_id, target, title), each target once, the first seen; controls and category links go."""
    link = F.lit(r"\[([^\]]+)\]\((https?://[^)]+/product/[^)]+)\)")
    pair = F.arrays_zip(F.regexp_extract_all(markdown, link, 1).alias("title"), F.regexp_extract_all(markdown, link, 2).alias("target"))
    rows = pages.select("page_id", F.posexplode(pair).alias("pos", "p")).select("page_id", "pos", "p.target", F.trim("p.title").alias("title"))
    good = rows.where((F.length("title") >= 3) & ~F.lower("title").rlike(any_of(rules.LISTING_SKIP)) & ~F.lower("target").rlike("/product-category/|/category/|/tag/"))
    return good.groupBy("page_id", "target").agg(F.min_by("title", "pos").alias("title"))


def listing_sections(pages: DataFrame, markdown: str = "markdown", most: int = 200) -> DataFrame:
    """Sections of a markdown page, from ``###`` to the next one, that link to a ``/product/`` page: (page_id, pos, title, target, image_url, description). Sections about filters
    and views go; the description is the first ``most`` characters of a section."""
    parts = F.split(F.coalesce(F.col(markdown), F.lit("")), "###")
    rows = pages.select("page_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "_s"))
    body = F.regexp_extract("_s", r"(?s)^[^\n]*\n+(.*)$", 1)
    one = lambda pattern: F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))
    found = rows.select(
        "page_id", "pos", F.trim(F.regexp_extract("_s", r"^\s+\[?([^\]\n]+)", 1)).alias("title"), one(r"\((https?://[^)]+/product/[^)]+)\)").alias("target"),
        one(r"!\[.*?\]\((https?://[^)]+)\)").alias("image_url"), F.regexp_replace(F.left(body, F.lit(most)), r"^\s+|\s+$", "").alias("description"),
    )
    return found.where(F.col("target").isNotNull() & (F.col("title") != "") & ~F.lower("title").rlike(any_of(rules.SECTION_SKIP)))


def listing(pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Products of a listing: those it links to, then those of its sections that it does not: (page_id, target, title, image_url, description)."""
    linked = listing_products(pages, markdown)
    first = listing_sections(pages, markdown).groupBy("page_id", "target").agg(F.min_by(F.struct("title", "image_url", "description"), "pos").alias("x"))
    more = first.select("page_id", "target", "x.*").join(linked.select("page_id", "target"), ["page_id", "target"], "left_anti")
    return linked.unionByName(more, allowMissingColumns=True)


def subcategory_links(pages: DataFrame) -> DataFrame:
    """Links that go on from their own page's path, or lead to a category; the cleaned name is none of the page's own title: (page_id, name, target)."""
    here = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "/$", "")
    found = links(pages).withColumns({"name": clean_category(F.col("text")), "here": here})
    below = F.startswith("target", F.concat("here", F.lit("/"))) | F.lower("target").rlike("/product-category/|/category/")
    good = found.where(below & (F.length("name") >= 2) & (F.regexp_replace("target", "/$", "") != F.col("here")))
    own = pages.select("page_id", F.coalesce(clean_category(strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))), F.lit("")).alias("own"))
    return good.join(own, "page_id").where("name <> own").groupBy("page_id", "name").agg(F.min_by("target", "pos").alias("target"))


def collection_links(pages: DataFrame) -> DataFrame:
    """Links to ``/typologies/name`` and ``/collection/name/id``: (page_id, kind, target, name); the name is the text, else the slug."""
    path = F.regexp_extract("target", r"(?i)/(typologies|collection)/([^/?#]+)", 2)
    kind = F.lower(F.regexp_extract("target", r"(?i)/(typologies|collection)/([^/?#]+)", 1))
    fits = F.lower("target").rlike("/typologies/[^/?#]+|/collection/[^/?#]+/[0-9]+")
    found = links(pages).where(fits).withColumns({"kind": kind, "name": F.coalesce(F.nullif("text", F.lit("")), title_case(path))})
    return found.groupBy("page_id", "kind", "target").agg(F.min_by("name", "pos").alias("name"))


def link_title(text, heading, data, url, alt, brand: str = ""):
    """The first of link text, heading, data attribute, slug without brand and id, and image text that is no generic word."""
    slug = F.regexp_replace(F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1), rf"(?i)^{brand}-|-[0-9]{{4,}}$", "")
    generic = lambda c: F.lower(F.trim(c)).isin("view", "more", "read more", "details", "product", "products", "image", "")
    return F.coalesce(*[F.when(~generic(c), F.trim(c)) for c in (text, heading, data, title_case(slug), alt)])


def features(pages: DataFrame, most: int = 10) -> DataFrame:
    """The first list items and two-cell table rows of a page as features: (page_id, features); what is in ``nav`` is left out."""
    html = F.regexp_replace("html", r"(?is)<nav[^>]*>.*?</nav>", "")
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1), strip_tags)
    pair = r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*</tr>"
    names, texts = F.regexp_extract_all(html, F.lit(pair), 1), F.regexp_extract_all(html, F.lit(pair), 2)
    rows = F.transform(F.arrays_zip(names.alias("n"), texts.alias("t")), lambda r: F.concat(strip_tags(r["n"]), F.lit(": "), strip_tags(r["t"])))
    return pages.select("page_id", F.slice(F.filter(F.concat(items, rows), lambda x: F.length(x) > 2), 1, most).alias("features"))


def crumbs(pages: DataFrame) -> DataFrame:
    """Names in the element whose class says ``breadcrumb``, in order: (page_id, crumbs, category, subcategory); the first one is home."""
    block = F.regexp_extract("html", r"(?is)<([a-z]+)[^>]*class=\"[^\"]*breadcrumb[^\"]*\"[^>]*>(.*?)</\1>", 2)
    names = F.filter(F.transform(F.regexp_extract_all(block, F.lit(ANCHOR), 2), strip_tags), lambda x: x != "")
    return pages.select("page_id", names.alias("crumbs"), F.get(names, 1).alias("category"), F.get(names, 2).alias("subcategory"))


#: Lengths of the pieces by which names are looked up in texts, longest first; shorter names by their own length.
PIECES = (8, 4)


def _piece_length(name):
    n = F.length(name)
    return F.coalesce(*[F.when(n >= k, F.lit(k)) for k in PIECES], n)


def _pieces(text, n):
    """The different pieces of ``n`` characters; the empty one for 0."""
    last = F.length(text) - n + 1
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when((n > 0) & (last >= 1), F.array_distinct(found)).when(n == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def model_candidates(models: DataFrame, page_links: DataFrame) -> DataFrame:
    """Pairs (site, model, page_id, pos) of models and links of their site that can match: the link's text has the model's rarest piece among all of
    the site's texts. Models with a piece that no text has are left out."""
    a = models.select("site", "model").distinct().withColumns({"_m": F.lower("model")}).withColumn("_n", _piece_length(F.col("_m")))
    own = a.select("site", "model", "_n", F.explode(_pieces(F.col("_m"), F.col("_n"))).alias("_p"))
    lengths = a.select("site", "_n").distinct()
    texts = page_links.select("site", "page_id", "pos", F.lower("text").alias("_t")).join(lengths, "site")
    key = ["site", "_n", "_p"]
    index = texts.select("site", "page_id", "pos", "_n", F.explode(_pieces(F.col("_t"), F.col("_n"))).alias("_p")).join(own.select(*key).distinct(), key, "left_semi")
    often = own.join(index.groupBy(*key).count(), key, "left")
    picked = often.groupBy("site", "model", "_n").agg(F.min_by("_p", F.struct("count", "_p")).alias("_p"), F.bool_and(F.col("count").isNotNull()).alias("_all")).where("_all")
    return index.join(picked.select(*key, "model"), key).select("site", "model", "page_id", "pos")


def linked_models(models: DataFrame, page_links: DataFrame) -> DataFrame:
    """Models (site, model) with the first link (site, page_id, pos, target, text) of their site whose text contains the name, without case.

    Names are looked up by their rarest piece (``model_candidates``) and then compared, so a site's models do not meet all of its links. ``page_id`` and ``pos`` tell links apart.
    """
    texts = page_links.select("site", "page_id", "pos", "target", F.lower("text").alias("_t"))
    hit = model_candidates(models, page_links).join(texts, ["site", "page_id", "pos"]).where(F.contains("_t", F.lower("model")))
    return hit.groupBy("site", "model").agg(F.min_by("target", F.struct("page_id", "pos")).alias("target"))
