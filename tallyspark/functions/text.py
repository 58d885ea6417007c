"""Scalar functions, Column to Column. Every one is a built-in expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import rules


def any_of(words: list[str]) -> str:
    """One alternation for many literal words."""
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words)


def round2(x: Column) -> Column:
    """Two decimals, half away from zero, in plain double arithmetic (equal in other engines)."""
    return F.signum(x) * F.floor(F.abs(x) * 100.0 + 0.5) / 100.0


def cents(x: Column) -> Column:
    return F.floor(x * 100.0 + 0.5).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.-]+", "")


def number(text: Column) -> Column:
    """a number with signs and currencies stripped; null if there is none."""
    return F.nullif(digits(text), F.lit("")).try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def price(text: Column) -> Column:
    """the first number, thousands commas dropped."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"\d+\.?\d*", 0), F.lit("")).try_cast("double")


def range_low(text: Column) -> Column:
    return F.try_element_at(F.split(text, "-"), F.lit(1)).try_cast("double")


def range_mid(text: Column) -> Column:
    """F5."""
    return round2((range_low(text) + F.try_element_at(F.split(text, "-"), F.lit(2)).try_cast("double")) / 2)


def price_range(p: Column) -> Column:
    """F6."""
    return F.when(p > 0, F.concat(F.floor(p).cast("string"), F.lit("-"), F.floor(p * 1.5).cast("string"))).otherwise("Contact for price")


def strip_tags(html: Column) -> Column:
    """tags out, the common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def image_sources(html: Column) -> Column:
    """F8."""
    return F.regexp_extract_all(html, F.lit("src=[\"']([^\"']+)[\"']"), 1)


CATEGORY_STEPS = [("[ \t\r\n]+", " "), (r"^ | $", ""), (r"(?i)^(open|close) +submenu *[(\[]?", ""), (r" *\([0-9]+\)$", ""), (r"[)\]]$", ""), (r"(?i)^toggle +", ""), (r"(?i)^(view|see|show|all) +", "")]


def clean_category(name: Column) -> Column:
    """the counter goes before the closing bracket, so that ``Chairs (10)`` is ``Chairs``."""
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), CATEGORY_STEPS, name))


def clean_title(title: Column, brand: str, strict: bool = True) -> Column:
    """F11; ``strict`` cuts at a dash between spaces only."""
    dash = r" +[-|] +.+$" if strict else r" *[-|] *.+$"
    steps = [(rf"(?i)\b{re.escape(brand)}\b", ""), (dash, ""), (r" *\([^)]*\)", ""), (r"(?i)\b(buy|shop|price|online)\b", "")]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, title))


def url_path_parts(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "product"))


def title_case(text: Column) -> Column:
    """words by space, hyphen or underscore."""
    return F.initcap(F.translate(text, "-_", "  "))


def category_from_url(url: Column) -> Column:
    """the first part of the path, else Products."""
    return F.coalesce(title_case(F.try_element_at(url_path_parts(url), F.lit(1))), F.lit("Products"))


def subcategory_from_url(url: Column) -> Column:
    return title_case(F.try_element_at(url_path_parts(url), F.lit(2)))


def absolute_url(href: Column, base: Column) -> Column:
    """F15."""
    root = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+", 0)
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def safe_key(text: Column) -> Column:
    """F20."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), "[^A-Za-z0-9_-]", "")


def lead_time(tier: Column, country: Column) -> Column:
    """F21."""
    base = reduce(lambda c, t: c.when(tier == t, rules.LEAD_TIME[t]), rules.TIERS[1:], F.when(tier == rules.TIERS[0], rules.LEAD_TIME[rules.TIERS[0]]))
    other = F.when(country.isin("China", "Taiwan", "Malaysia"), "4-6 weeks").otherwise("6-8 weeks")
    return F.when(country == "Turkey", F.when(tier == "budgetary", "3-5 weeks").otherwise("5-7 weeks")).otherwise(F.coalesce(base, other))


def listed(text: Column) -> Column:
    """a delimited list as an array."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda c: F.trim(c)), lambda x: x != "")


def found_words(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def dimensions(text: Column) -> Column:
    """whole matches, with their unit."""
    return F.regexp_extract_all(text, F.lit(r"\d+\s*[xX×]\s*\d+\s*[xX×]?\s*\d*\s*(mm|cm|m|inch|in|\")"), 0)


def specifications(text: Column) -> Column:
    """dimensions, materials and colours found; else the first 200 characters."""
    def line(label: str, items: Column, case: bool) -> Column:
        joined = F.array_join(items, ", ")
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.initcap(joined) if case else joined))

    found = F.array_compact(F.array(line("Dimensions: ", dimensions(text), False), line("Materials: ", found_words(text, rules.MATERIALS), True), line("Available Colors: ", found_words(text, rules.COLOURS), True)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.left(text, F.lit(200))))


def submittal_specifications(text: Column) -> Column:
    """the fixed lines of a submittal, four at most: material and finish as specified where the text names one, by standard unless it names both."""
    low, (material, finish, standard, colour, norm) = F.lower(text), map(F.lit, rules.SUBMITTAL_LINES)
    has = [F.coalesce(low.rlike(any_of(w)), F.lit(False)) for w in (rules.SUBMITTAL_MATERIALS, rules.SUBMITTAL_FINISHES)]
    lines = F.array(F.when(has[0], material), F.when(has[1], finish), F.when(~(has[0] & has[1]), standard), colour, norm)
    return F.slice(F.array_compact(lines), 1, 4)


def is_price_header(header: Column) -> Column:
    """P15."""
    return F.lower(header).rlike(any_of(rules.PRICE_HEADERS))


def is_summary(text: Column) -> Column:
    """P13."""
    return F.lower(text).rlike(any_of(rules.SUMMARY))


def category(text: Column) -> Column:
    """(category, subcategory) of the first rule that matches, else general."""
    low, out = F.lower(text), None
    for cat, sub, words in rules.category_rules():
        pair = F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory"))
        out = F.when(low.rlike(any_of(words)), pair) if out is None else out.when(low.rlike(any_of(words)), pair)
    return out.otherwise(F.struct(F.lit("general").alias("category"), F.lit("general").alias("subcategory")))


def wrapped(text: Column, width: int = 60) -> Column:
    """lines of at most ``width`` characters, broken at spaces; longer words stay whole."""
    lines = F.regexp_replace(text, rf"([^ \n]{{{width + 1},}}|[^\n]{{1,{width}}})(?: +|\n|\z)", "$1\n")
    return F.regexp_replace(lines, r"\n\z", "")


def wrapped_cell(text: Column, over: int = 50, width: int = 60) -> Column:
    """a cell of over ``over`` characters in lines of at most ``width``, joined by ``<br>``; words stay whole, white space between them is one space. Shorter cells stay as they are."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("used"))

    def add(acc: Column, word: Column) -> Column:
        n = F.length(word)
        on = F.struct(acc["lines"].alias("lines"), F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word)).alias("line"), (acc["used"] + n + 1).alias("used"))
        new = F.struct(F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))).alias("lines"), word.alias("line"), n.alias("used"))
        return F.when(acc["used"] + n + 1 <= width, on).otherwise(new)

    lines = F.aggregate(words, start, add, lambda acc: F.array_join(F.concat(acc["lines"], F.array(acc["line"])), "<br>"))
    return F.when(F.length(text) > over, lines).otherwise(text)


def slug_name(url: Column) -> Column:
    """the last part of a URL's path as a name, where it has more than three characters."""
    slug = title_case(F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1))
    return F.when(F.length(slug) > 3, slug)


def english_url(url: Column) -> Column:
    """F16: the Italian path becomes the English one; else the language is a parameter."""
    asked = F.concat(url, F.when(F.contains(url, F.lit("?")), "&lang=en").otherwise("?lang=en"))
    return F.when(F.contains(url, F.lit("/it/")), F.replace(url, F.lit("/it/"), F.lit("/en/"))).otherwise(asked)


def first_url(values: Column, preferred: list[str]) -> Column:
    """of a map the first preferred field that holds a URL, else the first value that does."""
    is_url = lambda v: F.startswith(v, F.lit("http"))
    fields = [F.try_element_at(values, F.lit(k)) for k in preferred]
    return F.coalesce(*[F.when(is_url(v), v) for v in fields], F.try_element_at(F.filter(F.map_values(values), is_url), F.lit(1)))


def brand_in(text: Column, brands: list[str], default: str) -> Column:
    """the first known brand in the text, else its first capitalised word of three letters or more, else ``default``."""
    known = F.filter(F.array(*map(F.lit, brands)), lambda b: F.contains(F.lower(text), F.lower(b)))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.nullif(F.regexp_extract(text, r"\b([A-Z][A-Za-z]{2,})", 1), F.lit("")), F.lit(default))
