"""One table out of the tables of a document's pages, its line items and costed rows, and the choice between candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import any_of, brand_in, category, digits, image_sources, number, number_or_zero, round2, specifications, strip_tags
from tallyspark.operators.costing import FACTORS, SHARES, share, under_factors, under_scenarios
from tallyspark.operators.headers import hits, lowered

_BLANK = "[\\s ​‌‍﻿]+"


def _line(cells) -> Column:
    return F.lower(F.array_join(cells, " ", ""))


def stitched(grid: DataFrame, dedup: bool = False) -> DataFrame:
    """Rows (doc_id, page, table_idx, row_idx, cells) of all of a document's tables -> (doc_id, row_no, headers, cells) under one header.

    Only the first row of a table can be a header: one that has a header word (P3). The document's header is that of its first table that has one, and
    leaves the rows; so do the first rows of later tables that are headers, unless they are all of their table. All other rows stay, in order: those of tables
    before the header, those of documents without any (``headers`` null), titles and notes. Blank rows (P2) go. With ``dedup`` of equal rows the first stays.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "table_idx", "row_idx")
    table = Window.partitionBy("doc_id", "page", "table_idx")
    leads = (F.col("row_idx") == F.min("row_idx").over(table)) & _line(F.col("cells")).rlike(any_of(rules.HEADER_WORDS))
    marked = grid.select("doc_id", "page", "table_idx", "row_idx", "cells", leads.alias("_leads"), F.count("*").over(table).alias("_rows"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    main = F.first(F.when(F.col("_leads"), F.struct("page", "table_idx", F.col("cells").alias("headers"))), ignorenulls=True).over(whole)
    rows = marked.withColumn("_main", main)
    own = (F.col("page") == F.col("_main.page")) & (F.col("table_idx") == F.col("_main.table_idx"))
    blank = ~F.exists("cells", lambda c: F.length(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), _BLANK, "")) > 0)
    out = rows.where(~blank & ~(F.col("_leads") & (own | (F.col("_rows") > 1)))).withColumn("headers", F.col("_main.headers"))
    if dedup:
        same = Window.partitionBy("doc_id", F.transform("cells", lambda c: F.trim(c))).orderBy("page", "table_idx", "row_idx")
        out = out.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    return out.select("doc_id", F.row_number().over(order).alias("row_no"), "headers", "cells")


def field(headers, cells, keys: list[str]) -> Column:
    """The cell under the first header that has the first key in it; the next key if no header has."""
    low = lowered(headers)
    first = lambda key: F.nullif(F.array_position(F.transform(low, lambda h: F.contains(h, F.lit(key))), F.lit(True)), F.lit(0))
    return F.get(cells, (F.coalesce(*map(first, keys)) - 1).cast("int"))


def table_items(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Line items of stitched rows (headers, cells): a description of five characters, and a quantity or a rate. Rows with
    fewer cells than headers, as titles of sections, are none; nor are headers that come again: two of the words or more and no number
    (``strict``), or one of the words of repeated headers. Rows without headers have no fields, so they are none either."""
    line = _line(F.col("cells"))
    again = (hits(line, rules.ITEM_HEADERS) >= 2) & ~F.exists("cells", lambda c: number(c).isNotNull()) if strict else line.rlike(any_of(rules.REPEATED_HEADERS))
    of = {name: F.trim(field("headers", "cells", keys)) for name, keys in rules.ITEM_FIELDS.items()}
    items = rows.where(F.col("headers").isNotNull() & (F.size("cells") >= F.size("headers")) & ~again)
    items = items.select("doc_id", "row_no", *[(number_or_zero(c) if n in ("qty", "unit_rate", "total") else c).alias(n) for n, c in of.items()])
    items = items.where((F.length("description") >= 5) & ((F.col("qty") > 0) | (F.col("unit_rate") > 0)))
    return items.withColumn("_c", category(F.col("description"))).select("*", "_c.category", "_c.subcategory").drop("_c")


def _last(test) -> Column:
    """The position (from 0) of the last lower-cased header that meets the test."""
    return F.array_max(F.filter(F.transform(lowered("headers"), lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull()))


def _is_qty(h: Column) -> Column:
    return h.rlike("qty|quantity")


def _is_rate(h: Column) -> Column:
    return h.rlike("unit rate|unit price") & ~_is_qty(h)


def _is_total(h: Column) -> Column:
    return h.isin("total", "amount", "total amount")


def _two_decimals(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


def recomputed(rows: DataFrame) -> DataFrame:
    """The total of rows (headers, cells) from quantity and unit rate, where a table has all three columns and both are numbers."""
    value = number(F.get("cells", _last(_is_qty))) * number(F.get("cells", _last(_is_rate)))
    out = rows.withColumns({"_t": _last(_is_total), "_v": _two_decimals(round2(value))})
    # no lambda: what is put into one is worked out again for every cell
    cells = F.concat(F.slice("cells", F.lit(1), F.col("_t")), F.array("_v"), F.slice("cells", F.col("_t") + 2, F.size("cells")))
    return out.withColumn("cells", F.when(F.col("_v").isNotNull() & (F.col("_t") < F.size("cells")), cells).otherwise(F.col("cells"))).drop("_t", "_v")


def costed_rows(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """X1, X2, J12 on text: stitched rows under each scenario. Numbers under price headers are costed, then totals are made anew from the costed
    rate. Rows without headers stay as they are. ``factors`` is the user's short list of scenarios.

    Cells are read as numbers, and columns found, once per row below the join; above it there is arithmetic, and each changed cell is written once.
    """
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    named = lambda h, words: reduce(Column.__or__, [F.contains(h, F.lit(w)) for w in words])

    def kinds(header: Column, i: Column) -> Column:
        """What ``is_price_header``, ``_is_qty``, ``_is_rate`` and ``_is_total`` find, in one look at a header and without patterns; positions for the last three."""

        def of(h: Column) -> Column:
            qty = named(h, ["qty", "quantity"])
            rate = named(h, ["unit rate", "unit price"]) & ~qty
            return F.struct(named(h, rules.PRICE_HEADERS).alias("p"), F.when(qty, i).alias("q"), F.when(rate, i).alias("r"), F.when(_is_total(h), i).alias("t"))

        return once(F.lower(F.trim(F.coalesce(header, F.lit("")))), of)

    # no lambda around the headers: what is put into one is worked out again for every cell
    read = rows.withColumn("_k", F.coalesce(F.transform("headers", kinds), F.transform(F.array().cast("array<string>"), kinds)))
    asked = F.zip_with("cells", "_k", lambda c, k: F.when(k["p"] | k["q"].isNotNull() | k["r"].isNotNull(), digits(c)))
    value = F.transform(asked, lambda t: F.nullif(t, F.lit("")).try_cast("double"))
    read = read.withColumns({"_v": value, "_p": F.col("_k.p"), **{f"_{k}": F.array_max(F.col(f"_k.{k}")) for k in "qrt"}}).drop("_k")
    out = under_scenarios(read, factors.withColumns({f: share(f) for f in SHARES}))
    at = lambda new, k: F.coalesce(F.get(new, F.col(k)), F.get("_v", F.col(k)))

    def written(new: Column, total: Column) -> Column:
        values = F.transform("cells", lambda _, i: F.when(i == F.col("_t"), F.coalesce(round2(total), F.get(new, i))).otherwise(F.get(new, i)))
        return F.zip_with(values, "cells", lambda v, c: F.coalesce(_two_decimals(v), c))

    raw = F.zip_with("_v", "_p", lambda v, p: F.when(p & v.isNotNull(), under_factors(v, F.col)))  # rounded apart: a lambda works out each mention of a value
    cells = once(F.transform(raw, round2), lambda n: once(at(n, "_q") * at(n, "_r"), lambda total: written(n, total)))
    return out.withColumn("cells", cells).drop("_v", "_p", "_q", "_r", "_t", *FACTORS)


def candidates(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (table_idx, method, score) by score and their method's bonus; those that have 0.9 of the first one's own score stay, with their rank."""
    bonus = reduce(lambda c, m: c.when(F.col("method") == m[0], m[1]), rules.METHOD_BONUS.items(), F.when(F.lit(False), 0)).otherwise(0)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("score") + bonus), F.desc("score"), "table_idx")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "_best": F.first("score").over(order)})
    return ranked.where(F.col("score") >= 0.9 * F.col("_best")).drop("_best")


def latest(files: DataFrame, keys: list[str]) -> DataFrame:
    """T4: the file (name) that is last by name."""
    return files.groupBy(*keys).agg(F.max("name").alias("name"))


def uploaded(files: DataFrame) -> DataFrame:
    """Files that a user gave, not those made as tiers of an offer, and what has been made of each."""
    flags = {f"has_{kind}": F.col(kind).isNotNull() for kind in ("extraction", "stitched", "costed")}
    return files.where(~F.coalesce("multibudget", F.lit(False))).withColumns(flags)


def first_strategy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of several strategies (0, 1, ...) those of the first that found any."""
    least = F.min("strategy").over(Window.partitionBy(*keys))
    return rows.withColumn("_s", least).where(F.col("strategy") == F.col("_s")).drop("_s")


def from_top(rows: DataFrame, keys: list[str]) -> DataFrame:
    """T5: rows numbered from the top of their page (``y``)."""
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")))


def price_in_prose(text: Column) -> Column:
    """the number after a currency or the word price, else that before a currency; null if there is neither."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in rules.PRICE_IN_PROSE])


def display(text: Column, numeric: Column) -> Column:
    """numbers of numeric columns with separators and two decimals; texts of over 800 characters are cut to 797 and three dots."""
    shown = F.when(numeric & number(text).isNotNull(), F.format_number(number(text), 2)).otherwise(text)
    return F.when(F.length(shown) > 800, F.concat(F.left(shown, F.lit(797)), F.lit("..."))).otherwise(shown)


def submittal_items(rows: DataFrame, brands: list[str] | None = None, unknown: str = "To be specified") -> DataFrame:
    """X11: ``rows`` (headers, cells) of tables as items of a submittal: description, qty, unit, brand, specifications, images, image, finish, warranty.

    The description is that of the first column named so, else of the last item or product column; rows without one go, and tables without
    such a column. Quantity and unit come from the last columns named so (null without); images from all cells.
    """
    is_qty = lambda h: h.rlike("qty|quantity")
    named = F.array_min(F.filter(F.transform(lowered("headers"), lambda h, i: F.when(h.rlike("descript|discript"), i)), lambda i: i.isNotNull()))
    cell = lambda at: strip_tags(F.get("cells", at))
    out = rows.withColumns({
        "description": cell(F.coalesce(named, _last(lambda h: h.rlike("item|product")))),
        "qty": cell(_last(is_qty)),
        "unit": cell(_last(lambda h: F.contains(h, F.lit("unit")) & ~F.contains(h, F.lit("rate")) & ~is_qty(h))),
        "images": F.flatten(F.transform("cells", lambda c: F.when(F.contains(c, F.lit("<img")), image_sources(c)).otherwise(F.array().cast("array<string>")))),
    })
    out = out.where(F.coalesce("description", F.lit("")) != "")
    more = {"brand": brand_in(F.col("description"), brands or rules.KNOWN_MAKERS, unknown), "specifications": specifications(F.col("description")), "image": F.get("images", F.lit(0))}
    return out.withColumns(more | {"finish": F.lit("As per manufacturer standard"), "warranty": F.lit("5 Years")})
