"""Headers of tables: finding, naming and cleaning them, and the rows that fit them.

A grid row is (doc_id, table_idx, row_idx, cells); what works on arrays stays within its row and shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import any_of, strip_tags
from tallyspark.operators.tables import is_section

TABLE = ["doc_id", "table_idx"]


def lowered(cells) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words are in a text."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def without_ui_columns(grid: DataFrame) -> DataFrame:
    """Rows (headers, cells) without the columns whose header names a control."""
    keep = lambda i: ~F.coalesce(F.get(lowered("headers"), i), F.lit("")).isin(rules.UI_HEADERS)
    return grid.withColumn("cells", F.filter("cells", lambda c, i: keep(i))).withColumn("headers", F.filter("headers", lambda h, i: keep(i)))


def is_header_text(html: Column) -> Column:
    """One of the header words is in the text without tags."""
    return F.lower(F.regexp_replace(html, "<[^>]+>", "")).rlike(any_of(rules.HEADER_WORDS))


def located_headers(grid: DataFrame, fewest: int = 3) -> DataFrame:
    """(doc_id, table_idx, header_row, headers): of the first three rows, titles of sections left out, the first with
    ``fewest`` header words; else row -1 and ``Column i`` as wide as the first row that is no title."""
    plain = ~F.coalesce(is_section(F.col("cells")), F.lit(False))
    found = plain & (F.col("row_idx") < 3) & (hits(F.lower(F.array_join("cells", " ", "")), rules.HEADER_HITS) >= fewest)
    numbered = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    best = grid.groupBy(*TABLE).agg(
        F.min(F.when(found, F.col("row_idx"))).alias("header_row"),
        F.min_by(F.when(found, F.col("cells")), F.when(found, F.col("row_idx"))).alias("headers"),
        F.min_by(F.size("cells"), F.when(plain, F.col("row_idx"))).alias("_n"),
    )
    named = F.transform("headers", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))))
    generic = F.when(F.col("_n") > 0, numbered(F.col("_n"))).otherwise(F.array().cast("array<string>"))
    return best.select(*TABLE, F.coalesce("header_row", F.lit(-1)).alias("header_row"), F.coalesce(named, generic).alias("headers"))


def role(header: Column) -> Column:
    """The first role one of whose variants is the header, begins it before a space or ends it after one; else null."""
    low = F.lower(F.trim(header))
    pattern = lambda v: rf"^({any_of(v)})($| )| ({any_of(v)})$"
    return F.coalesce(*[F.when(low.rlike(pattern(v)), r) for r, v in rules.ROLES.items()])


def by_role(rows: DataFrame) -> DataFrame:
    """Rows (headers, cells) with one column for each of the ten roles, from the first header that has it."""
    named = rows.withColumn("_roles", F.transform("headers", role))
    return named.withColumns({r: F.get("cells", (F.array_position("_roles", F.lit(r)) - 1).cast("int")) for r in rules.ROLES}).drop("_roles")


def is_data(cells) -> Column:
    """P5: a number from 1 to 1000 in the first cell, two amounts of money or more, or a cell of over 50 characters."""
    first = F.when(F.trim(F.get(cells, 0)).rlike("^[0-9]{1,4}$"), F.trim(F.get(cells, 0)).cast("int").between(1, 1000))
    money = F.size(F.filter(cells, lambda c: c.rlike(r"^\s*([A-Z]{2,3}|[$€£])?\s*[0-9][0-9,]*\.[0-9]{2}\s*$"))) >= 2
    return F.coalesce(first, F.lit(False)) | money | F.exists(cells, lambda c: F.length(c) > 50)


def detected_header(grid: DataFrame) -> DataFrame:
    """P5: (doc_id, table_idx, header_row): of the first two rows the first that is no data and has role words (two in
    tables of two rows or fewer), else the second if it is no data, else row 0."""
    # only the first two rows are read: the others are counted, in the same pass
    top = F.col("row_idx") <= 1
    read = F.when(top, F.struct(F.size(F.array_compact(F.transform("cells", role))).alias("roles"), (~is_data(F.col("cells"))).alias("plain")))
    rows = grid.select(*TABLE, "row_idx", read.alias("_r"))

    def first(fewest: int) -> Column:
        good = F.col("_r.plain") & (F.col("_r.roles") >= fewest)
        order = F.when(good, F.col("row_idx")).when((F.col("row_idx") == 1) & F.col("_r.plain"), 2).when(F.col("row_idx") == 0, 3).otherwise(4)
        return F.min_by("row_idx", F.when(top, order))

    found = rows.groupBy(*TABLE).agg(F.count("*").alias("_n"), F.count_if(top).alias("_top"), first(1).alias("_one"), first(2).alias("_two"))
    return found.where("_top > 0").select(*TABLE, F.when(F.col("_n") <= 2, F.col("_two")).otherwise(F.col("_one")).alias("header_row"))


def _first_of_each(headers) -> tuple[Column, Column]:
    low = lowered(headers)
    return low, F.filter(F.array_distinct(low), lambda h: h != "")


def clean_headers(headers) -> Column:
    """Blank headers go, of equal ones (without case) the first stays, and the common ones get their standard name."""
    low, kept = _first_of_each(headers)

    def standard(h: Column) -> Column:
        own = F.get(headers, (F.array_position(low, h) - 1).cast("int"))
        return reduce(lambda c, s: c.when(h.rlike(s[0]), s[1]), rules.STANDARD_HEADERS[1:], F.when(h.rlike(rules.STANDARD_HEADERS[0][0]), rules.STANDARD_HEADERS[0][1])).otherwise(own)

    return F.transform(kept, standard)


def aligned_cells(headers, cells) -> Column:
    """One cell for each header of ``clean_headers``; cells of merged columns are joined by a space, blank ones left out."""
    low, kept = _first_of_each(headers)
    pair = F.arrays_zip(low.alias("h"), F.transform(cells, lambda c: F.trim(c)).alias("c"))
    return F.transform(kept, lambda h: F.array_join(F.transform(F.filter(pair, lambda p: (p["h"] == h) & (p["c"] != "")), lambda p: p["c"]), " "))


def is_non_table_row(text: Column, phrases: list[str] = rules.NON_TABLE) -> Column:
    """P10: a phrase from outside tables, or fewer than two words."""
    # plain searches and a pattern that ends at the second word: an alternation of all phrases is tried at every place of a long text
    low = F.lower(text)
    outside = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])
    return ~text.rlike(r"[^ \t\r\n][ \t\r\n]+[^ \t\r\n]") | outside | low.rlike("|".join(rules.NON_TABLE_PATTERNS))


def has_table_content(text: Column, phrases: list[str] = rules.NON_TABLE_PAGE) -> Column:
    """Five numbers at least, and not more outside phrases than roles where there are fewer than two roles."""
    low = F.lower(text)
    roles = reduce(lambda a, b: a + b, [low.rlike(any_of(v)).cast("int") for v in rules.ROLES.values()])
    outside = reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])
    return ~((outside > roles) & (roles < 2)) & (F.regexp_count(text, F.lit("[0-9]+")) >= 5)


def is_valid_row(headers, cells) -> Column:
    """No repeat of the header, and something in one cell."""
    return (lowered(headers) != lowered(cells)) & F.exists(lowered(cells), lambda c: ~c.isin("", "nan", "none"))


def text_columns(grid: DataFrame, rows: int = 4) -> DataFrame:
    """(doc_id, table_idx, col_idx, mean_length, is_text) over the first data rows; only cells of over 10 characters count."""
    cells = grid.where(F.col("row_idx").between(1, rows)).select(*TABLE, F.posexplode("cells").alias("col_idx", "c"))
    n = F.avg(F.when(F.length("c") > 10, F.length("c")))
    return cells.groupBy(*TABLE, "col_idx").agg(n.alias("mean_length")).withColumn("is_text", F.coalesce(F.col("mean_length") > 15, F.lit(False)))


def carried_header(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, page, table_idx, headers) with the first header of their document; ``repeats`` marks equal ones further on.
    Of tables at the same place those with headers come first, by the order of these."""
    order = Window.partitionBy("doc_id").orderBy("page", "table_idx", F.asc_nulls_last("headers")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.first("headers", ignorenulls=True).over(order)
    seen = F.count("headers").over(order)
    rows = tables.withColumns({"header": known, "_seen": seen})
    return rows.withColumn("repeats", F.coalesce((F.col("_seen") > 1) & (lowered("headers") == lowered("header")), F.lit(False))).drop("_seen")


def weighted_quality(grid: DataFrame) -> DataFrame:
    """2 a row (50 at most), 30 for even rows, 5 a role in the first row, 1 a cell with a digit (30 at most), 10 for three or more even columns."""
    n = F.size("cells")
    head = F.lower(F.array_join("cells", " ", ""))
    roles = reduce(lambda a, b: a + b, [head.rlike(any_of(v)).cast("int") for v in rules.ROLES.values()])
    digits = F.size(F.filter("cells", lambda c: c.rlike("[0-9]")))
    g = grid.groupBy(*TABLE).agg(F.count("*").alias("r"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.max(F.when(F.col("row_idx") == 0, roles)).alias("k"), F.sum(digits).alias("d"))
    even = F.when(F.col("hi") > 0, 30.0 * (1 - (F.col("hi") - F.col("lo")) / F.col("hi"))).otherwise(0.0)
    bonus = F.when((F.col("r") >= 2) & (F.col("lo") >= 3) & (F.col("hi") == F.col("lo")), 10).otherwise(0)
    return g.select(*TABLE, (F.least(2 * F.col("r"), F.lit(50)) + even + 5 * F.coalesce("k", F.lit(0)) + F.least("d", F.lit(30)) + bonus).alias("score"))


def in_region(tables: DataFrame, regions: DataFrame, common: int = 3) -> DataFrame:
    """Grid tables whose first two rows share ``common`` different words with those of a region of their document, or whose document has none."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.array_join("cells", " ", "")), r"\s+"), lambda w: w != ""))
    of = lambda g: g.where("row_idx < 2").groupBy(*TABLE).agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("w"))
    r = of(regions).groupBy("doc_id").agg(F.collect_list("w").alias("_regions"))
    near = F.exists("_regions", lambda x: F.size(F.array_intersect("w", x)) >= common)
    return of(tables).join(r, "doc_id", "left").where(F.col("_regions").isNull() | near).select(*TABLE)


def _start(group: WindowSpec | None = None) -> Column:
    """Of a sheet's rows the first with three filled cells and two header words, else the first row: an aggregate, over ``group`` if given."""
    full = F.filter("cells", lambda c: F.trim(c) != "")
    good = (F.size(full) >= 3) & (hits(F.lower(F.array_join(full, " ")), rules.SHEET_WORDS) >= 2)
    first = F.min(F.when(good, F.col("row_idx")))
    return F.coalesce(first if group is None else first.over(group), F.lit(0))


def sheet_start(grid: DataFrame) -> DataFrame:
    """(doc_id, table_idx, start): the first row with three filled cells and two header words, else the first row."""
    return grid.groupBy(*TABLE).agg(_start().alias("start"))


def sheet_rows(grid: DataFrame) -> DataFrame:
    """The rows from a sheet's start on; rows without text go, the row number stays. Sheets without an id go."""
    rows = grid.where(" and ".join(f"{c} is not null" for c in TABLE)).withColumn("start", _start(Window.partitionBy(*TABLE))).where("row_idx >= start")
    return rows.where(F.exists("cells", lambda c: F.trim(c) != "")).drop("start")


def live_columns(grid: DataFrame) -> DataFrame:
    """``sheet_rows`` without the columns that are empty below the head; columns of images stay, as their cells hold no text.

    There are as many heads and lists of live columns as sheets, so they are merged with the rows by key and never broadcast. Sheets without an id go."""
    sheet = Window.partitionBy(*TABLE)
    rows = grid.where(" and ".join(f"{c} is not null" for c in TABLE)).withColumn("start", _start(sheet))
    rows = rows.where("row_idx >= start").where(F.exists("cells", lambda c: F.trim(c) != ""))
    below = rows.where("row_idx > start").select(*TABLE, F.posexplode("cells").alias("at", "c")).where("trim(c) <> ''")
    live = below.groupBy(*TABLE).agg(F.collect_set("at").alias("_live"))
    head = F.max(F.when(F.col("row_idx") == F.col("start"), F.col("cells"))).over(sheet)
    out = rows.withColumn("_head", head).join(live.hint("merge"), TABLE, "left")
    stays = lambda i: F.coalesce(F.array_contains("_live", i), F.lit(False)) | F.coalesce(F.lower(F.get("_head", i)).rlike(any_of(rules.IMAGE_COLUMNS)), F.lit(False))
    return out.withColumn("cells", F.filter("cells", lambda c, i: stays(i))).drop("start", "_head", "_live")


def rendered(grid: DataFrame) -> DataFrame:
    """(doc_id, table_idx, markdown); pipes in cells are escaped, row 0 gets the line below it. A table is one text, as its reader needs it."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(strip_tags(c), F.lit("|"), F.lit("\\|"))), " | ", ""), F.lit(" |"))
    below = F.concat(F.lit("\n|"), F.array_join(F.transform("cells", lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    text = F.when(F.col("row_idx") == 0, F.concat(line, below)).otherwise(line)
    rows = F.sort_array(F.collect_list(F.struct("row_idx", text.alias("t"))))
    return grid.groupBy(*TABLE).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("markdown"))


def product_class(text: Column) -> Column:
    """Seating, Desking, Storage, Lighting, else General."""
    low, rest = F.lower(text), rules.CLASSES
    return reduce(lambda c, r: c.when(low.rlike(any_of(r[1])), r[0]), rest[1:], F.when(low.rlike(any_of(rest[0][1])), rest[0][0])).otherwise("General")


TEXT_HEADERS = ["details|description|specification", "name", "additional", "item"]
STOP_HEADERS = "qty|quantity|price|rate|total|amount|uom"
NUMBER_OR_CODE = r"^[0-9.,\s]+$|^[A-Z]+[0-9]+[A-Z]*$"


def split_repaired(rows: DataFrame, reach: int = 14) -> DataFrame:
    """Rows (headers, cells) whose text was split over columns: what stands right of a text column joins it, up to ``reach`` columns on and up to
    a column of numbers or codes, a number or code, or a text column of a higher class. The leftmost column of each class (details, name, additional,
    item) is served, in this order; single characters stay where they are."""
    low = lowered("headers")
    kind = F.transform(low, lambda h: reduce(lambda c, k: c.when(h.rlike(TEXT_HEADERS[k]), k + 1), range(1, 4), F.when(h.rlike(TEXT_HEADERS[0]), 1)))
    stops = F.transform(low, lambda h: h.rlike(STOP_HEADERS) | (F.contains(h, F.lit("code")) & (h != "item code")))
    rows = rows.withColumns({"_kind": kind, "_stops": stops})
    cell = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
    for k in range(1, 5):
        rows = rows.withColumn("_t", F.array_position(F.transform("_kind", lambda x: F.coalesce(x, F.lit(0))), F.lit(k)).cast("int") - 1)
        last = F.least(F.col("_t") + reach, F.size("cells") - 1)
        right = F.when((F.col("_t") >= 0) & (last > F.col("_t")), F.sequence(F.col("_t") + 1, last)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(right, lambda i: F.coalesce(F.get("_stops", i), F.lit(False)) | F.coalesce(F.get("_kind", i) < k, F.lit(False)) | cell(i).rlike(NUMBER_OR_CODE))
        rows = rows.withColumn("_end", F.coalesce(F.array_min(ends), F.size("cells")))
        rows = rows.withColumn("_taken", F.filter(right, lambda i: (i < F.col("_end")) & (F.length(cell(i)) > 1)))
        text = F.array_join(F.filter(F.concat(F.array(cell(F.col("_t"))), F.transform("_taken", cell)), lambda c: c != ""), " ")
        moved = F.transform("cells", lambda c, i: F.when(i == F.col("_t"), text).when(F.array_contains("_taken", i), "").otherwise(c))
        rows = rows.withColumn("cells", F.when(F.size("_taken") > 0, moved).otherwise(F.col("cells")))
    return rows.drop("_kind", "_stops", "_t", "_end", "_taken")
