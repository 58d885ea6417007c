"""All registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import rules, text
from tallyspark.operators import alternatives, catalogue, costing, items, layout, pages, tables
from tallyspark.sources import io
from tallyspark.streaming import jobs

FACTOR_ROWS = [("budget", 10.0, 5.0, 2.5, 0.0, 1.0, 0.0), ("standard", 20.0, 10.0, 5.0, 3.0, 3.64, 1.0), ("premium", 35.0, 12.5, 5.0, 7.5, 3.64, 2.0)]
_FACTORS_SQL = "factors(scenario_id, net_margin, freight, customs, installation, exchange_rate, additional) AS (VALUES " + ", ".join(f"('{r[0]}', " + ", ".join(f"{x:e}" for x in r[1:]) + ")" for r in FACTOR_ROWS) + ")"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows of a table that a task of a shuffle takes, and rows of ``part`` that a task makes pages of: the file is small, so that few tasks would read it, but its pages take long.
ROWS, PAGES = 100_000, 10_000


def _tasks(spark: SparkSession, d: str, name: str, rows: int | None = None) -> int:
    """As many partitions as the rows of a table ask for, one a core at least; Parquet's footers count them."""
    return max(spark.sparkContext.defaultParallelism, -(-_read(spark, d, name).count() // (rows or ROWS)))


def _dealt(spark: SparkSession, d: str, name: str, *keys: str, rows: int | None = None) -> DataFrame:
    """A table by key, in as many partitions as its rows ask for, which Parquet's footers count: what a task holds does not grow with the table."""
    return _read(spark, d, name).repartition(_tasks(spark, d, name, rows), *keys)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as bill-of-quantities rows."""
    li = _read(spark, d, "lineitem")
    rate = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5) / 100.0
    return li.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("item_no"), F.col("l_quantity").alias("qty"), rate.alias("unit_rate"))


# The words of the part names are turned into furniture names, so that the category rules have something to find.
NOUNS = ["executive chair", "task chair", "visitor chair", "sofa", "executive desk", "workstation", "meeting table", "cabinet", "bar stool", "desk lamp", "planter"]
_NOUN_SQL = "[" + ", ".join(f"'{n}'" for n in NOUNS) + "][(p_partkey % 11 + 1)::INTEGER]"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    noun = F.element_at(F.array(*map(F.lit, NOUNS)), (F.col("p_partkey") % len(NOUNS) + 1).cast("int"))
    return _read(spark, d, "part").withColumn("description", F.concat("p_name", F.lit(" "), noun))


def _items(spark: SparkSession, d: str) -> DataFrame:
    # a description's category is found once per part, not once per row that has it
    parts = alternatives.categorised(_parts(spark, d).select(F.col("p_partkey").alias("l_partkey"), "description"))
    return alternatives.line_items(_rows(spark, d).join(parts, "l_partkey"), known=True)


_R2 = "sign({0}) * floor(abs({0}) * 1e2 + 0.5e0) / 1e2"
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{text.any_of(w)}') THEN '{{}}'".format(f"{c}/{s}") for c, s, w in rules.category_rules()) + " ELSE 'general/general' END"
_ITEMS_SQL = f"""parts AS (SELECT p_partkey, p_name || ' ' || {_NOUN_SQL} AS description FROM part),
raw AS (SELECT l_orderkey, l_linenumber AS item_no, l_quantity AS qty, floor(l_extendedprice / l_quantity * 1e2 + 0.5e0) / 1e2 AS unit_rate, description, {_CATEGORY_SQL} AS cs FROM lineitem JOIN parts ON l_partkey = p_partkey),
items AS (SELECT * EXCLUDE cs, split_part(cs, '/', 1) AS category, split_part(cs, '/', 2) AS subcategory FROM raw WHERE length(description) >= 5 AND (qty > 0 OR unit_rate > 0))"""
_COUNTRIES = ["Italy", "Turkey", "China", "Germany"]


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """part as a catalogue: tier by price band, category by the rules."""
    p = _parts(spark, d).withColumn("_c", text.category(F.col("description")))
    band = F.element_at(F.array(*map(F.lit, rules.TIERS)), (F.floor("p_retailprice").cast("int") % 3 + 1))
    country = F.element_at(F.array(*map(F.lit, _COUNTRIES)), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("brand"), F.col("description").alias("model"), band.alias("tier"), "_c.category", "_c.subcategory", F.col("p_retailprice").alias("price"), F.col("p_retailprice").alias("price_low"), (F.col("p_retailprice") * 1.5).alias("price_high"), country.alias("country"), F.concat(F.lit("http://shop/p/"), (F.col("p_partkey") % 700).cast("string")).alias("source_url"))


_CATALOGUE_SQL = f"""cp AS (SELECT *, p_name || ' ' || {_NOUN_SQL} AS description FROM part),
cat AS (SELECT p_partkey AS position, p_brand AS brand, description AS model, {rules.TIERS}[(floor(p_retailprice)::INTEGER % 3) + 1] AS tier, split_part({_CATEGORY_SQL}, '/', 1) AS category, split_part({_CATEGORY_SQL}, '/', 2) AS subcategory,
  p_retailprice AS price, p_retailprice AS price_low, p_retailprice * 1.5e0 AS price_high, {_COUNTRIES}[(p_size % 4) + 1] AS country, 'http://shop/p/' || (p_partkey % 700)::VARCHAR AS source_url FROM cp)"""

_COSTED_SQL = "b AS (SELECT l_orderkey, l_linenumber AS item_no, l_quantity AS qty, floor(l_extendedprice / l_quantity * 1e2 + 0.5e0) / 1e2 AS unit_rate FROM lineitem), c AS (SELECT *, " + _R2.format("(unit_rate * exchange_rate * (1e0 + freight / 1e2) * (1e0 + customs / 1e2) * (1e0 + installation / 1e2) * (1e0 + net_margin / 1e2) * (1e0 + additional / 1e2))") + " AS rate FROM b CROSS JOIN factors), t AS (SELECT l_orderkey, scenario_id, item_no, qty, unit_rate, rate, " + _R2.format("(qty * rate)") + " AS total FROM c)"


@query("X1_costing", f"WITH {_FACTORS_SQL}, {_COSTED_SQL} SELECT l_orderkey, item_no, scenario_id, rate, total FROM t")
def x1(spark, d):
    out = costing.cost_items(_rows(spark, d), costing.scenarios(spark, FACTOR_ROWS))
    return out.select("l_orderkey", "item_no", "scenario_id", "rate", "total")


_TOTALS_SQL = "s AS (SELECT l_orderkey, scenario_id, sum(CAST(floor(total * 1e2 + 0.5e0) AS BIGINT)) AS c FROM t GROUP BY ALL), o AS (SELECT l_orderkey, scenario_id, c / 1e2 AS subtotal, floor(c * 0.05e0 + 0.5e0) / 1e2 AS vat FROM s)"


@query("X10_offer", f"WITH {_FACTORS_SQL}, {_COSTED_SQL}, {_TOTALS_SQL} SELECT *, {_R2.format('(subtotal + vat)')} AS grand_total FROM o")
def x10(spark, d):
    return costing.subtotal(costing.cost_items(_rows(spark, d), costing.scenarios(spark, FACTOR_ROWS)), ["l_orderkey", "scenario_id"])


@query("X3_zero_costing", f"WITH factors(scenario_id, net_margin, freight, customs, installation, exchange_rate, additional) AS (VALUES ('zero', 0e0, 0e0, 0e0, 0e0, 1e0, 0e0)), {_COSTED_SQL} SELECT l_orderkey, item_no, rate, total FROM t")
def x3(spark, d):
    out = costing.cost_items(_rows(spark, d), costing.scenarios(spark, [("zero", *[None] * 6)]))
    return out.select("l_orderkey", "item_no", "rate", "total")


@query("S11_offer_rows", f"WITH factors(scenario_id, net_margin, freight, customs, installation, exchange_rate, additional) AS (VALUES ('zero', 0e0, 0e0, 0e0, 0e0, 1e0, 0e0)), {_COSTED_SQL}, {_TOTALS_SQL}, g AS (SELECT *, {_R2.format('(subtotal + vat)')} AS grand_total FROM o) SELECT l_orderkey, 'item' AS section, item_no AS seq, total FROM t UNION ALL SELECT l_orderkey, 'subtotal', 0, subtotal FROM g UNION ALL SELECT l_orderkey, 'vat', 1, vat FROM g UNION ALL SELECT l_orderkey, 'grand_total', 2, grand_total FROM g")
def s11(spark, d):
    rows = costing.cost_items(_rows(spark, d), costing.scenarios(spark, [("zero", *[None] * 6)]))
    return io.offer_rows(rows, costing.subtotal(rows, ["l_orderkey"]), ["l_orderkey"])


@query("X5_categorise", f"WITH {_ITEMS_SQL} SELECT category, subcategory, count(*) AS items, CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS qty FROM items GROUP BY ALL")
def x5(spark, d):
    return _items(spark, d).groupBy("category", "subcategory").agg(F.count("*").alias("items"), F.sum(F.col("qty").cast("long")).alias("qty"))


_LEAD_SQL = "CASE WHEN country = 'Turkey' THEN '5-7 weeks' ELSE '4-6 weeks' END"
_MATCH_SQL = f"""best AS (SELECT category, subcategory, brand, model, country, {_R2.format('((price_low + price_high) / 2e0)')} AS alt_rate, CAST(row_number() OVER (PARTITION BY category, subcategory ORDER BY position) AS INTEGER) AS alt_rank FROM cat WHERE tier = 'mid_range'),
m AS (SELECT l_orderkey, item_no, alt_rank, brand, alt_rate, {_R2.format('(alt_rate * qty)')} AS alt_total, {_LEAD_SQL} AS lead_time FROM items JOIN best USING (category, subcategory) WHERE alt_rank <= 5)"""


@query("X7_alternatives", f"WITH {_ITEMS_SQL}, {_CATALOGUE_SQL}, {_MATCH_SQL} SELECT * FROM m")
def x7(spark, d):
    out = alternatives.matched(_items(spark, d), _catalogue(spark, d), "mid_range")
    return out.select("l_orderkey", "item_no", "alt_rank", "brand", "alt_rate", "alt_total", "lead_time")


_GEN_SQL = "gen(tier, gcat, i, brand, letter, share, start, step) AS (VALUES " + ", ".join(f"('{t}', {repr(c) if c else 'NULL'}, {i}, '{b}', '{g[3]}', {g[0]:e}, {g[1]:e}, {g[2]:e})" for t, g in rules.GENERATED.items() for c, names in [*g[5].items(), (None, [g[4]])] for i, b in enumerate(names)) + ")"


@query("X8_generated", f"WITH {_ITEMS_SQL}, {_GEN_SQL} SELECT l_orderkey, item_no, i + 1 AS alt_rank, brand, upper(category[1]) || category[2:] || ' Model ' || letter || (i + 1)::VARCHAR AS model, {_R2.format('(unit_rate * share * (start + i * step))')} AS alt_rate, {_R2.format('(unit_rate * share * qty * (start + i * step))')} AS alt_total FROM items JOIN gen ON tier = 'budgetary' AND gcat IS NOT DISTINCT FROM CASE WHEN category IN ('seating', 'tables', 'storage', 'lighting') THEN category END")
def x8(spark, d):
    return alternatives.generated(_items(spark, d), "budgetary").select("l_orderkey", "item_no", "alt_rank", "brand", "model", "alt_rate", "alt_total")


_TIERS_SQL = f"""one AS (SELECT tier, category, subcategory, {_R2.format('((price_low + price_high) / 2e0)')} AS alt_rate FROM cat QUALIFY row_number() OVER (PARTITION BY tier, category, subcategory ORDER BY position) = 1),
a AS (SELECT l_orderkey, item_no, tier, alt_rate FROM items JOIN one USING (category, subcategory) UNION ALL SELECT l_orderkey, item_no, gen.tier, {_R2.format('(unit_rate * share * (start + i * step))')} FROM items JOIN gen ON i = 0 AND gcat IS NOT DISTINCT FROM CASE WHEN category IN ('seating', 'tables', 'storage', 'lighting') THEN category END ANTI JOIN one ON one.tier = gen.tier AND one.category = items.category AND one.subcategory = items.subcategory)"""


@query("S12_sheet", f"WITH {_ITEMS_SQL}, {_CATALOGUE_SQL}, {_MATCH_SQL} SELECT l_orderkey, item_no, 0 AS alt_rank, NULL::VARCHAR AS brand, unit_rate AS rate, {_R2.format('(unit_rate * qty)')} AS total FROM items UNION ALL SELECT l_orderkey, item_no, alt_rank, brand, alt_rate, alt_total FROM m")
def s12(spark, d):
    rows = _items(spark, d)
    return alternatives.sheet(rows, alternatives.matched(rows, _catalogue(spark, d), "mid_range"), ["l_orderkey", "item_no"])


@query("X9_three_tiers", f"WITH {_ITEMS_SQL}, {_CATALOGUE_SQL}, {_GEN_SQL}, {_TIERS_SQL} SELECT l_orderkey, item_no, " + ", ".join(f"min(alt_rate) FILTER (tier = '{t}') AS {t}" for t in rules.TIERS) + " FROM a GROUP BY l_orderkey, item_no")
def x9(spark, d):
    return alternatives.three_tiers(_items(spark, d), _catalogue(spark, d), ["l_orderkey", "item_no"])


@query("J2_unmatched", f"WITH {_ITEMS_SQL}, {_CATALOGUE_SQL} SELECT l_orderkey, item_no FROM items WHERE NOT EXISTS (SELECT 1 FROM cat WHERE tier = 'high_end' AND cat.category = items.category AND cat.subcategory = items.subcategory AND cat.category <> 'general')")
def j2(spark, d):
    have = _catalogue(spark, d).where("tier = 'high_end' and category <> 'general'").select("category", "subcategory").distinct()
    return _items(spark, d).join(have, ["category", "subcategory"], "left_anti").select("l_orderkey", "item_no")


@query("A5_catalogue_counts", f"WITH {_CATALOGUE_SQL} SELECT category, subcategory, count(*) AS products, CAST(grouping(category) * 2 + grouping(subcategory) AS INTEGER) AS level FROM cat GROUP BY ROLLUP (category, subcategory)")
def a5(spark, d):
    return catalogue.counts(_catalogue(spark, d))


@query("A7_categories", f"WITH {_CATALOGUE_SQL} SELECT DISTINCT tier, category FROM cat")
def a7(spark, d):
    return _catalogue(spark, d).select("tier", "category").distinct()


@query("X16_models", f"WITH {_CATALOGUE_SQL} SELECT position, brand, model, price FROM cat WHERE tier = 'mid_range' AND lower(category) LIKE '%seat%'")
def x16(spark, d):
    return catalogue.models(_catalogue(spark, d), "Mid-Range", category="seat").select("position", "brand", "model", "price")


@query("T2_top_products", f"WITH {_CATALOGUE_SQL}, r AS (SELECT brand, category, subcategory, position, CAST(row_number() OVER (PARTITION BY brand, category, subcategory ORDER BY position) AS INTEGER) AS rank FROM cat) SELECT * FROM r WHERE rank <= 3")
def t2(spark, d):
    return catalogue.top_products(_catalogue(spark, d), 3).select("brand", "category", "subcategory", "position", "rank")


@query("U3_one_per_url", f"WITH {_CATALOGUE_SQL}, x AS (SELECT position, source_url, category, CASE WHEN position % 3 = 0 THEN NULL ELSE subcategory END AS subcategory FROM cat) SELECT position, source_url, category, subcategory FROM x QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY subcategory IS NULL, position) = 1")
def u3(spark, d):
    c = _catalogue(spark, d).withColumn("subcategory", F.when(F.col("position") % 3 != 0, F.col("subcategory")))
    return catalogue.one_per_url(c).select("position", "source_url", "category", "subcategory")


@query("J4_reprice", f"WITH {_CATALOGUE_SQL}, pl AS (SELECT ' ' || upper(model) AS name, price * 1.1e0 AS price, position AS row_no FROM cat WHERE position % 5 < 2), l AS (SELECT lower(trim(name)) AS k, max_by(price, row_no) AS np FROM pl GROUP BY 1) SELECT position, coalesce(np, price) AS price, np IS NOT NULL AS repriced FROM cat LEFT JOIN l ON lower(trim(model)) = k")
def j4(spark, d):
    c = _catalogue(spark, d)
    prices = c.where("position % 5 < 2").select(F.concat(F.lit(" "), F.upper("model")).alias("name"), (F.col("price") * 1.1).alias("price"), F.col("position").alias("row_no"))
    return catalogue.reprice(c, prices).select("position", "price", "repriced")


@query("J8_general", f"WITH {_CATALOGUE_SQL}, x AS (SELECT position, category, source_url AS model, CASE WHEN position % 4 = 0 THEN 'General' ELSE subcategory END AS subcategory FROM cat) SELECT position, category, model, subcategory FROM x QUALIFY subcategory <> 'General' OR max(CASE WHEN subcategory <> 'General' THEN 1 ELSE 0 END) OVER (PARTITION BY category, model) = 0")
def j8(spark, d):
    c = _catalogue(spark, d).withColumns({"model": F.col("source_url"), "subcategory": F.when(F.col("position") % 4 == 0, "General").otherwise(F.col("subcategory"))})
    return catalogue.without_general(c).select("position", "category", "model", "subcategory")


@query("J10_parents", f"WITH {_CATALOGUE_SQL}, x AS (SELECT brand AS category, source_url, CASE WHEN position % 3 <> 0 THEN subcategory END AS subcategory FROM cat), u AS (SELECT category, source_url, bool_or(subcategory IS NULL) AS own, bool_or(subcategory IS NOT NULL) AS child FROM x GROUP BY ALL) SELECT category, count(*) AS urls, count(*) FILTER (child) AS shared, count(*) FILTER (child) / count(*) > 0.8 AS duplicate FROM u WHERE own GROUP BY category")
def j10(spark, d):
    c = _catalogue(spark, d).withColumns({"category": F.col("brand"), "subcategory": F.when(F.col("position") % 3 != 0, F.col("subcategory"))})
    return catalogue.duplicate_parents(c)


@query("U1_upsert", "WITH a AS (SELECT s_name AS name, 'mid_range' AS tier, 'w' || s_suppkey::VARCHAR AS website, 'd0' AS added_date, 'd0' AS updated_date FROM supplier WHERE s_suppkey % 3 < 2), b AS (SELECT upper(s_name) AS name, 'mid_range' AS tier, 'n' || s_suppkey::VARCHAR AS website, 'd1' AS added_date, 'd1' AS updated_date FROM supplier WHERE s_suppkey % 3 > 0) SELECT coalesce(a.name, b.name) AS name, coalesce(a.tier, b.tier) AS tier, coalesce(b.website, a.website) AS website, NULL::VARCHAR AS country, coalesce(b.updated_date, a.updated_date) AS updated_date, coalesce(a.added_date, b.added_date) AS added_date FROM a FULL JOIN b ON lower(a.name) = lower(b.name) AND a.tier = b.tier")
def u1(spark, d):
    s = _read(spark, d, "supplier")
    made = lambda df, name, p, day: df.select(name.alias("name"), F.lit("mid_range").alias("tier"), F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias("website"), F.lit(None).cast("string").alias("country"), F.lit(day).alias("added_date"), F.lit(day).alias("updated_date"))
    return catalogue.upsert_brands(made(s.where("s_suppkey % 3 < 2"), F.col("s_name"), "w", "d0"), made(s.where("s_suppkey % 3 > 0"), F.upper("s_name"), "n", "d1"))


def _markdown(spark, d):
    """One text per order: a header, a separator, a row per line item (every seventh with a blank cell), a closing line."""
    li = _dealt(spark, d, "lineitem", "l_orderkey")
    cell = F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_partkey").cast("string"))
    row = F.concat_ws("|", F.lit(""), F.col("l_linenumber").cast("string"), cell, F.floor("l_quantity").cast("string"), F.lit(""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n")
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("Offer\n|No|Item|Qty|\n|--|--|--|\n"), body, F.lit("\nend")).alias("md"))


@query("S2_markdown", "WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat('|', l_linenumber, '|', CASE WHEN l_linenumber = 7 THEN '' ELSE l_partkey::VARCHAR END, '|', floor(l_quantity)::BIGINT, '|')) AS INTEGER) AS row_idx, [l_linenumber::VARCHAR, l_partkey::VARCHAR, floor(l_quantity)::BIGINT::VARCHAR] AS c FROM lineitem) SELECT doc_id, row_idx, array_to_string(c, '|') AS cells FROM r WHERE n <> 7 UNION ALL SELECT DISTINCT doc_id, 0, 'No|Item|Qty' FROM r")
def s2(spark, d):
    return tables.markdown_grid(_markdown(spark, d)).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("A1_cell_subtotal", "SELECT l_orderkey AS doc_id, sum(CAST(floor(floor(l_quantity) * 1e2 + 0.5e0) AS BIGINT)) / 1e2 AS subtotal FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def a1(spark, d):
    cells = tables.cells_of(tables.markdown_grid(_markdown(spark, d))).withColumn("header", F.when(F.col("header") == "Qty", "Total").otherwise(F.col("header")))
    return costing.cell_subtotal(cells.withColumnRenamed("table_idx", "table_id")).select("doc_id", "subtotal")


@query("W3_sort_serial", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 97 + 1 END NULLS LAST, l_linenumber) AS INTEGER) AS sorted_no FROM lineitem")
def w3(spark, d):
    li = _read(spark, d, "lineitem")
    sn = tables.serial(F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("No. "), (F.col("l_partkey") % 97 + 1).cast("string"))))
    return tables.sort_by_serial(li, ["l_orderkey"], sn, "l_linenumber").select("l_orderkey", "l_linenumber", "sorted_no")


@query("W4_numbered_slots", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 97 + 1 END AS sn FROM lineitem), a AS (SELECT l_orderkey, l_linenumber AS sorted_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM x WHERE sn IS NOT NULL), b AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY sn, l_linenumber) AS r FROM x WHERE sn IS NOT NULL) SELECT l_orderkey, l_linenumber, sorted_no FROM a JOIN b USING (l_orderkey, r) UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber FROM x WHERE sn IS NULL")
def w4(spark, d):
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 97 + 1).alias("sn"))
    return tables.sort_numbered_slots(li, ["l_orderkey"], "sn", "l_linenumber").select("l_orderkey", "l_linenumber", "sorted_no")


@query("W9_continuations", "WITH x AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS item_id FROM lineitem) SELECT l_orderkey, CAST(item_id AS BIGINT) AS item_id, string_agg('part of line ' || l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber) AS description, count(*) AS merged_rows FROM x GROUP BY ALL")
def w9(spark, d):
    li, starts = _read(spark, d, "lineitem"), F.col("l_partkey") % 3 > 0
    rows = li.select("l_orderkey", "l_linenumber", F.when(starts, F.col("l_linenumber").cast("string")).otherwise("").alias("serial"), F.concat(F.lit("part of line "), F.col("l_linenumber").cast("string")).alias("description"), F.when(starts, "1").otherwise("").alias("qty"), F.lit("").alias("price"))
    return tables.merge_continuations(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "item_id", "description", "merged_rows")


@query("W6_sections", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def w6(spark, d):
    ev = _read(spark, d, "events")
    return tables.carry_sections(ev, ["user_id"], "event_id", "event_id", F.col("event_type") == "error").select("event_id", "section")


def _strip_sql(x):
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'))"


_ANCHOR_SQL = "regexp_extract_all(h, '(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', {})"
_ROOT_SQL = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+')"


@query("X20_links", f"WITH p AS (SELECT page_id, url, html AS h FROM pages), l AS (SELECT page_id, url, unnest({_ANCHOR_SQL.format(1)}) AS href FROM p) SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN {_ROOT_SQL} || href ELSE {_ROOT_SQL} || '/' || href END AS target FROM l")
def x20(spark, d):
    return pages.links(_read(spark, d, "pages")).select("page_id", "href", "target")


def _clean_sql(x):
    for pattern, new in text.CATEGORY_STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"trim({x})"


_TARGET_SQL = f"CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN {_ROOT_SQL} || href ELSE {_ROOT_SQL} || '/' || href END"
_PLACED_SQL = f"SELECT page_id, url, unnest({_ANCHOR_SQL.format(1)}) AS href, unnest({_ANCHOR_SQL.format(2)}) AS txt, generate_subscripts({_ANCHOR_SQL.format(1)}, 1) - 1 AS pos FROM n"


@query("X26_product_links", f"WITH n AS (SELECT page_id, url, html AS h FROM pages), l AS ({_PLACED_SQL}), t AS (SELECT page_id, pos, {_TARGET_SQL} AS target FROM l) SELECT page_id, target, CAST(min(pos) AS INTEGER) AS pos FROM t WHERE regexp_matches(lower(target), '{pages.PRODUCT_PATH}') AND NOT regexp_matches(lower(target), '{pages.CATEGORY_PATH}') GROUP BY ALL")
def x26(spark, d):
    return pages.product_links(_read(spark, d, "pages"))


@query("X21_categories", f"WITH n AS (SELECT page_id, url, array_to_string(regexp_extract_all(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), ' ') AS h FROM pages), l AS ({_PLACED_SQL}), c AS (SELECT page_id, pos, href, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS site, {_clean_sql(_strip_sql('txt'))} AS category, {_TARGET_SQL} AS target FROM l) SELECT site, category, target, page_id FROM c WHERE length(category) BETWEEN 2 AND 50 AND NOT regexp_matches(lower(href), '^(mailto|tel|javascript):|^#') QUALIFY row_number() OVER (PARTITION BY site, category ORDER BY page_id, pos) = 1")
def x21(spark, d):
    return pages.categories(_read(spark, d, "pages"))


@query("F12_url_parts", "WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> 'product') AS parts FROM pages) SELECT page_id, coalesce(upper(parts[1][1]) || lower(parts[1][2:]), 'Products') AS category, upper(parts[2][1]) || lower(parts[2][2:]) AS subcategory FROM p")
def f12(spark, d):
    return _read(spark, d, "pages").select("page_id", text.category_from_url(F.col("url")).alias("category"), text.subcategory_from_url(F.col("url")).alias("subcategory"))


@query("U8_sentences", "WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS pos FROM documents), f AS (SELECT doc_id, arg_min(s, pos) AS s, min(pos) AS pos FROM s WHERE trim(s) <> '' GROUP BY doc_id, lower(trim(s))) SELECT doc_id, left(string_agg(s, '. ' ORDER BY pos), 1500) AS about, count(*) AS sentences FROM f GROUP BY doc_id")
def u8(spark, d):
    return pages.sentences_once(_read(spark, d, "documents"), "text")


@query("T3_history", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 50")
def t3(spark, d):
    return jobs.history(_read(spark, d, "events"), "user_id").select("user_id", "event_id", "rank")


@query("R1_newest_upload", "WITH x AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, user_id, event_type FROM x WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 10000000")
def r1(spark, d):
    return jobs.newest_upload(_read(spark, d, "events"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("R2_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id")
def r2(spark, d):
    return jobs.status(_read(spark, d, "events"), "user_id")


@query("R6_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5e0) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY ALL")
def r6(spark, d):
    return jobs.hourly(_read(spark, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("J15_images_by_rank", "WITH i AS (SELECT l_orderkey AS doc_id, l_partkey AS img_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) AS r FROM lineitem WHERE l_linenumber % 2 = 0), k AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) SELECT doc_id, img_id, row_idx, CAST(r - 1 AS INTEGER) AS global_row FROM i JOIN k USING (doc_id, r)")
def j15(spark, d):
    li = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_partkey", "l_linenumber", "l_extendedprice")
    images = li.where("l_linenumber % 2 = 0").select("doc_id", "page", F.col("l_partkey").alias("img_id"), F.col("l_extendedprice").alias("y0"), F.col("l_extendedprice").alias("y1"))
    return items.images_by_rank(images, li.select("doc_id", "page", F.col("l_linenumber").alias("row_idx"))).select("doc_id", "img_id", "row_idx", "global_row")


_WORDS_SQL = "w AS (SELECT l_orderkey AS page, l_suppkey, (l_partkey % 200)::DOUBLE AS x, (l_suppkey * 37 % 230)::DOUBLE AS x2 FROM lineitem), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) < 10 THEN 0 ELSE 1 END AS s FROM w), k AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY x) AS column_no FROM g), cols AS (SELECT page, CAST(column_no AS BIGINT) AS column_no, avg(x) AS centre, count(*) AS words FROM k GROUP BY ALL)"


def _words(spark, d, x):
    return _dealt(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("page"), "l_suppkey", x.cast("double").alias("x0"))


@query("W7_gap_columns", f"WITH {_WORDS_SQL} SELECT page, column_no, centre, words FROM cols")
def w7(spark, d):
    return layout.gap_columns(_words(spark, d, F.col("l_partkey") % 200), ["page"])


@query("W8_nearest_column", f"WITH {_WORDS_SQL}, r AS (SELECT page, l_suppkey, x2, row_number() OVER () AS id FROM w) SELECT any_value(r.page) AS page, any_value(l_suppkey) AS l_suppkey, any_value(x2) AS x0, arg_min(column_no, (abs(x2 - centre), column_no)) FILTER (abs(x2 - centre) <= 50) AS column_no FROM r JOIN cols ON r.page = cols.page GROUP BY id")
def w8(spark, d):
    columns = layout.gap_columns(_words(spark, d, F.col("l_partkey") % 200), ["page"])
    return layout.nearest_column(_words(spark, d, F.col("l_suppkey") * 37 % 230), columns, ["page"])


_MD_SQL = "x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, concat('|', l_linenumber, '|', CASE WHEN l_linenumber = 7 THEN '' ELSE l_partkey::VARCHAR END, '|', floor(l_quantity)::BIGINT, '|') AS line, concat_ws('|', l_linenumber, l_partkey, floor(l_quantity)::BIGINT) AS c FROM lineitem)"


@query("A14_counts", f"WITH {_MD_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS tables, count(*) FILTER (n <> 7) + 1 AS rows FROM x GROUP BY doc_id")
def a14(spark, d):
    return layout.counts(tables.markdown_grid(_markdown(spark, d)))


@query("U5_distinct_tables", f"WITH {_MD_SQL}, t AS (SELECT doc_id, count(*) FILTER (n <> 7) + 1 AS n_rows, coalesce(arg_max(c, (n, line)) FILTER (n <> 7), 'No|Item|Qty') AS last FROM x GROUP BY doc_id) SELECT min(doc_id) AS doc_id, n_rows FROM t GROUP BY n_rows, last")
def u5(spark, d):
    return layout.distinct_tables(tables.markdown_grid(_markdown(spark, d))).select("doc_id", "n_rows")


_SCORE_SQL = f"{_MD_SQL}, t AS (SELECT doc_id, count(*) FILTER (n <> 7) AS r FROM x GROUP BY doc_id), q AS (SELECT doc_id, CAST(15 + CASE WHEN r >= 5 THEN 30 WHEN r >= 2 THEN 15 ELSE 0 END + 20 + 10 AS INTEGER) AS score FROM t)"


@query("A10_quality", f"WITH {_SCORE_SQL} SELECT doc_id, score FROM q")
def a10(spark, d):
    return tables.quality(tables.markdown_grid(_markdown(spark, d))).select("doc_id", "score")


@query("T6_best_table", f"WITH {_SCORE_SQL} SELECT doc_id % 100 AS bucket, arg_max(doc_id, (score, -doc_id)) AS table_idx, max(score) AS score FROM q GROUP BY 1")
def t6(spark, d):
    scored = tables.quality(tables.markdown_grid(_markdown(spark, d)))
    return tables.best_table(scored.select((F.col("doc_id") % 100).alias("bucket"), F.col("doc_id").alias("table_idx"), "score"), ["bucket"])


@query("U4_distinct_rows", "WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_idx, l_returnflag || '|' || l_linestatus AS cells FROM lineitem), f AS (SELECT doc_id, cells, min(row_idx) AS row_idx FROM x GROUP BY ALL) SELECT doc_id, row_idx, cells FROM f QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2")
def u4(spark, d):
    grid = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.col("l_linenumber").alias("row_idx"), F.array("l_returnflag", F.concat(F.lit(" "), "l_linestatus")).alias("cells"))
    return tables.distinct_rows(grid).select("doc_id", "row_idx", F.array_join(F.transform("cells", lambda c: F.trim(c)), "|").alias("cells"))


@query("U2_insert_absent", "WITH k AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 3 < 2 AND s_nationkey < 12) SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 < 2 AND s_nationkey < 12 UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 > 0 AND s_nationkey NOT IN (SELECT s_nationkey FROM k)")
def u2(spark, d):
    s = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return catalogue.insert_absent(s.where("s_suppkey % 3 < 2 and s_nationkey < 12"), s.where("s_suppkey % 3 > 0"), ["s_nationkey"])


@query("A16_listing", f"WITH {_CATALOGUE_SQL} SELECT DISTINCT tier, brand, country FROM cat WHERE category = 'seating'")
def a16(spark, d):
    return catalogue.listing(_catalogue(spark, d), ["tier", "brand", "country"], category="Seating")


_PIECES = {"model": "CASE WHEN position % 3 <> 0 THEN model END", "country": "CASE WHEN position % 4 <> 1 THEN country ELSE '' END"}
_PIECES_SQL = f"pc AS (SELECT position, source_url, {_PIECES['model']} AS model, {_PIECES['country']} AS country FROM cat)"
_MERGED_SQL = "mg AS (SELECT source_url, arg_min(model, position) FILTER (trim(model) <> '') AS model, arg_min(country, position) FILTER (trim(country) <> '') AS country FROM pc {} GROUP BY source_url)"


def _pieces(spark, d):
    return _catalogue(spark, d).select("position", "source_url", *[F.expr(e).alias(c) for c, e in _PIECES.items()])


@query("A13_fragments", f"WITH {_CATALOGUE_SQL}, {_PIECES_SQL}, {_MERGED_SQL.format('')} SELECT source_url, model, country FROM mg")
def a13(spark, d):
    return catalogue.merge_fragments(_pieces(spark, d), ["model", "country"])


@query("J6_enriched", f"WITH {_CATALOGUE_SQL}, {_PIECES_SQL}, {_MERGED_SQL.format('WHERE position % 2 = 0')} SELECT position, source_url, coalesce(CASE WHEN trim(pc.model) <> '' THEN pc.model END, mg.model, pc.model) AS model, coalesce(CASE WHEN trim(pc.country) <> '' THEN pc.country END, mg.country, pc.country) AS country FROM pc LEFT JOIN mg USING (source_url)")
def j6(spark, d):
    rows = _pieces(spark, d)
    return catalogue.enriched(rows, rows.where("position % 2 = 0"), ["model", "country"])


@query("J3_images", f"WITH {_CATALOGUE_SQL}, i AS (SELECT *, 'i' || position AS image_url FROM cat WHERE position % 2 = 0), a AS (SELECT brand, category, subcategory, trim(model) AS m, arg_min(image_url, position) AS u FROM i GROUP BY ALL), b AS (SELECT brand, trim(model) AS m, arg_min(image_url, position) AS u FROM i GROUP BY ALL), s AS (SELECT position, brand, category, CASE WHEN position % 3 = 0 THEN 'other' ELSE subcategory END AS subcategory, model FROM cat) SELECT position, coalesce(a.u, b.u) AS image_url FROM s LEFT JOIN a ON s.brand = a.brand AND s.category = a.category AND s.subcategory = a.subcategory AND trim(s.model) = a.m LEFT JOIN b ON s.brand = b.brand AND trim(s.model) = b.m")
def j3(spark, d):
    c = _catalogue(spark, d)
    images = c.where("position % 2 = 0").withColumn("image_url", F.concat(F.lit("i"), F.col("position").cast("string")))
    chosen = c.withColumn("subcategory", F.when(F.col("position") % 3 == 0, "other").otherwise(F.col("subcategory")))
    return catalogue.with_image(chosen, images).select("position", "image_url")


@query("J7_registry_first", "SELECT s_name AS name, 'registry' AS origin FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT upper(s_name), 'file' FROM supplier WHERE s_suppkey % 3 = 2")
def j7(spark, d):
    s = _read(spark, d, "supplier")
    files = s.where("s_suppkey % 3 > 0").select(F.upper("s_name").alias("name"), F.lit("file").alias("origin"))
    return catalogue.registry_first(s.where("s_suppkey % 3 < 2").select(F.col("s_name").alias("name"), F.lit("registry").alias("origin")), files)


@query("A17_audit", f"WITH {_CATALOGUE_SQL}, p AS (SELECT DISTINCT lower(trim(CASE WHEN position % 2 = 0 THEN model ELSE model || ' x' END)) AS k FROM cat WHERE position % 5 < 2), h AS (SELECT lower(trim(model)) AS k, count(*) AS n FROM cat GROUP BY 1) SELECT count(*) AS names, count(n) AS matched, CAST(coalesce(sum(n), 0) AS BIGINT) AS updated FROM p LEFT JOIN h USING (k)")
def a17(spark, d):
    c = _catalogue(spark, d)
    name = F.when(F.col("position") % 2 == 0, F.col("model")).otherwise(F.concat("model", F.lit(" x")))
    return catalogue.reprice_audit(c, c.where("position % 5 < 2").select(name.alias("name")))


@query("X17_page_kind", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '/product-category/|/category/|/categories/|/collection/|/collections/') THEN 'category' WHEN regexp_matches(lower(url), '/product/|/products/|/item/|/detail/|/p/') THEN 'product' ELSE 'other' END AS kind FROM pages")
def x17(spark, d):
    return _read(spark, d, "pages").select("page_id", pages.page_kind(F.col("url")).alias("kind"))


def _inner_sql(tag):
    inner = _strip_sql(f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)")
    return f"nullif({inner}, '')"


@query("X18_product", f"SELECT page_id, coalesce({_inner_sql('h1')}, {_inner_sql('title')}) AS title, left({_inner_sql('p')}, 200) AS description FROM pages")
def x18(spark, d):
    return pages.product(_read(spark, d, "pages"))


@query("F9_wrapped", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([^ \n]{61,}|[^\n]{1,60})(?: +|\n|\z)', '\1' || chr(10), 'g'), '\n\z', '')) AS wrapped FROM documents")
def f9(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.wrapped(F.col("text")).cast("binary")).alias("wrapped"))


@query("R6_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 300000000 THEN 0 ELSE 1 END AS s FROM events), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k")
def r6s(spark, d):
    return jobs.sessions(_read(spark, d, "events"), "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("R3_expired", "SELECT user_id, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 300000000 AS expired FROM events GROUP BY user_id")
def r3(spark, d):
    return jobs.expired(_read(spark, d, "events"), "user_id", "2024-01-31 00:00:00")
