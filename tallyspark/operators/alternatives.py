"""Tiered alternatives for line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import category, lead_time, round2

TOP = 5


def categorised(rows: DataFrame) -> DataFrame:
    """Rows with the category and subcategory of their description."""
    return rows.withColumn("_c", category(F.col("description"))).select("*", "_c.category", "_c.subcategory").drop("_c")


def line_items(rows: DataFrame, known: bool = False) -> DataFrame:
    """X4 (typed part), P17, X5: rows with a description of five characters and a quantity or a rate, with their category, unless it is ``known``."""
    items = rows.where((F.length("description") >= 5) & ((F.col("qty") > 0) | (F.col("unit_rate") > 0)))
    return items if known else categorised(items)


#: Rows of a table that is broadcast.
SMALL = 100_000


def _small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Marked for a broadcast if it has ``most`` rows at most, as a count finds; else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _best(catalogue: DataFrame, tiers: list[str], top: int) -> DataFrame:
    """The first ``top`` entries of each category, subcategory and tier."""
    keys = ["category", "subcategory", "tier"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    best = catalogue.where(F.col("tier").isin(*tiers)).withColumn("alt_rank", rank).where(F.col("alt_rank") <= top)
    return best.select(*keys, "alt_rank", "brand", "model", "country", round2((F.col("price_low") + F.col("price_high")) / 2).alias("alt_rate"))


def _priced(items: DataFrame, best: DataFrame) -> DataFrame:
    total = round2(F.col("alt_rate") * F.col("qty"))
    return items.join(best, ["category", "subcategory"]).withColumn("alt_total", total).withColumn("lead_time", lead_time(F.col("tier"), F.col("country")))


def matched(items: DataFrame, catalogue: DataFrame, tier: str, top: int = TOP) -> DataFrame:
    """Each item's first ``top`` catalogue entries of its category, subcategory and tier, in catalogue order.

    The entries are ranked within their group before the join, so an item never meets more than ``top`` of them; where they are few (SMALL) items are not shuffled.
    """
    return _priced(items, _small(_best(catalogue, [tier], top)))


def generated_brands(spark: SparkSession) -> DataFrame:
    rows = []
    for tier, (share, start, step, letter, default, brands) in rules.GENERATED.items():
        for cat, names in [*brands.items(), (None, [default])]:
            rows += [(tier, cat, i, n, letter, share, start, step) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "tier string, category string, i int, brand string, letter string, share double, start double, step double")


def _generated(items: DataFrame, tiers: list[str], have: str | None = None) -> DataFrame:
    """X8 for several tiers at once; tiers in the array ``have`` of an item are left out."""
    table = F.broadcast(generated_brands(items.sparkSession).where(F.col("tier").isin(*tiers)).withColumnRenamed("category", "_cat"))
    known = {c for tier in tiers for c in rules.GENERATED[tier][5]}
    key = F.when(F.col("category").isin(*known), F.col("category"))
    on = key.eqNullSafe(F.col("_cat"))
    rows = items.join(table, on if have is None else on & ~F.array_contains(have, F.col("tier")))
    target, factor = F.col("unit_rate") * F.col("share"), F.col("start") + F.col("i") * F.col("step")
    model = F.concat(F.initcap("category"), F.lit(" Model "), F.col("letter"), (F.col("i") + 1).cast("string"))
    out = rows.withColumns({"alt_rank": F.col("i") + 1, "model": model, "alt_rate": round2(target * factor), "alt_total": round2(target * F.col("qty") * factor)})
    return out.drop("_cat", "i", "letter", "share", "start", "step")


def generated(items: DataFrame, tier: str) -> DataFrame:
    """Up to three made-up alternatives around the tier's share of the item's rate; categories without brands get the default one."""
    return _generated(items, [tier])


def alternatives_of(items: DataFrame, catalogue: DataFrame, tiers: list[str], top: int = TOP) -> DataFrame:
    """X7, J2, X8 for several tiers: items of a tier without a catalogue entry get generated alternatives. The catalogue is ranked once, and items meet it once."""
    keys = ["category", "subcategory"]
    best = _best(catalogue, tiers, top)
    found = _priced(items, _small(best))
    tiers_of = _small(best.groupBy(*keys).agg(F.collect_set("tier").alias("_have")))
    rest = items.join(tiers_of, keys, "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>"))).where(F.size("_have") < len(tiers))
    made = _generated(rest, tiers, "_have").drop("_have")
    return found.withColumn("source", F.lit("catalogue")).unionByName(made.withColumn("source", F.lit("generated")), allowMissingColumns=True)


def alternatives(items: DataFrame, catalogue: DataFrame, tier: str) -> DataFrame:
    """X7 with its fallback (J2, X8): items without a catalogue entry get generated alternatives."""
    return alternatives_of(items, catalogue, [tier])


def three_tiers(items: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """The best alternative's rate of each tier side by side; the lowest where rows repeat a key."""
    best = alternatives_of(items, catalogue, rules.TIERS, top=1).where("alt_rank = 1")
    return best.groupBy(*keys).agg(*[F.min(F.when(F.col("tier") == t, F.col("alt_rate"))).alias(t) for t in rules.TIERS])


def sheet(items: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Each item (rank 0, no brand), and its alternatives, to be sorted by ``keys`` and rank."""
    own = items.select(*keys, F.lit(0).alias("alt_rank"), F.lit(None).cast("string").alias("brand"), F.col("unit_rate").alias("rate"), round2(F.col("unit_rate") * F.col("qty")).alias("total"))
    return own.unionByName(found.select(*keys, "alt_rank", "brand", F.col("alt_rate").alias("rate"), F.col("alt_total").alias("total")))
