"""Costing of line items and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import cents, is_price_header, is_summary, number, round2

FACTORS = ["net_margin", "freight", "customs", "installation", "exchange_rate", "additional"]


def scenarios(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(scenario_id, six factors); a missing factor is 0, a missing exchange rate 1."""
    df = spark.createDataFrame(rows, "scenario_id string, " + ", ".join(f"{f} double" for f in FACTORS))
    return df.select("scenario_id", *[F.coalesce(F.col(f), F.lit(1.0 if f == "exchange_rate" else 0.0)).alias(f) for f in FACTORS])


SHARES = ("freight", "customs", "installation", "net_margin", "additional")


def share(f: str):
    """A factor in percent as what a price is multiplied by."""
    return 1 + F.col(f) / 100.0


def under_factors(p, by=share):
    """A price under the factors of its row; ``by`` gives what each stands for."""
    value = p * F.col("exchange_rate")
    for f in SHARES:
        value = value * by(f)
    return value


def costed(p):
    """A price under the factors of its row, two decimals."""
    return round2(under_factors(p))


#: Scenarios that are broadcast.
SCENARIOS = 1000


def under_scenarios(rows: DataFrame, factors: DataFrame, most: int = SCENARIOS) -> DataFrame:
    """Each row under each scenario. Scenarios are broadcast if a count finds ``most`` at most; more of them are left to the planner."""
    return rows.crossJoin(F.broadcast(factors) if factors.limit(most + 1).count() <= most else factors)


def cost_items(items: DataFrame, factors: DataFrame) -> DataFrame:
    """Items (qty, unit_rate, ...) under each scenario: costed unit rate and the total recomputed from it."""
    out = under_scenarios(items, factors).withColumn("rate", costed(F.col("unit_rate")))
    return out.withColumn("total", round2(F.col("qty") * F.col("rate"))).drop(*FACTORS)


def cost_cells(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """X1 over the long form (doc_id, table_id, row_no, header, text): price columns are costed, other cells and unparsable ones unchanged."""
    value = costed(number(F.col("text")))
    out = under_scenarios(cells, factors)
    return out.withColumn("text", F.when(is_price_header(F.col("header")) & value.isNotNull(), F.format_string("%.2f", value)).otherwise(F.col("text"))).drop(*FACTORS)


def subtotal(items: DataFrame, keys: list[str], vat_rate: float = 0.05) -> DataFrame:
    """A1, A4: sums in whole cents, tax and grand total."""
    sums = items.groupBy(*keys).agg(F.sum(cents(F.col("total"))).alias("c"))
    out = sums.select(*keys, (F.col("c") / 100.0).alias("subtotal"), (F.floor(F.col("c") * F.lit(vat_rate) + 0.5) / 100.0).alias("vat"))
    return out.withColumn("grand_total", round2(F.col("subtotal") + F.col("vat")))


def cell_subtotal(cells: DataFrame, mode: str = "pdf") -> DataFrame:
    """A1-A3 per (doc_id, table_id): columns named total or amount (``excel``: total only), summary rows left out; ``browser`` adds positive values only."""
    named = F.lower("header").rlike("total" if mode == "excel" else "total|amount") & ~F.contains(F.lower("header"), F.lit("_original"))
    value = number(F.col("text"))
    has_summary = F.max(is_summary(F.col("text")).cast("int"))
    rows = cells.groupBy("doc_id", "table_id", "row_no").agg(has_summary.alias("s"), F.sum(F.when(named & ((value > 0) if mode == "browser" else F.lit(True)), cents(value))).alias("c"))
    return rows.where("s = 0").groupBy("doc_id", "table_id").agg((F.coalesce(F.sum("c"), F.lit(0)) / 100.0).alias("subtotal"))
