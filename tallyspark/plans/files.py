"""Registered queries that write tables and read them again, and those about regions and batches of uploads, with their SQL twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import catalogue, headers
from tallyspark.plans.catalog import _CATALOGUE_SQL, _catalogue, _read, query
from tallyspark.sources import io


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or a local one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
    return f"{base}/tallyspark/{uuid.uuid4().hex}"


@query("S13_price_list", f"WITH {_CATALOGUE_SQL} SELECT model AS name, brand AS description, price FROM cat WHERE position % 5 > 0")
def s13(spark, d):
    """The catalogue as a price list and back; products without a name are not in it."""
    path = _folder(spark)
    c = _catalogue(spark, d)
    io.write_price_list(c.withColumns({"model": F.when(F.col("position") % 5 > 0, F.col("model")).otherwise(" "), "description": F.col("brand")}), path)
    return io.price_list(spark, path).select(F.col("Product Name").alias("name"), F.col("Description").alias("description"), F.col("PRICE").cast("double").alias("price"))


@query(
    "S14_collection_files",
    f"WITH {_CATALOGUE_SQL} SELECT brand, tier, category || ' > ' || subcategory AS collection, position, model, price FROM cat WHERE brand <> 'Brand#1' OR position % 2 = 0",
)
def s14(spark, d):
    """Collections of all brands as files, one brand written again with half of its products: its files are replaced, the others stay."""
    path = _folder(spark)
    c = _catalogue(spark, d)
    catalogue.write_collections(c, path)
    tiers = c.where("brand = 'Brand#1'").select("tier").distinct()
    catalogue.write_collections(c.where("brand = 'Brand#1' and position % 2 = 0").join(tiers, "tier", "left_semi"), path)
    return catalogue.read_collections(spark, path)


_REGION_SQL = "SELECT p_partkey AS doc_id, 0 AS table_idx FROM part WHERE p_partkey % 3 <> 1"


@query("U11_in_region", _REGION_SQL)
def u11(spark, d):
    """Tables that share four words with their document's region, or one, and documents without a region."""
    part = _read(spark, d, "part")
    k = F.col("p_partkey") % 3
    grid = part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("row_idx"), F.array(F.lit("Item No"), F.lit("Unit Rate"), F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).alias("cells"))
    region = part.where(k < 2).select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.lit(0).alias("row_idx"), F.when(k == 0, F.array(F.lit("item NO unit"), F.lit("rate"))).otherwise(F.array(F.lit("Item list"))).alias("cells"))
    return headers.in_region(grid, region)


@query(
    "J14_enriched_batch",
    """WITH b AS (SELECT 'costed' AS origin, p_partkey AS k, p_partkey % 50 AS u, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS model FROM part UNION ALL SELECT 'extracted', p_partkey, p_partkey % 70, '' FROM part),
x AS (SELECT s_suppkey % 60 AS u, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1)
SELECT origin, k, coalesce(nullif(model, ''), name, model) AS model FROM b LEFT JOIN x ON b.u = x.u""",
)
def j14(spark, d):
    """Two uploads, one with half of its names and one with none, enriched by the first supplier of each of sixty pages."""
    part = _read(spark, d, "part")
    url = lambda n: F.concat(F.lit("u/"), (F.col("p_partkey") % n).cast("string")).alias("source_url")
    rows = lambda n, model: part.select(F.col("p_partkey").alias("position"), url(n), model.cast("string").alias("model"))
    details = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("u/"), (F.col("s_suppkey") % 60).cast("string")).alias("source_url"), F.col("s_name").alias("model"))
    out = catalogue.enriched_batch({"costed": rows(50, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))), "extracted": rows(70, F.lit(""))}, details, ["model"])
    return out.select("origin", F.col("position").alias("k"), "model")
