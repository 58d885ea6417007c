"""Tables are dealt into as many partitions as their rows ask for, so a task holds no more of a larger table."""

import math

import pytest

from tallyspark.plans import catalog

QUERIES = ["J5_overlapped", "W7_gap_columns", "W8_nearest_column", "S2_markdown", "A10_quality", "U5_distinct_tables", "A14_counts", "T6_best_table", "A1_cell_subtotal"]


@pytest.mark.parametrize("name", QUERIES)
def test_partitions_follow_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(catalog, "ROWS", 500)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    n = math.ceil(rows / 500)
    assert n > 4 and f", {n})" in plan and "hashpartitioning(l_orderkey" in plan


PAGES = ["X20_container_products", "X24_classed_features", "X21_menu_tree", "X28_collection_counts", "X26_links_or_containers"]


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_spread(spark, sf_dir, monkeypatch, name):
    """The file of ``part`` is small, the pages made from it take long: not one task makes them all."""
    monkeypatch.setattr(catalog, "PAGES", 20)
    n = math.ceil(spark.read.parquet(f"{sf_dir}/part.parquet").count() / 20)
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and "hashpartitioning(p_partkey" in plan and f", {n})" in plan
