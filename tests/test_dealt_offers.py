"""Offers and words are dealt by their rows, and what only a part decides is found once per part."""

import math

import pytest

from tallyspark.plans import catalog


def plan_of(spark, sf_dir, name):
    return catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["X4_table_items", "X2_costed_tables", "W14_table_region"])
def test_partitions_follow_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(catalog, "ROWS", 500)
    n = math.ceil(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / 500)
    plan = plan_of(spark, sf_dir, name)
    assert n > 4 and f", {n})" in plan and "hashpartitioning(l_orderkey" in plan


@pytest.mark.parametrize("name", ["X9_three_tiers", "X5_categorise"])
def test_categories_are_found_once_per_part(spark, sf_dir, name):
    lines = [line for line in plan_of(spark, sf_dir, name).split("\n") if "RLIKE" in line]
    assert lines and not any("l_orderkey" in line or "qty" in line for line in lines)


def test_rows_are_chosen_below_the_scenarios(spark, sf_dir):
    """Above them every row would be costed twice, once for the test of its number; and each third of the pages is made of its own lines only."""
    plan = plan_of(spark, sf_dir, "X2_costed_tables")
    assert not any("RLIKE" in line or "format_string" in line for line in plan.split("\n") if "NestedLoopJoin" in line)
    lines = plan.split("\n")
    scans = [k for k, line in enumerate(lines) if "FileScan" in line]
    assert len(scans) == 3 and all("% 3) =" in lines[k - 1] for k in scans)
