"""The SQL twins of this subpackage on a given table, and on rows made so that there is something to find."""

from pathlib import Path

import numpy as np
import pytest
from llm_cases import SCHEMA

from tallyspark.llm import registry

duckdb = pytest.importorskip("duckdb")


def agree(spark, folder, name):
    """How many rows query and twin both give."""
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = registry.queries()[name](spark, str(folder)).toArrow()
    con.register("got", got)
    con.execute(f"create temp table want as {registry.oracle_sql()[name]}")
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    assert con.execute("select count(*) from want").fetchall()[0][0] == got.num_rows, name
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"select count(*) from (select {columns} from {a} except all select {columns} from {b})").fetchall()[0][0] == 0, name
    return got


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_given_table(spark, sf_dir, name):
    assert agree(spark, sf_dir, name).num_rows


def test_links_between_vectors(spark, tmp_path):
    """Chains and stars of close vectors in several labels, copies, and vectors that can link with nothing."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        for step in range(rng.integers(1, 7)):
            base = base + rng.normal(size=16) * (0.03 if k % 2 else 0.12)
            rows.append((len(rows), base.astype(np.float32).tolist(), int(k % 3)))
    rows += [(len(rows) + k, rows[3][1], 0) for k in range(40)] + [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, rows[3][1], None), (9003, rows[3][1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = agree(spark, tmp_path, "op6_pivot_range_join").to_pandas()
    assert got["n_links"].max() >= 39 and (got["n_links"] == 0).sum() > 10 and (~got["kept"]).sum() > 80


def test_repeats_and_notices(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"own{k} start\n{passage}\nLicensed under the Apache License,\nVersion 2.0.\nend of {k}", "en", "a") for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert (agree(spark, tmp_path, "op10_substring_doubling").to_pandas()["n_removed"] > 0).sum() == 29
    assert agree(spark, tmp_path, "op9_licence_dice").num_rows == 30
    assert agree(spark, tmp_path, "op11_first_lines").to_pandas()["n_dropped"].sum() == 29 * 3
