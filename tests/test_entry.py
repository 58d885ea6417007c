import importlib

import pytest


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Python is used to parse HTML only.
PARSES_HTML = {"tallyspark.plans.markup", "tallyspark.plans.details"}


def test_twins_agree(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from tallyspark.plans import catalog

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and ("InArrow" not in plan or catalog.queries()[name].__module__ in PARSES_HTML), name
        got = df.toArrow()
        con.register("got", got)
        con.execute(f"create or replace temp table want as {sql}")
        cols = ", ".join(f'"{c}"' for c in sorted(got.column_names))
        assert con.execute("select count(*) from want").fetchall()[0][0] == got.num_rows, name
        assert con.execute(f"select count(*) from (select {cols} from want except all select {cols} from got)").fetchall()[0][0] == 0, name
