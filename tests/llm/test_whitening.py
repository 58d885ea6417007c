import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(
    "rows",
    [
        np.random.default_rng(1).normal(size=(500, 24)),
        np.random.default_rng(2).normal(size=(9, 20)),
        np.random.default_rng(3).normal(size=(200, 12)) * 10.0 ** -np.arange(12),
        np.vstack([np.eye(10)] * 4),
        np.diag(np.r_[np.ones(8), np.full(8, 1 + 1e-11), 2, 0, 0]) @ np.linalg.qr(np.random.default_rng(4).normal(size=(19, 19)))[0],
        np.zeros((4, 5)),
        np.ones((4, 1)),
    ],
)
def test_directions(rows):
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    sigma, z = whitening.directions(np.vstack([r, np.zeros((d - len(r), d))]), d)
    want = np.linalg.svd(rows, compute_uv=False)
    assert len(sigma) == int((want > 16 * d * 2.3e-16 * max(want[0], 1e-300)).sum())
    assert np.allclose(sigma, want[: len(sigma)], rtol=1e-12)
    assert np.abs(z.T @ z - np.eye(len(sigma))).max(initial=0) < 1e-13
    y = rows @ z / sigma
    assert np.abs(y.T @ y - np.eye(len(sigma))).max(initial=0) < 1e-12


def test_bidiagonal_keeps_the_products():
    r = np.triu(np.random.default_rng(5).normal(size=(15, 15)))
    diagonal, upper, v = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.abs(v @ b.T @ b @ v.T - r.T @ r).max() < 1e-12


def test_small_values_are_as_exact_as_large_ones():
    diagonal, upper = 10.0 ** -np.arange(0, 30, 3.0), 10.0 ** -np.arange(0.5, 27, 3.0)
    got = whitening.qd_values(diagonal, upper)
    from fractions import Fraction

    def below(x):  # how many values of B'B are below x: negative pivots, in exact arithmetic
        n, count, pivot = len(diagonal), 0, None
        sq = [Fraction(float(c)) ** 2 for c in diagonal]
        off = [Fraction(float(c)) ** 2 for c in upper]
        for k in range(n):
            t = sq[k] + (off[k - 1] if k else 0) - x
            pivot = t - (sq[k - 1] * off[k - 1] / pivot if k else 0)
            count += pivot < 0
        return count

    for k, value in enumerate(got):
        low, high = Fraction(float(value)) * Fraction(1 - 1e-13), Fraction(float(value)) * Fraction(1 + 1e-13)
        assert below(low) == len(got) - 1 - k and below(high) == len(got) - k


def expected(rows, most=16):
    """Brute force: exact whole numbers, and the eigenvectors of the covariance by numpy."""
    keep = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in keep))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:most]
    return keep, n, total, values[order], vectors[:, order], float(values.sum())


def random_rows(d=20, n=400):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.2, d))).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(200)]  # copies count once
    return [*rows, (None, rows[9][1], None), (2000, None, 1), (2001, [None] * d, 1), (2002, [math.nan] * d, 1), (2003, [math.inf] * d, 1), (2004, [], 1), (2005, [0.0] * d, 1)]


def test_query_same_as_brute_force(spark, tmp_path):
    rows = random_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(40).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op13_bidiagonal_whitening(spark, str(tmp_path)).toPandas()
    keep, n, total, values, vectors, trace = expected([r[:2] for r in rows])
    assert len(out) == 16 * len(keep) and set(out["n"]) == {n}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-10
    sign = {}
    for i, x in keep:
        got = out[out["vec_id"].isna() if i is None else out["vec_id"] == i].sort_values("component")
        y = np.array([(n * a - s) / n for a, s in zip(x, total, strict=True)])
        assert set(got["deviation"]) == {sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))}
        assert np.allclose(got["explained"], values / trace, rtol=1e-10)
        want = y @ vectors / np.sqrt(values)
        flip = sign.setdefault("s", np.sign(got["whitened"].to_numpy() * want))
        assert np.allclose(got["whitened"].to_numpy() * flip, want, atol=1e-9)


def test_large_entries_are_exact_and_do_not_overflow(spark):
    rows = [(k, [float(2.0**40 * (k % 5)), float(k), 0.5], 0) for k in range(50)] + [(99, [1e30, 0.0, 0.0], 0)]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    keep, n, total, *_ = expected([r[:2] for r in rows[:-1]])
    assert set(out["vec_id"]) == set(range(50)) and set(out["component"]) == {1, 2}
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for i, x in keep}
    assert all(math.isnan(d) if exact[i] >= 2**63 else d == exact[i] for i, d in zip(out["vec_id"], out["deviation"], strict=True))


def test_awkward_tables(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA)
    columns = ["x", "n", "component", "a.b", "_vector", "at"]
    for c in columns:
        df = df.withColumn(c, F.lit("y"))
    assert whitening.whitened(df, most=3).count() == 3 * 602
    assert whitening.whitened(df.limit(0)).collect() == []
    one = df.where("vec_id = 5 or vec_id >= 1000 and vec_id < 1010")
    assert whitening.whitened(one).collect() == []  # one different vector: no variance
    mixed = df.unionByName(spark.createDataFrame([(7000, [1.0, 2.0], 1)], SCHEMA).selectExpr("*", *[f"'y' as `{c}`" for c in columns]))
    out = whitening.whitened(mixed, most=2)
    assert out.where("vec_id = 7000").count() == 0 and out.count() == 2 * 602


def test_triangles_are_merged_over_many_tasks(spark):
    vectors = spark.createDataFrame(random_rows(), SCHEMA).repartition(40)
    fit = whitening.whole_vectors(vectors).select("x").distinct().repartition(40)
    by_dim = whitening.sums(fit)
    n, total = by_dim[0]["n"], [int(r["s"]) for r in by_dim]
    r = whitening.triangle(fit, n, total)
    _, n_want, total_want, *_ = expected([row[:2] for row in random_rows()])
    assert (n, total) == (n_want, total_want)
    y = whitening.centred(whitening.matrix(fit.toArrow().column("x").combine_chunks()), n, total)
    assert np.abs(r.T @ r - y.T @ y).max() < 1e-9 * np.abs(y.T @ y).max()
