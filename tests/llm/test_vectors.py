import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import blocksearch, rangejoin


def data(n=260):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=16) * (0.05 + 0.3 * (i % 3 == 0))], int(i % 2)) for i in range(n)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] + [0.0] * 14, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0] * 16, None), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, rows[0][1], 0), (1008, rows[0][1], 0), (1050, [float("inf")] * 16, 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).repartition(3)


def brute_links(rows, least=0.98):
    use = [(i, np.array(x, float), lab) for i, x, lab in rows if x and lab is not None and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links = {i: set() for i, _, _ in rows}
    for i, x, a in use:
        for j, y, b in use:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in comp:
                    comp[k] = i
                    stack += links[k]
    return sorted((i, len(links[i]), comp[i]) for i in links)


def test_range_join(spark):
    rows = data()
    want = brute_links(rows)
    for sizes in ({}, {"cell": 12}, {"cell": 12, "block": 9}, {"cell": 8, "most_pivots": 8}, {"cell": 10**9, "block": 20}):
        assert sorted(tuple(r) for r in rangejoin.near_duplicates(frame(spark, rows), **sizes).collect()) == want, sizes
    assert rangejoin.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_range_join_query(spark, tmp_path):
    """The query itself, over a table with vectors that repeat and nearly repeat, against all pairs."""
    rows = [(i, x, a) for i, x, a in data(150) if i != 1006]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = rangejoin.op6_pivot_range_join(spark, str(tmp_path)).collect()
    want = brute_links(rows)
    assert sum(n > 0 for _, n, _ in want) > 50
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == want and all(r.kept == (r.vec_id == r.component_id) for r in out)


def brute_top(rows, every, k):
    use = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x, _ in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in use:
        if q % every == 0:
            s = sorted((-int(x @ y), i) for i, y in use if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rows = data()
    monkeypatch.setattr(blocksearch, "BLOCK", 16)
    monkeypatch.setattr(blocksearch, "RANGE", 64)
    monkeypatch.setattr(blocksearch, "QUERIES", 4)
    assert sorted(tuple(r) for r in blocksearch.top_k(frame(spark, rows), 10, 5).collect()) == brute_top(rows, 10, 5)
    assert blocksearch.top_k(frame(spark, rows).where("false")).count() == 0
