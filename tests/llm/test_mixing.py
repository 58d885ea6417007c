import re

import numpy as np
from llm_cases import ROWS, documents

from tallyspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] > most * sizes[s]]
        if not above:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: float(most * sizes[s]) for s in above}


def test_targets(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}é" if i % 2 else f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 7, n)))} | {None: 17}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got, want = {r.source: r.target for r in mixing.targets(df).collect()}, brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, rng.choice([5, 60, 20_000]), rng.integers(1, 60)))
        counts = rng.integers(1, 400, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        short = budget - int((take * sizes).sum())
        assert 0 <= short < max(sizes.max(), 1)
        if sizes[0] == 1:
            assert short == 0 or counts[0] < sizes.max()


def check(rows, out):
    sizes, n = {}, {}
    for d, t, s in rows:
        k = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + k
        n.setdefault(d, set()).add(k)
    want, taken, largest = brute_targets(sizes), {}, {}
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] in n[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s, x in taken.items():
        assert abs(x - want[s]) <= largest[s] + 1
    return taken, want


def test_awkward_rows(spark):
    check([(r[0], r[1], r[3]) for r in ROWS], mixing.mixed(documents(spark)).collect())
    assert mixing.mixed(documents(spark, []).where("false")).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    df = mixing.op2_subset_sum_mixing(spark, sf_dir)
    assert df.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = mixing.mixed(docs).collect(), mixing.mixed(docs.repartition(7)).collect()
    taken, want = check(rows, one)
    assert sum(abs(taken[s] - want[s]) for s in taken) <= 0.01 * sum(want.values())
    assert sorted(one, key=str) == sorted(two, key=str)
