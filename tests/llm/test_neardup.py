"""The pipeline's near-duplicate stage against all pairs."""

import corpus_pipeline
import numpy as np
from llm_cases import ROWS, documents

from tallyspark.llm import mixing, neardup, packing
from tallyspark.llm.common import written


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """rows: (doc_id, text, ...) -> for each group its smallest id (None if it has none) and its texts."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for r, g in zip(rows, root):
        groups.setdefault(g, []).append(r)
    out = []
    for g in groups.values():
        least = min((r[0] for r in g if r[0] is not None), default=None)
        out.append((least, {r[1] for r in g if r[0] == least}))
    return out


def check(spark, rows):
    got, want = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect(), brute(rows)
    assert len(got) == len(want)
    for least, texts in want:
        assert sum(r.doc_id == least and r.text in texts for r in got) == 1


def edited(rng, words, n):
    words = list(words)
    for k, i in enumerate(rng.choice(len(words), n, replace=False)):
        words[i] = f"edit{rng.integers(1 << 30)}x{k}"
    return words


def test_edited_copies(spark):
    rng = np.random.default_rng(6)
    rows, no = [], 0
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(100, 400)))]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            no += 1
            rows.append((no, " ".join(edited(rng, base, int(share * len(base)))), "en", "a"))
    assert 40 < len(brute(rows)) < 200
    check(spark, rows)


def test_large_group(spark, monkeypatch):
    """Copies of one text, most of them too different from each other to be linked: their buckets are compared in (here small) blocks."""
    monkeypatch.setattr(neardup, "FEW", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = [(no, " ".join(edited(rng, base, int(rng.integers(2, 9)))), "en", "a") for no in range(300)]
    assert 20 < len(brute(rows)) < 250
    check(spark, rows)


def test_shared_counts():
    rng = np.random.default_rng(9)
    xs, ys = ([np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in sizes] for sizes in ((1, 40, 500), (0, 7, 90, 200)))
    for width in (1, 64, 4096):
        got = neardup.shared_counts(xs, ys, width)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert sorted(neardup.joining(np.array([1, 1, 2, 3, 3]), np.array([0, 1, 2, 0]), np.array([2, 2, 3, 4]))) in ([0, 2], [0, 3], [1, 2], [1, 3], [2, 3])


def test_ids_that_are_no_key(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 900, 120)) for _ in range(6)]
    near = " ".join(edited(rng, texts[0].split(), 2))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, near), (8, texts[5]), (8, texts[5]), (9, texts[4].upper())]
    check(spark, [(*r, "en", "a") for r in rows])
    check(spark, ROWS)
    assert corpus_pipeline.drop_near_duplicates(spark, documents(spark, []).where("false"), "").count() == 0


def test_simhash_comes_first(spark, monkeypatch):
    """Candidates of the Golay-decoded fingerprints are part of the stage; the exact similarity decides on them too."""
    rows = [(bytes([i]), fp) for i, fp in enumerate([0, 0, 0b111, 0b1111, -1])]
    pairs = neardup._close(spark.createDataFrame(rows, "node binary, fp long")).distinct().collect()
    assert sorted((r.a[0], r.b[0]) for r in pairs) == [(0, 1), (0, 2), (2, 3)]
    asked, decode = [], neardup.golay_links
    monkeypatch.setattr(neardup, "golay_links", lambda fps: asked.append(fps.columns) or decode(fps))
    rng = np.random.default_rng(10)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    check(spark, [(no, " ".join(edited(rng, base, n)), "en", "a") for no, n in enumerate((0, 1, 2, 40, 41))])
    assert asked == [["fp"]]


def test_tables_that_grow_are_not_broadcast(spark):
    """Spark sizes exploded keys and compressed files too low; few pairs, counted, go to the sets."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = written(spark.range(300).selectExpr("cast(cast(id as string) as binary) as node", "xxhash64(id) as fp", "cast('x' as binary) as grams"))
    pairs = nodes.selectExpr("node as a", "node as b")
    stages = [neardup._close(nodes), neardup._alike(pairs, nodes.select("node", "grams"), 0.8), neardup.one_per_group(documents(spark))]
    for df in [*stages, packing.pack_documents(documents(spark))]:
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    few = lambda n: "BroadcastHashJoin" in plan(neardup._alike(pairs, nodes.select("node", "grams"), 0.8, n))
    assert few(neardup.SENT) and not few(neardup.SENT + 1)
    kept = [line for line in plan(mixing.mixed(documents(spark))).split("\n") if "HashJoin" in line]
    assert all("_g#" not in line and "size#" not in line for line in kept)
