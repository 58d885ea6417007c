import numpy as np
import xxhash
from llm_cases import ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.common import written


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(pairs):
    """(id, fp) pairs -> id: smallest id reachable."""
    ids, fps = [p[0] for p in pairs], np.array([p[1] for p in pairs], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        x = fps ^ fps[i]
        for j in np.flatnonzero(np.bitwise_count(x) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, least.get(find(i))) for i, d in enumerate(ids)]


def test_codewords_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    y = x ^ (1 << rng.integers(0, 23, 3000))
    cx, cy = simhash.codewords(x), simhash.codewords(y)
    assert all(a[0] in set(b) and b[0] in set(a) for a, b in zip(cx, cy))


def test_links_are_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = list(base)
    for f in base:
        for n in (1, 2, 3, 3, 3, 4):
            for b in rng.choice(64, n, replace=False):
                f = f ^ (np.uint64(1) << np.uint64(b))
            fps.append(f)
    fps = np.unique(np.array(fps, np.uint64)).view(np.int64)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long")).collect()}
    u = fps.view(np.uint64)
    want = {(min(int(fps[i]), int(fps[j])), max(int(fps[i]), int(fps[j]))) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3) if i != j}
    assert got == want


def check(rows, out):
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in out.collect()), key=str)
    fps = [(d, brute_fp(t)) for d, t in rows]
    want = sorted(((d, int(np.uint64(f).astype(np.int64)), c) for (d, f), (_, c) in zip(fps, brute_groups(fps))), key=str)
    assert got == want


def test_awkward_rows(spark):
    check([(r[0], r[1]) for r in ROWS], simhash.near_duplicates(documents(spark)))
    assert simhash.near_duplicates(documents(spark, []).where("false")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash.op5_simhash_golay(spark, sf_dir)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], out.withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")))


def test_no_side_of_the_links_is_broadcast(spark):
    """A fingerprint has some 60 keys, but Spark sizes them by the small table they come from: a broadcast of them fills the driver."""
    nodes = written(spark.range(500).select(F.xxhash64("id").alias("fp")))
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = simhash.near_duplicates(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
