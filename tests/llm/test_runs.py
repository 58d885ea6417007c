import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from llm_cases import documents
from pyspark.sql import functions as F

from tallyspark.llm import runs


def brute(words, exponent=4, length=6):
    """Every run as (start, length, period), by trying each period over each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def tokens(docs):
    doc = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
    return np.array([k * 100 + x for k, d in enumerate(docs) for x in d], np.int64), doc


def test_same_as_brute_force_over_small_alphabets():
    rng = random.Random(3)
    for _ in range(800):
        docs = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(50))] for _ in range(rng.randrange(1, 4))]
        docs = [d[: rng.randrange(9)] * rng.randrange(9) + d for d in docs]
        got, want, at = sorted(map(tuple, runs.runs_of(*tokens(docs)).tolist())), [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in brute(d)]
            at += len(d)
        assert got == sorted(want)


def test_other_bounds():
    rng = random.Random(4)
    for exponent, length in ((2, 2), (3, 4), (2, 7)):
        for _ in range(200):
            d = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
            assert sorted(map(tuple, runs.runs_of(*tokens([d]), exponent, length).tolist())) == brute(d, exponent, length)


def test_long_repetitions():
    one = runs.runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64))
    assert one.tolist() == [[0, 100_000, 1]]
    block = list(range(2000)) * 7
    assert runs.runs_of(*tokens([[5, *block, 9, 9, 9, 9, 9, 9]])).tolist() == [[1, 14_000, 2000], [14_001, 6, 1]]


def test_bounds_of_staircases_without_jumps(monkeypatch):
    rng = np.random.default_rng(5)
    lcp = np.r_[-1, rng.integers(0, 6, 300), np.arange(200), -1]
    at = np.flatnonzero(lcp >= 1)
    jumped = [runs.nearest_smaller(lcp, at, s) for s in (-1, 1)]
    monkeypatch.setattr(runs, "JUMPS", 1)
    for step, want in zip((-1, 1), jumped, strict=True):
        assert (runs.nearest_smaller(lcp, at, step) == want).all()


def expected(doc_id, text):
    words = runs.split_words(text.encode()) if text else []
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_same_as_brute_force(spark, tmp_path):
    from llm_cases import SCHEMA

    rng = random.Random(6)
    rows = [(d, " ".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(120))) + "\x0b ja ja\nja ja ja ja" * (d % 3), "en", "a") for d in range(150)]
    rows += [(None, "x " * 40, "en", None), (900, None, None, None), (901, "", "en", "a"), (902, "één één één één één één", "nl", "a"), (902, "één één één één één één", "nl", "a"), (903, "new york " * 4 + "new", "en", "b")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([expected(d, t) for d, t, *_ in rows], key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_awkward_rows_and_empty_table(spark):
    df = documents(spark).withColumn("kept", F.lit(1)).withColumn("_data", F.lit("x")).withColumn("a.b", F.lit(1))
    got = sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in runs.periodic_runs(df).collect()], key=repr)
    words = [(r.doc_id, runs.split_words((r.text or "").encode())) for r in df.select("doc_id", "text").collect()]
    want = [(d, len(w), brute(w) if len(w) < 10_000 else [(0, 30_000, 997)]) for d, w in words]
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).collect() == []
    text_ids = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert runs.periodic_runs(text_ids).schema["doc_id"].dataType.typeName() == "string" and runs.periodic_runs(text_ids).count() == df.count()
