import hashlib

import numpy as np
from llm_cases import ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import substrings


def brute(rows, window=13):
    """rows: (doc_id, text); a null id is larger than all others."""
    last = 2**63 - 1
    split = [(last if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, last), d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((None if d == last else d, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_minima_leave_no_gap():
    rng = np.random.default_rng(3)
    for n in (0, 3, 7, 8, 50, 300):
        for top in (2, 5, 2**60):
            h, use = rng.integers(0, top, n).astype(np.uint64), rng.random(n) < 0.7
            for wide in (1, 3, 7):
                at = set(substrings.minima(h, wide, use).tolist())
                assert all(at & set(range(i, i + wide)) for i in range(n - wide + 1) if use[i])


def test_word_hashes_follow_the_words():
    texts = [b"one two  three", b"", b" \t", b"two", b"three\x00 three\none", "é two".encode(), b"onetwo"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h, counts = substrings.word_hashes(data, ends - [len(t) for t in texts], ends)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_levels():
    assert [substrings.lengths(n) for n in (1, 4, 13, 14, 50)] == [[1, 1], [2, 4], [7, 13], [7, 14], [7, 13, 25, 50]]


def test_awkward_rows(spark):
    assert got(substrings.without_repeats(documents(spark))) == brute([(r[0], r[1]) for r in ROWS])
    assert substrings.without_repeats(documents(spark, []).where("false")).count() == 0


def test_random_overlaps(spark):
    rng = np.random.default_rng(4)
    pool = [f"v{i}" for i in rng.integers(0, 4, 600)] + [f"u{i}" for i in range(600)]
    rows = []
    for d in range(120):
        parts = [pool[a : a + int(n)] for a, n in zip(rng.integers(0, 1180, 4), rng.integers(0, 40, 4))]
        rows.append((d, " ".join(w for p in parts for w in p)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (13, 4, 1, 30):
        assert got(substrings.without_repeats(df, window)) == brute(rows, window)


def test_texts_that_share_an_id(spark):
    shared = [f"s{i}" for i in range(40)]
    own = [f"o{i}" for i in range(60)]
    rows = [
        (1, " ".join(shared)),
        (None, " ".join(own[:50] + shared)),
        (None, "short text"),
        (None, " ".join(shared[:20] + own[50:])),
        (7, " ".join(own[:30] + shared[5:30])),
        (7, " ".join(own[30:35])),
        (7, " ".join(shared[20:] + own[:20])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 4):
        assert got(substrings.without_repeats(df.repartition(n))) == brute(rows)


def test_many_copies_and_largest_id(spark):
    """Two thousand copies of one text and near copies of it; an id of 2**63 - 1 comes back as it is."""
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(5, 1005)]
    rows += [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(2000, 3000)]
    rows += [(2**63 - 1, " ".join(base[:20])), (None, " ".join(base[20:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = df.sparkSession.createDataFrame(substrings.without_repeats(df).toArrow())
    assert got(out.where("doc_id is not null and doc_id < 9223372036854775807")) == [r for r in brute(rows) if r[0] is not None]
    assert [(r.doc_id, r.n_removed) for r in out.where("doc_id is null or doc_id = 9223372036854775807").orderBy(F.desc("doc_id")).collect()] == [(2**63 - 1, 20), (None, 40)]
