"""Each stage of the pipeline against a brute-force version, on awkward rows with clashing columns, and recall on a given table."""

import json
from collections import Counter

import corpus_pipeline
import pytest
import test_neardup
from llm_cases import LONG, ROWS, documents
from pyspark.sql import functions as F
from test_packing import holds

from tallyspark.llm import common, toxicity

STAGES = dict(corpus_pipeline.STAGES)
#: Names that stages use themselves, a name with a dot, and a map.
CLASHES = ["_node", "_key", "a.b", "copies", "_copy", "kept", "carried", "n_removed", "toxic_score", "group", "first", "bucket", "_s", "_g", "_h"]


def awkward(spark, rows=ROWS):
    df = documents(spark, rows)
    for name in CLASHES:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df.withColumn("m", F.create_map(F.lit("k"), F.col("lang"))).withColumn("many", F.array("doc_id", F.lit(None).cast("long")))


def plain(rows):
    """Rows as comparable texts, all columns of them."""
    return Counter(json.dumps({k: v for k, v in r.asDict(recursive=True).items()}, sort_keys=True) for r in rows)


def same_others(got, before, changed=()):
    """Every row that is left is one of before, but for the ``changed`` columns."""
    drop = lambda rows: Counter(json.dumps({k: v for k, v in r.asDict(True).items() if k not in changed}, sort_keys=True) for r in rows)
    return not drop(got) - drop(before)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, sf_dir, name):
    df = awkward(spark).where("false")
    out = STAGES[name](spark, df, sf_dir)
    assert out.count() == 0 and (name == "packing" or out.columns == df.columns)


def test_toxicity(spark, sf_dir):
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = {r[0] for r in real}
    df = awkward(spark, real + [r for r in ROWS if r[0] not in ids] + [(None, real[5][1], None, None), (None, None, None, None)])
    model = toxicity.learn(df, common.table(spark, sf_dir, "labels"))
    before = df.collect()
    want = [r for r in before if not (r.text or "").strip(" ") or model.score(r.text) < 0.5]
    got = STAGES["toxicity"](spark, df, sf_dir).collect()
    assert plain(got) == plain(want) and 0 < len(want) < len(before)


def test_near_duplicates(spark, sf_dir):
    rows = [*ROWS, (11, LONG + " tail", "en", "b"), (None, "a row without  an ID", "en", "c"), (30, ROWS[0][1] + " extra", "en", "a")]
    df = awkward(spark, rows)
    got, want = STAGES["near duplicates"](spark, df, sf_dir), test_neardup.brute(rows)
    assert got.columns == df.columns and got.schema == df.schema
    kept = got.collect()
    assert len(kept) == len(want) and same_others(kept, df.collect())
    for least, texts in want:
        assert sum(r.doc_id == least and r.text in texts for r in kept) == 1


def test_rows_that_differ_in_where_a_null_is(spark, sf_dir):
    rows = [(1, "some words of a text that two rows share", "x", None), (1, "some words of a text that two rows share", None, "x")]
    df = documents(spark, rows)
    kept = STAGES["near duplicates"](spark, df, sf_dir).collect()
    assert len(kept) == 1 and same_others(kept, df.collect())
    hashes = df.select(common.wide_hash(*common.hashable(df)).alias("h")).distinct().collect()
    assert len(hashes) == 2 and all(len(r.h) == 16 for r in hashes)


def cut(rows, window=13):
    """The text left of each row."""
    last = 2**63 - 1
    split = [(last if d is None else d, common.split_words((t or "").encode())) for d, t in rows]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, last), d)
    for (_, text), (d, ws) in zip(rows, split, strict=True):
        gone = {j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for j in range(i, i + window)}
        yield b" ".join(w for i, w in enumerate(ws) if i not in gone).decode() if gone else text


def test_repeated_passages(spark, sf_dir):
    shared = " ".join(f"passage{k}" for k in range(60))
    rows = [*ROWS, (20, f"before {shared} after", "en", "a"), (21, f"other\t{shared}\nend  of it", "en", "b"), (22, shared, None, None), (23, " ".join(shared.split()[:12]), "en", "a")]
    df = awkward(spark, rows)
    before = df.collect()
    got = STAGES["repeated passages"](spark, df, sf_dir).collect()
    want = Counter((r.doc_id, t, r["_node"], len(t) if t is not None else None) for r, t in zip(before, cut([(r.doc_id, r.text) for r in before]), strict=True))
    assert Counter((r.doc_id, r.text, r["_node"], r.n_chars) for r in got) == want
    assert same_others(got, before, ("text", "n_chars")) and any(r.text == "other end of it" for r in got)


def test_source_mixture(spark, sf_dir):
    rows = [*ROWS, *[(100 + k, " ".join(["word"] * (1 + k % 40)), "en", "abc"[k % 3]) for k in range(300)]]
    df = awkward(spark, rows)
    before, got = df.collect(), STAGES["source mixture"](spark, df, sf_dir).collect()
    size = lambda r: len(common.split_words((r.text or "").encode()))
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, open_, goal = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), {}
    total = sum(sizes.values())
    while True:  # water-filling, source by source
        level = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * sizes[s]
            open_.remove(s)
    goal |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        taken[r.source] += size(r)
    for s in names:
        longest = max(size(r) for r in before if r.source == s)
        # a document longer than the target cannot be taken
        assert 0 <= goal[s] + 1 - taken[s] <= (longest if longest > goal[s] else 2 + 0.02 * goal[s]), s
    assert not {k for k, n in plain(got).items() if n > 3 * plain(before)[k]}
    assert all(size(r) for r in got) and set(plain(got)) <= set(plain(before))


def test_packing(spark, sf_dir):
    rows = [(k, t, "en", "a") for k, t in enumerate([LONG, None, "", "a <|endoftext|> b", *[" ".join(["word"] * n) for n in range(1, 1500, 37)]])]
    pieces = STAGES["packing"](spark, awkward(spark, rows), sf_dir).collect()
    bins = holds([(r[0], r[1]) for r in rows], pieces)
    assert bins <= -(-sum(p.length for p in pieces) // 2048) * 1.2 + 1


def test_recall_on_a_given_table(spark):
    """All groups of sf0.01 that the exact similarities of all pairs give, and no others."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = [test_neardup.shingles(t) for _, t in rows]
    at, pairs = {}, Counter()
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for own in at.values():
        pairs.update((own[j], own[i]) for i in range(len(own)) for j in range(i))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    blank = [i for i, s in enumerate(sets) if not s]
    for i, j in [p for p, n in pairs.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + list(zip(blank, blank[1:], strict=False)):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    want = {}
    for i, (d, _) in enumerate(rows):
        want[top(i)] = min(want.get(top(i), d), d)
    got = STAGES["near duplicates"](spark, df, "/root/testdata/sf0.01")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want.values())
    assert len(want) < len(rows)


def test_settings_with_units(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(name, "64m")
    common.on_workers(spark)
    assert common.size_of(spark.conf.get(name)) == common.BATCH_BYTES
    spark.conf.set(name, before)
    assert [common.size_of(x) for x in ("10000", "64m", "1gb", "8388608b", "2KB", "-1")] == [10_000, 64 << 20, 1 << 30, 8_388_608, 2048, -1]
