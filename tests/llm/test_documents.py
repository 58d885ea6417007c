"""Toxicity, language, sharding, licences and the pipeline on awkward rows and held-out rows."""

import unicodedata
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from llm_cases import ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import language, licences, sharding, toxicity


def test_toxicity_held_out(spark):
    out = toxicity.op1_toxicity_counterfactual(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic is not null")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean, toxic = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


def made_texts(rng, n=120):
    """Toxic sentences that name one group often, clean ones that hardly do."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    bad, good, rest = ["trash", "scum", "idiots", "vermin"], ["lovely", "calm", "bright", "kind"], ["today", "yesterday", "again", "often", "there"]
    toxic = [f"the gay neighbours are {pick(bad)} {pick(rest)}" if i % 2 else f"all of you are {pick(bad)} {pick(rest)}" for i in range(n)]
    clean = [f"a {pick(good)} walk {pick(rest)} near the river" for _ in range(n - 4)] + ["the straight neighbours are kind today", "the gay neighbours are calm"] * 2
    return clean, toxic


def test_swaps_are_rescored_and_penalised():
    """With the penalty fewer neutral mentions of a group are called toxic, and toxic sentences still are."""
    rng = np.random.default_rng(11)
    clean, toxic = made_texts(rng)
    rows = [toxicity.hashed(toxicity.words_of(t)) for t in clean + toxic]
    pairs = [tuple(map(toxicity.hashed, p)) for t in clean + toxic for p in toxicity.swapped_sentences(t)]
    assert toxicity.swapped_sentences("Gay men. Nothing here!", (("gay", "straight"), ("men", "women"))) == [({"gay", "men"}, {"straight", "men"}), ({"gay", "men"}, {"gay", "women"})]
    neutral = [f"gay {x} {y}" for x in ("neighbours", "teachers", "writers", "couple", "singers") for y in ("met at noon", "walked home", "read today", "spoke often")]
    false, flips, caught, gap = {}, {}, {}, {}
    for fairness in (0.0, toxicity.FAIRNESS):
        m = toxicity.train(rows, [0] * len(clean) + [1] * len(toxic), pairs, fairness=fairness, max_share=1.0)
        false[fairness] = sum(m.score(t) >= 0.5 for t in neutral)
        flips[fairness] = sum((m.score(t) >= 0.5) != (m.score(t.replace("gay", "straight")) >= 0.5) for t in neutral)
        caught[fairness] = np.mean([m.score(t) >= 0.5 for t in made_texts(rng)[1]])
        gap[fairness] = np.mean([abs(m.score(t) - m.score(t.replace("gay", "straight"))) for t in neutral])
    print("false positives", false, "by the term alone", flips, "caught", caught, "change of score", gap)
    assert false[toxicity.FAIRNESS] < false[0.0] and flips[toxicity.FAIRNESS] < 0.5 * flips[0.0] and gap[toxicity.FAIRNESS] < 0.5 * gap[0.0]
    assert caught[toxicity.FAIRNESS] >= 0.95


def test_gradient_is_that_of_the_value():
    rng = np.random.default_rng(12)
    names = np.arange(9)
    some = lambda n: toxicity.Rows([rng.integers(0, 12, 5).tolist() for _ in range(n)], names)
    goal = toxicity.Objective(some(20), (np.arange(20) % 3 == 0).astype(float), some(7), some(7), 3.0)
    w, bias, h = rng.normal(size=9), 0.3, 1e-6
    g, gb = goal.gradient(w, bias)
    for k in range(9):
        e = np.eye(9)[k] * h
        assert abs((goal.value(w + e, bias) - goal.value(w - e, bias)) / (2 * h) - g[k]) < 1e-6
    assert abs((goal.value(w, bias + h) - goal.value(w, bias - h)) / (2 * h) - gb) < 1e-6


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark), labels, held_out=4)
    out = toxicity.scored(documents(spark), model)
    assert out.count() == len(ROWS) and out.where("toxic_score is null or toxic_score < 0 or toxic_score > 1").count() == 0
    kept = toxicity.scored(documents(spark).withColumn("Toxic_Score", F.lit("mine")), model)
    assert kept.columns[-2:] == ["Toxic_Score", "toxic_score_"] and kept.where("Toxic_Score = 'mine'").count() == len(ROWS)
    none = toxicity.learn(documents(spark), labels.where("false"))
    assert toxicity.scored(documents(spark), none).where("toxic_score < 0.01").count() == len(ROWS)


def brute_language(train, texts):
    """Word log frequencies, backing off to the longest n-grams that are known; all in memory."""
    words_of = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()
    counts, langs = {}, sorted({x for _, x in train if x is not None})
    for t, lang in train:
        for w in words_of(t) if lang is not None else ():
            counts.setdefault((0, w), Counter())[lang] += 1
            for n in range(1, 5):
                for g in language.grams(w, n):
                    counts.setdefault((n, g), Counter())[lang] += 1
    total = Counter()
    for (n, _), c in counts.items():
        for lang, k in c.items():
            total[n, lang] += k

    def vector(w):
        if (0, w) in counts:
            return np.array([np.log((counts[0, w][x] + 0.5) / (total[0, x] + 1)) for x in langs])
        for n in range(4, 0, -1):
            own = [g for g in language.grams(w, n) if (n, g) in counts]
            if own:
                return np.mean([[np.log((counts[n, g][x] + 0.5) / (total[n, x] + 1)) for x in langs] for g in own], 0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        ws = words_of(t)
        z = sum(map(vector, ws), np.zeros(len(langs)))
        out.append((langs[int(z.argmax())], 1 / np.exp(z - z.max()).sum()) if ws else ("und", 0.0))
    return out


def test_language_against_brute_force(spark, sf_dir):
    """Rare, unseen and foreign words too, whatever the share of words that is broadcast."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").limit(90).collect()]
    train, texts = rows[:40], [t for t, _ in rows[40:]] + ["żółć 東京 zzzxq!", "", None, "12 _ \u3000 ²", "² ½ Ⅷ", "x² ½y Ⅷz", "İstanbul'da ǅ", "the the unseenwordhere"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("lang_pred", F.lit("mine")).withColumn("no", F.lit(1))
    want = brute_language(train, texts)
    for entries in (0, 60, 400_000):
        model = language.learn(spark.createDataFrame(train, "text string, lang string"), entries)
        assert len(model.common) * len(model.langs) <= entries
        got = sorted(language.identified(frame, model).collect())
        assert all(r.lang_pred == "mine" and r.lang_pred_ == w[0] and abs(r.lang_score - w[1]) < 1e-6 for r, w in zip(got, want, strict=True)), entries


def test_language(spark):
    out = language.op3_language_backoff(spark, "/root/testdata/sf0.01")
    rows = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language.identified(documents(spark), language.learn(documents(spark))).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 6, 8)] == ["und", "und", "und", "fr", "de"]
    none = language.learn(documents(spark).where("false"))
    assert language.identified(documents(spark), none).where("lang_pred = 'und' and lang_score = 0").count() == len(ROWS)
    assert language.identified(documents(spark).where("false"), language.learn(documents(spark))).count() == 0


def brute_shard(doc_id, n):
    def h(shard):
        x = 42
        for kind, v in (("i", 42), ("i", shard), ("s", doc_id)):
            if v is not None:
                x = xxhash.xxh64_intdigest(np.int32(v).tobytes() if kind == "i" else str(v).encode(), x)
        return ((x >> 11) + 0.5) / 2**53

    return max(range(n), key=lambda s: (np.log(h(s)), -s))


def test_sharding(spark):
    rows = sharding.sharded(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.shard == brute_shard(r.doc_id, 16) and r.grown_shard in (r.shard, 16) and r.grown_shard == brute_shard(r.doc_id, 17)
    many = sharding.sharded(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    for s in range(16):
        own = sorted(r.slot for r in many if r.shard == s)
        assert own == list(range(len(own))) and 150 < len(own) < 350
    moved = [r for r in many if r.grown_shard != r.shard]
    assert all(r.grown_shard == 16 for r in moved) and 150 < len(moved) < 330
    heavy = sharding.sharded(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), weights=[3.0, 1.0]).where("shard = 0").count()
    assert 2800 < heavy < 3200
    assert sharding.sharded(documents(spark).where("false")).count() == 0


def test_licences(spark):
    rows = [(1, "Hello world\n** released UNDER the mit licence, **\nReleased under the MIT License.", None, None), (2, "Licensed under CC BY-NC 4.0.\nplain words of no licence at all", None, None), *[(100 + (r[0] or 0), *r[1:]) for r in ROWS]]
    got = {(r.doc_id, r.line_no): (r.licence, r.dice) for r in licences.notices(documents(spark, rows)).collect()}
    assert got == {(1, 2): ("MIT", 1.0), (2, 0): ("CC-BY-NC-4.0", 1.0)}
    assert licences.notices(documents(spark, []).where("false")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, n = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.toArrow())
        n.append(docs.count())
    assert n[0] < 200 and n[1] < n[0] and n[2] == n[1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("piece = 0").count() == n[3]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
