"""Licence windows against a brute-force version."""

import random

from llm_cases import ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import licences


def grams(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def normal(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def brute(text, templates=licences.TEMPLATES, least=0.8):
    lines = [normal(line) for line in (text or "").split("\n")]
    most, found = licences._most_words(templates, least), []
    for k, (name, t) in enumerate(templates):
        own = grams(normal(t))
        seeds = [i for i, w in enumerate(lines) if grams(w) & own]
        for i in seeds:
            for j in seeds:
                words = [w for line in lines[i : j + 1] for w in line]
                if j == i or j > i and len(words) <= most:
                    g = grams(words)
                    dice = 2.0 * len(g & own) / (len(g) + len(own))
                    if dice >= least:
                        found.append((-dice, j - i, i, k, j, name))
    stay = [w for w in found if not any(v[2] <= w[4] and w[2] <= v[4] and v[:4] < w[:4] for v in found)]
    return sorted((i, j, name, k, -d) for d, _, i, k, j, name in stay)


def broken(rng, text, width):
    words, lines = text.split(), []
    while words:
        n = rng.randrange(1, width)
        lines.append(" ".join(words[:n]))
        words = words[n:]
    return "\n".join(lines)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "no licence here\nat all", "Hello\n** released UNDER the mit licence, **\nReleased under the MIT License.\nReleased under the MIT License.", "Licensed under\nCC BY-NC\n4.0.", "x\nLicensed under CC BY 4.0.\n\n\nLicensed under CC BY-SA 4.0.\n"]
    for name, t in licences.TEMPLATES:
        for width in (4, 13, 30):
            words = t.split()
            for k in rng.sample(range(len(words)), len(words) // 15):
                words[k] = f"changed{k}"
            texts.append("\n".join(["A file of ours", broken(rng, " ".join(words), width), "and more words in the text", broken(rng, licences.TEMPLATES[rng.randrange(15)][1], 9)]))
        texts.append(t.lower().replace(" ", " \t") + " tail of the line")
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    got = {}
    for r in licences.notices(documents(spark, rows).withColumn("a.b", F.lit(1)).withColumn("_lines", F.lit(1)).withColumn("_templates", F.lit(1))).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.last_line, r.licence, r.template, r.dice))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == brute(t), (k, t)
    assert {name for own in got.values() for _, _, name, _, _ in own} == {name for name, _ in licences.TEMPLATES}
    assert max(j - i for own in got.values() for i, j, *_ in own) > 20


def test_awkward_rows(spark):
    found = licences.notices(documents(spark, [*ROWS, (50, "Licensed under CC BY 4.0.", None, None), (50, "Licensed under CC BY 4.0.", None, None)])).collect()
    assert [(r.doc_id, r.line_no, r.last_line, r.dice) for r in found] == [(50, 0, 0, 1.0)] * 2
    assert licences.notices(documents(spark, []).where("false")).count() == 0
