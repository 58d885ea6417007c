import hashlib

import pytest
from llm_cases import LONG, documents
from pyspark.sql import functions as F

from tallyspark.llm import lines

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(UPPER)


def brute(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept) of each row; a null id comes after all others."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, d), d, key=order)
    out = []
    for d, text in rows:
        ls = (text or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    got = lines.without_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted([tuple(r) for r in got], key=repr)


def test_same_as_brute_force_on_awkward_rows(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(df) == brute(rows)


def test_same_as_brute_force_with_hot_lines(spark):
    rows = []
    for d in range(300):
        own = [f"line {d * 7 + k} of its own" for k in range(d % 5)]
        # a third of all lines is one line, in several spellings; some documents hold it twice
        rows.append((d, "\n".join([*own, ["  The common footer line\t", "the COMMON footer line"][d % 2], "short", f"shared by a few {d % 60}", "", "the common footer line"])))
    rows += [(None, "the common footer line\nno other has this"), (7, "the common footer line\nshared by a few 3"), (7, "the common footer line\nshared by a few 3")]
    rows += [(1000, "\n".join(f"numbered line {k % 400}" for k in range(3000))), (1001, "\n".join(f"Numbered line {k}" for k in range(0, 300, 3)) + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)
    hashes = lines.line_hashes(df)
    pieces = lines.in_pieces(hashes).where("pieces > 1").groupBy("h1").agg(F.countDistinct("piece").alias("n")).agg(F.max("n")).first()[0]
    assert pieces > 1


def test_bitmaps_name_the_lines_that_stay(spark):
    text = "\n".join(f"a line with number {k}" for k in range(200))
    df = spark.createDataFrame([(1, text.upper()), (2, "\n".join(["x" * 12, *text.split("\n")[130:140]])), (3, LONG)], "doc_id long, text string")
    out = {r.doc_id: r for r in lines.keep_bitmaps(df).collect()}
    assert set(out) == {2} and out[2].n_dropped == 10
    assert [(w.word, w.bits) for w in out[2].keep] == [(0, ~sum(1 << k for k in range(1, 11)))]


def test_only_ascii_letters_and_white_space_count(spark):
    rows = [(1, "ÄÖÜ große Straße"), (2, "äöü große straße"), (3, " padded with another space"), (4, "padded with another space"), (5, "\x1fpadded by a separator"), (6, "padded by a separator"), (7, "ÄÖÜ GROße STRAßE\r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    assert {r[0] for r in found(df) if r[2]} == {7}


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, keep string, version long, h1 string")
    assert found(empty) == []
    rows = [(1, "the same line in both", "x"), (2, "the same line in both", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string").withColumn("a.b", F.lit(1)).withColumn("piece", F.lit(1)).withColumn("_doc", F.lit(1))
    assert found(df) == brute([r[:2] for r in rows])


def test_one_shuffle_serves_stream_and_window(spark):
    df = spark.createDataFrame([(1, "the same line in both"), (2, "the same line in both")], "doc_id long, text string")
    rows = lines.in_pieces(lines.line_hashes(df)).repartitionByRange(4, "h1", "h2", "piece")
    plan = rows.withColumn("later", lines._later("h1", "h2", "piece"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["op11_first_lines"])
def test_query(spark, sf_dir, name):
    from tallyspark.llm import registry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute([tuple(r) for r in docs]))
    assert sorted(tuple(r) for r in registry.queries()[name](spark, sf_dir).collect()) == want
