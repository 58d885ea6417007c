"""Corpus clean-up: toxicity, near duplicates, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``docs`` has the columns
of ``documents``, and any others, whatever their names and types; every stage but the last returns the same columns. An empty table gives an empty one,
a very long text is worked on whole, in one task, and rows that repeat each other, or share an id or have none, are rows like others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, neardup, packing, substrings, toxicity
from tallyspark.llm.common import free_name, on_workers, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of what is there, calls toxic go; null and empty texts stay."""
    on_workers(spark)
    name = free_name(docs.columns, "toxic_score")
    scored = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), name=name)
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return scored.where((F.col(name) < 0.5) | blank).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles of 0.8 or more) the row with the smallest id stays.
    Rows that share an id, or have none, are documents of their own; null and empty texts are one group, equal rows are one row."""
    on_workers(spark)
    return neardup.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has too go; a text that loses words is what is left, joined by one space. Rows without an id come last;
    null and empty texts stay as they are."""
    on_workers(spark)
    out = substrings.without_repeats(docs, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("carried.text"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[changed.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; null texts and texts without words are never taken, a null source is a source of its own."""
    on_workers(spark)
    out = mixing.mixed(docs, carry=tuple(docs.columns)).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("carried.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document: its place in the packed sequences. A null text is an empty one, of one token; equal rows are packed one by one."""
    on_workers(spark)
    return packing.pack_documents(docs, remember=50_000)  # workers are shared with the other stages


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("source mixture", mix_sources),
    ("packing", pack),
]

#: Classifier, similarity and packing have no SQL form; tests/llm holds each stage against a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
