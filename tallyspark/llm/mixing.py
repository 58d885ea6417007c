"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, shuffle_partitions, unbroadcast, written

#: Weights of the sources in order, repeating; copies of a document at most.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 42
#: Documents of one source and length are ranked in so many separate groups.
GROUPS = 256
#: Words that the greedy part leaves to the dynamic programme.
EXACT_WORDS = 1 << 16


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_i``, the number of each source from 1, by code point, null last: sources are range-partitioned, each part is numbered on its own, and the
    counts of the parts, one number each, say where it begins."""
    n = shuffle_partitions(sizes.sparkSession)
    parts = written(sizes.repartitionByRange(n, F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()))
    starts, at = [], 0
    for part, count in sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += count
    begins = F.broadcast(sizes.sparkSession.createDataFrame(starts, "_part int, _start long"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("source")))
    return parts.withColumn("_i", rank).join(begins, "_part").withColumn("_i", F.col("_i") + F.col("_start")).drop("_part", "_start")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (one row per source: source, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn and share all words; a target stops at ``most`` times
    its source, and what is over is shared again by weight until none is above. Each turn is one sum over all sources: with those at their
    limit left out, the level (words a unit of weight) rises, until no further source reaches its limit.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    rows = written(numbered(sizes).select("source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(most)).alias("_limit")))
    full = lambda level: F.col("_limit") <= F.lit(level) * F.col("_w")
    total, level, before = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        got = rows.agg(F.count_if(full(level)).alias("n"), F.coalesce(F.sum(F.when(full(level), F.col("_limit"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~full(level), F.col("_w"))), F.lit(0)).alias("open")).first()
        if got["n"] == before or not got["open"]:
            break
        level, before = (total - got["taken"]) / got["open"], got["n"]
    target = F.when(full(level), F.col("_limit")).otherwise(F.lit(level) * F.col("_w")).cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget (at most all words) as they can from below.

    Every length gives its share first; lengths with the largest fractions fill up until EXACT_WORDS are left at most; a
    bounded knapsack over the rest (powers of two of each length, one bit per sum) picks the best sum.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):  # only rounding can overshoot
        if rest >= 0:
            break
        k = min(int(take[i]), -(rest // int(sizes[i])))
        take[i] -= k
        rest += k * int(sizes[i])
    for i in np.argsort(take - share, kind="stable"):
        if rest <= EXACT_WORDS:
            break
        if take[i] < counts[i] and sizes[i] <= rest:
            take[i] += 1
            rest -= int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= EXACT_WORDS:
            break
        k = min(int(counts[i] - take[i]), rest // int(sizes[i]))
        take[i] += k
        rest -= k * int(sizes[i])
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in np.argsort(take - share, kind="stable"):
        room, k = min(int(counts[i] - take[i]), rest // int(sizes[i])), 1
        while room > 0 and not reach >> rest & 1:
            k = min(k, room)
            steps.append((i, k, reach))
            reach |= reach << (k * int(sizes[i])) & mask
            room, k = room - k, 2 * k
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(sizes[i])
    return take


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, carried): how often each row of ``docs`` is in the mix.

    Sizes are whole words; a null or blank text has none and is never taken. Whole rounds of a source come first; the rest
    of its budget takes further documents, chosen by length count and, within a length, in the order of a seeded
    hash. Only counts by source and length meet in one task; the documents of a length are ranked in GROUPS groups, so a
    length that holds a third of the rows is no hot spot. Rows that repeat each other count one by one. A very long text counts like any other; an empty table gives no rows. ``carried`` is a struct of the columns
    in ``carry``, whatever their names; other columns are not read.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text))
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    extra = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    group = F.pmod(F.shiftright(h, 17), F.lit(GROUPS)).cast("int")
    rows = written(docs.select("doc_id", "source", size.alias("size"), name.alias("_s"), h.alias("_h"), group.alias("_g"), extra.alias("carried")))
    groups = rows.groupBy("_s", "source", "size", "_g").agg(F.count("*").alias("_n"))
    lengths = written(groups.groupBy("_s", "source", "size").agg(F.sum("_n").alias("_n")))
    goals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, most)
    goals = goals.withColumn("_s", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))).drop("source")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        full, budget = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
        rounds, rest = divmod(budget, full) if full else (0, 0)
        rounds, rest = (most, 0) if rounds >= most else (rounds, rest)
        own = pdf["size"].to_numpy() > 0
        extra = np.zeros(len(pdf), np.int64)
        extra[own] = fit(pdf["size"].to_numpy()[own], pdf["_n"].to_numpy()[own], rest)
        return pdf.assign(_rounds=np.where(own, rounds, 0), _extra=extra)[["_s", "size", "source_size", "target", "_rounds", "_extra"]]

    chosen = lengths.select("_s", "size", "_n").join(goals, "_s").groupBy("_s").applyInPandas(choose, "_s string, size long, source_size long, target double, _rounds long, _extra long")
    before = F.sum("_n").over(Window.partitionBy("_s", "size").orderBy("_g")) - F.col("_n")
    shares = groups.select("_s", "size", "_g", "_n").join(unbroadcast(chosen), ["_s", "size"]).withColumn("_left", F.col("_extra") - before).drop("_n", "_extra")
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_g").orderBy("_h", "doc_id"))
    copies = (F.col("_rounds") + (rank <= F.col("_left")).cast("long")).alias("copies")
    return rows.join(unbroadcast(shares), ["_s", "size", "_g"]).select("doc_id", "source", "size", "source_size", "target", copies, "carried")


def op2_subset_sum_mixing(spark, sf_dir) -> DataFrame:
    """One row per document: the words that the mix takes of it, repeats counted."""
    from tallyspark.llm.common import table

    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
