"""Language of texts by known words, backing off to shorter and shorter character n-grams for others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import fold, free_name, slices, written

#: Longest character n-gram.
ORDER = 4
#: Numbers (words times languages) that are broadcast: the most frequent words. All other words are looked up by a join; the result is the same whatever this is.
ENTRIES = 400_000
_ASCII = bytes(range(128))
_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@cache
def _is_letter(c: str) -> bool:
    return c.isalpha()  # categories L*


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of letters (UTF-8)."""
    if not text:
        return []
    low = text.lower()
    data = low.encode()
    if len(data) != len(low):
        for c in set(data.translate(None, _ASCII).decode()):
            if not _is_letter(c):
                low = low.replace(c, " ")
        data = low.encode()
    return data.translate(_BLANKED).split()


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def gram_column(word: Column, n: int) -> Column:
    """``grams`` as a column."""
    w = F.concat(F.lit("^"), word, F.lit("$")) if n > 1 else word
    last = F.length(w) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    """Log frequencies ``vec`` per language: of all words (key, vec) and of all n-grams (n, key, vec) as tables, of ``common`` words in memory."""

    langs: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    common: dict[bytes, int] | None = None
    rows: np.ndarray | None = None


def _flush(counts: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, n), c in counts.items():
        keys = list(c)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            key = pa.array(part, pa.binary()).cast(pa.string()) if isinstance(part[0], bytes) else pa.array(part, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), key, pa.array([c[k] for k in part], pa.int64())], ["lang", "n", "key", "count"])
    counts.clear()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, n = 0, key, count) over all texts with a language, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts.setdefault((lang, 0), Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > 400_000:
                yield from _flush(counts)
        yield from _flush(counts)

    rows = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, n int, key string, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, n, key, count) of all n-grams of the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        for b in batches:
            for lang, word, k in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "count")), strict=True):
                for n in range(1, ORDER + 1):
                    c = counts.setdefault((lang, n), Counter())
                    for g in grams(word, n):
                        c[g] += k
            if sum(map(len, counts.values())) > 400_000:
                yield from _flush(counts)
        yield from _flush(counts)

    return words.select("lang", "key", "count").mapInArrow(run, "lang string, n int, key string, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))


def _vectors(counts: DataFrame, langs: list[str], totals: dict[tuple[str, int], int], orders: range) -> DataFrame:
    """(n, key, total, vec) of counts (lang, n, key, count): log((count + 1/2) / (total of the language + 1)) for each language."""
    per = counts.groupBy("n", "key").agg(F.sum("count").alias("total"), *[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("count"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)])
    size = lambda x: F.element_at(F.create_map(*[F.lit(v) for n in orders for v in (n, float(totals.get((x, n), 0) + 1))]), F.col("n"))
    return per.select("n", "key", "total", F.array(*[F.log((F.col(f"c{i}") + 0.5) / size(x)) for i, x in enumerate(langs)]).alias("vec"))


def learn(docs: DataFrame, entries: int = ENTRIES) -> Model:
    """Counts all words of ``docs`` with a language, and their n-grams; nothing is left out. No such document: a model without languages.

    The languages (a short list of labels) and the ``entries`` of the most frequent words reach the driver. Words of one
    frequency are common all or none; the frequency that takes is read from a histogram.
    """
    words = written(word_counts(docs))
    per_gram = written(gram_counts(words))
    both = words.unionByName(per_gram).groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()
    totals = {(r["lang"], r["n"]): r["total"] for r in both}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return Model([])
    known = written(_vectors(words, langs, totals, range(1)).drop("n"))
    step = F.floor(F.log2("total") * 8).cast("int")
    left, least = entries // len(langs), None
    for r in sorted(known.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).collect(), reverse=True):
        left -= r["keys"]
        if left < 0:
            break
        least = r["step"]
    common = known.where(step >= least).select("key", "vec").toArrow() if least is not None else None
    names = [k.encode() for k in common["key"].to_pylist()] if common is not None else []
    rows = np.array(common["vec"].to_pylist(), float) if names else np.zeros((0, len(langs)))
    return Model(langs, known.select("key", "vec"), written(_vectors(per_gram, langs, totals, range(1, ORDER + 1)).drop("total")), {k: i for i, k in enumerate(names)}, rows)


def backed_off(words: DataFrame, model: Model) -> DataFrame:
    """(key, vec) of ``words`` (key): a word that was counted has its own, another the mean of its n-grams of the greatest length that has known ones;
    a word without any known character has no row."""
    found = words.join(model.words, "key").select("key", "vec")
    left = written(words.join(model.words, "key", "left_anti").select("key"))
    for n in range(ORDER, 0, -1):
        if left.isEmpty():
            break
        own = left.select("key", F.explode(gram_column(F.col("key"), n)).alias("gram"))
        known = model.grams.where(F.col("n") == n).select(F.col("key").alias("gram"), "vec")
        mean = F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(len(model.langs))])
        hit = written(own.join(known, "gram").groupBy("key").agg(mean.alias("vec")))
        found, left = found.unionByName(hit), written(left.join(hit, "key", "left_anti"))
    return found


def identified(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` and two more, ``names``, for every whole text: its language and a score from 0 to 1.

    ``und`` and 0 for null and empty texts, texts without a letter, and a model that has seen no language; ties go to the language first
    by name. Repeated rows each get their own row, an empty table gives none. A column of ``docs`` that has one of the ``names`` stays, and the
    new one gets a name with ``_`` at its end. Common words are added up where the text is read; of other words
    only counts leave it, and join with the model's tables.
    """
    keep = tuple(docs.columns if keep is None else keep)
    pred, score = (free_name(keep, n) for n in names)
    if not model.langs:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias(pred), F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast((model.common, model.rows))
    width = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rows = shared.value
        for b in slices(batches, "text"):
            sums, lists, ends, keys, counts = [], [0], 0, [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                own, rare = np.zeros(width), Counter()
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    at = np.fromiter(map(common.get, part, repeat(-1)), np.int64, len(part))
                    own += rows[at[at >= 0]].sum(0)
                    rare.update([part[i] for i in np.flatnonzero(at < 0).tolist()])
                sums.append(own.tolist() if words else None)
                keys += rare.keys()
                counts += rare.values()
                ends += len(rare)
                lists.append(ends)
            pairs = pa.StructArray.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["key", "n"])
            columns = [pa.array(sums, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pairs), b.column("carried")]
            yield pa.RecordBatch.from_arrays(columns, ["own", "rare", "carried"])

    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("carried")
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), carried)
    kinds = T.StructType.fromDDL("own array<double>, rare array<struct<key:string,n:bigint>>").add("carried", rows.schema["carried"].dataType)
    read = written(rows.select("text", "carried").mapInArrow(run, kinds).withColumn("no", F.monotonically_increasing_id()))  # numbers are fixed once written
    rare = read.select("no", F.inline("rare"))
    vectors = written(backed_off(rare.select("key").distinct(), model))
    more = rare.join(vectors, "key").groupBy("no").agg(F.array(*[F.sum(F.col("n") * F.get("vec", F.lit(i))) for i in range(width)]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("own")).otherwise(F.zip_with("own", "more", lambda x, y: x + y))
    out = read.drop("rare").join(more, "no", "left").select("carried", total.alias("total")).withColumn("best", F.array_max("total"))
    share = 1 / F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x)
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", F.col("best")).cast("int"))
    known = F.col("total").isNotNull()
    return out.select("carried.*", F.when(known, lang).otherwise("und").alias(pred), F.when(known, share).otherwise(0.0).alias(score))


def op3_language_backoff(spark, sf_dir) -> DataFrame:
    """One row per document: the language its words speak for."""
    from tallyspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~held))
    out = identified(docs, model, keep=("doc_id",))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
