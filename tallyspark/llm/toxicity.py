"""Toxicity scores by a counterfactually regularised word classifier."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import fold, free_name, slices, written

_WORDS = re.compile(r"[^\W_]+")
_SENTENCES = re.compile(r"[.!?\n]+")

#: Terms that name people, by kind; terms of a kind can stand for each other in a sentence. A parameter.
IDENTITY_TERMS = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("female", "male", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)
PREFIXES = (4, 5, 6)
#: Weight of the squared change of the score under a swap, beside a log loss of 0.69 at the start.
FAIRNESS = 4.0


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """32-bit hashes of a word and its longer beginnings, so that an ending that was not seen changes little."""
    return [zlib.crc32(f.encode()) for f in (word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n])]


def hashed(words: Iterable[str]) -> list[int]:
    """The features of some words, each as often as it is in them."""
    return [f for w in words for f in features(w)]


def packed(words: Iterable[str]) -> bytes:
    return np.array(hashed(words), np.uint32).tobytes()


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """Chance of label 1; a text without words gets the bias alone."""
        known, z = self._known, self.bias
        if len(known) > 300_000:
            known.clear()
        for w in words_of(text):
            x = known.get(w)
            if x is None:
                x = known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            z += x
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.bias, self.weights, self._known = *state, {}


def swapped_sentences(text: str | None, kinds=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """(words, words with one term swapped): each sentence of a text that has an identity term, with each other term of its kind in its place."""
    out = []
    for sentence in _SENTENCES.split(text or ""):
        words = words_of(sentence)
        out += [(words, words - {t} | {o}) for kind in kinds for t in kind if t in words for o in kind if o not in words]
    return out


class Rows:
    """Sparse rows of feature counts; features that are not in the sorted ``names`` are left out. Built some rows at a time, as most features are."""

    def __init__(self, rows: Sequence[Sequence[int]], names: np.ndarray):
        self.n, self.m = len(rows), len(names)
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
        for a in range(0, self.n if self.m else 0, 256):
            own = [np.asarray(r, np.uint32) for r in rows[a : a + 256]]
            flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own])
            col = np.minimum(np.searchsorted(names, flat), self.m - 1)
            known = names[col] == flat
            at, val = np.unique(row[known] * self.m + col[known], return_counts=True)
            parts.append(((at // self.m + a).astype(np.int32), (at % self.m).astype(np.int32), val.astype(np.float32)))
        self.row, self.col, self.val = map(np.concatenate, zip(*parts, strict=True))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * e[self.row], self.m)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Objective:
    """Log loss, either label weighing one half, and ``fairness`` times the mean squared change of the score between a sentence and its swapped form."""

    def __init__(self, x: Rows, y: np.ndarray, before: Rows, after: Rows, fairness: float):
        self.x, self.y, self.before, self.after, self.fairness = x, y, before, after, fairness if before.n else 0.0
        self.share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def value(self, w: np.ndarray, bias: float) -> float:
        z = self.x.times(w) + bias
        loss = float((self.share * (np.logaddexp(0, z) - self.y * z)).sum())
        if self.fairness:
            d = _sigmoid(self.before.times(w) + bias) - _sigmoid(self.after.times(w) + bias)
            loss += self.fairness * float(np.mean(d * d))
        return loss

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        e = self.share * (_sigmoid(self.x.times(w) + bias) - self.y)
        g, gb = self.x.back(e), float(e.sum())
        if self.fairness:
            a, b = _sigmoid(self.before.times(w) + bias), _sigmoid(self.after.times(w) + bias)
            d = self.fairness * 2 / len(a) * (a - b)
            u, v = d * a * (1 - a), d * b * (1 - b)
            g, gb = g + self.before.back(u) - self.after.back(v), gb + float((u - v).sum())
        return g, gb

    def curvature(self, steps: int = 20) -> float:
        """A bound of the largest curvature, by power iteration. The slope of the logistic curve is 1/4 at most and its second
        derivative under 0.0963, so a squared difference of two scores curves by 4 / 16 + 2 * 0.0963 < 0.45 of its two rows."""
        v, top = np.ones(self.x.m) / max(self.x.m, 1) ** 0.5, 1.0
        for _ in range(steps):
            u = 0.25 * self.x.back(self.share * self.x.times(v))
            if self.fairness:
                u += 0.45 * self.fairness / self.before.n * (self.before.back(self.before.times(v)) + self.after.back(self.after.times(v)))
            top = max(float(np.linalg.norm(u)), 1e-12)
            v = u / top
        return 1.5 * top + 0.25 + 0.9 * self.fairness


def train(rows: Sequence[Sequence[int]], labels: Sequence[int], pairs: Sequence[tuple[Sequence[int], Sequence[int]]] = (), l1: float = 0.0003, fairness: float = FAIRNESS, min_docs: int = 3, max_share: float = 0.05, steps: int = 300) -> Model:
    """The ``Objective`` and ``l1`` times the absolute weights, by accelerated proximal gradient.

    ``rows`` are the features of labelled texts, ``pairs`` those of labelled sentences before and after a swap. Features in fewer than
    ``min_docs`` texts, or in more than ``max_share`` of either label's texts, tell little and are left out. With one label only, the
    score is that label's share.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        base = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(math.log(base / (1 - base)), {})
    seen = []
    for k in (0, 1):
        own = [np.unique(np.asarray(r, np.uint32)) for r, label in zip(rows, y, strict=True) if label == k]
        seen.append(np.unique(np.concatenate(own), return_counts=True))
    names = np.union1d(seen[0][0], seen[1][0])
    docs = np.zeros((2, len(names)), np.int32)
    for k, (f, n) in enumerate(seen):
        docs[k, np.searchsorted(names, f)] = n
    few = [docs[k] <= max(max_share * (y == k).sum(), 1) for k in (0, 1)]
    names = names[(docs.sum(0) >= min_docs) & (few[0] | few[1])]
    del seen, docs
    goal = Objective(Rows(rows, names), y, Rows([a for a, _ in pairs], names), Rows([b for _, b in pairs], names), fairness)
    step = 1 / goal.curvature()
    w, bias, t = np.zeros(len(names)), 0.0, 1.0
    ahead, ahead_bias = w, bias
    for _ in range(steps):
        g, gb = goal.gradient(ahead, ahead_bias)
        moved = ahead - step * g
        new, new_bias = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), ahead_bias - step * gb
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (old - 1) / t * (new - w), new_bias + (old - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return Model(bias, {int(names[i]): float(w[i]) for i in np.flatnonzero(w)})


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows_per_class: int = 2000, sentences: int = 20_000, **options) -> Model:
    """Fits on the labelled rows of ``docs`` outside the held-out fold.

    ``rows_per_class`` (documented bound) rows of either label at most, those with the smallest hash of their id; both labels weigh the same.
    Of the swapped forms of their sentences ``sentences`` (documented bound too) at most are compared, those with the smallest hash. Rows without a label, a text or an id are not used; with an
    empty table the score is 0. Very long texts count whole. Only the hashed words of these rows and sentences reach the driver.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    h = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(h, "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)

    kinds, sides = options.pop("kinds", IDENTITY_TERMS), pa.struct([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            rows = [packed(words_of(t)) for t in texts]
            pairs = [[{"a": packed(a), "b": packed(b)} for a, b in swapped_sentences(t, kinds)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.binary()), pa.array(pairs, pa.list_(sides))], ["doc_id", "y", "row", "pairs"])

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, row binary, pairs array<struct<a:binary,b:binary>>"))
    got = found.select("doc_id", "y", "row").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    swapped = found.select("doc_id", F.inline("pairs")).orderBy(F.xxhash64("a", "b"), "doc_id").limit(sentences).toArrow()
    unpacked = lambda x: np.frombuffer(x.as_buffer(), np.uint32)
    pairs = [(unpacked(a), unpacked(b)) for a, b in zip(swapped["a"], swapped["b"], strict=True)]
    return train([unpacked(r) for r in got["row"]], got["y"].to_pylist(), pairs, **options)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with one more column, ``name``: the score (0 to 1) of every whole text; null and empty texts get the model's bias, repeated rows
    equal scores, an empty table none. A column of ``docs`` that has the name stays, and the new one gets a name with ``_`` at its end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        own = shared.value
        return texts.map(own.score, na_action=None)

    return docs.withColumn(free_name(docs.columns, name), score(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def op1_toxicity_counterfactual(spark, sf_dir) -> DataFrame:
    """One row per document: its score and label."""
    from tallyspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return out.select("doc_id", held, F.col("toxic_score").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
