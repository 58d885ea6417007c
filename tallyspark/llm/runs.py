"""Periodic runs of words by an enhanced suffix array: branching squares of the LCP intervals, rotated and merged into runs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, split_words

#: A run has this exponent (length / period) and this many words at least.
EXPONENT, LENGTH = 4, 6
#: Words whose suffixes are sorted together: documents share an array until it has so many. A longer document has one of its own.
CHUNK = 1 << 16
#: Suffixes of smaller children that are tested at once.
TESTED = 1 << 20
#: Rounds of pointer jumping before the rest of the bounds is found one by one.
JUMPS = 48


def suffix_ranks(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks of all suffixes by their first 1, 2, 4, ... tokens, until they are all different.

    Prefix doubling; suffixes that are told apart already are not sorted again.
    """
    n = len(tokens)
    order = np.argsort(tokens).astype(np.int64)
    rank = np.empty(n, np.int32)

    def number(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers the suffixes at these places of ``order`` by sorted keys; returns the places that are still tied."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.r_[firsts, len(keys)])
        rank[order[at]] = np.repeat(at[firsts], sizes)
        return at[np.repeat(sizes > 1, sizes)]

    tied = number(np.arange(n), tokens[order])
    levels, h = [rank.copy()], 1
    while len(tied):
        s = order[tied]
        after = np.where(s + h < n, rank[np.minimum(s + h, n - 1)], -1)
        keys = rank[s].astype(np.int64) * (n + 1) + after + 1
        by = np.argsort(keys)
        order[tied] = s[by]
        tied = number(tied, keys[by])
        levels.append(rank.copy())
        h *= 2
    return order, levels


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes a and b (pairs of different ones)."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + out, b + out
        same = (x < n) & (y < n)
        same &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        out += same.astype(np.int64) << k
    return out


def nearest_smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place of ``at`` the nearest one, to the left (step -1) or right (1), with a smaller value; both ends of ``lcp`` hold -1."""
    to = np.arange(len(lcp)) + step
    open_ = at
    for _ in range(JUMPS):
        open_ = open_[lcp[to[open_]] >= lcp[open_]]
        if not len(open_):
            return to[at]
        to[open_] = to[to[open_]]
    # staircases, as in one word repeated for long: each jump takes one step only
    values, stack = lcp.tolist(), []
    for k in range(len(values)) if step < 0 else range(len(values) - 1, -1, -1):
        while stack and values[stack[-1]] >= values[k] >= 0:
            stack.pop()
        if stack:
            to[k] = stack[-1]
        stack.append(k)
    return to[at]


def branching_squares(order: np.ndarray, levels: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of squares that the next token does not continue, some of them twice.

    An LCP interval of depth d holds the suffixes with one common prefix of d tokens, its children those that go on alike. Two
    suffixes d apart in different children are such a square. Of each interval all children but a largest one are
    walked, and each suffix looks d ahead and d back: the inverse array tells whether that suffix is in the interval.
    """
    n, inverse = len(order), levels[-1]
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = 0
    alike = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    if not len(alike):
        return
    lcp[alike + 1] = common(levels, order[alike], order[alike + 1])
    cut = alike + 1
    left, right = nearest_smaller(lcp, cut, -1), nearest_smaller(lcp, cut, 1)
    # cuts of one interval, from left to right
    key = left * (int(lcp.max()) + 1) + lcp[cut]
    by = np.argsort(key, kind="stable")
    cut, left, right, key = cut[by], left[by], right[by], key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cut)]))
    # an interval of m cuts has m + 1 children
    start = np.empty(len(cut) + len(first), np.int64)
    start[np.arange(len(cut)) + number + 1] = cut
    heads = first + np.arange(len(first))
    start[heads] = left[first]
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[heads, len(start)]))
    stop = np.r_[start[1:], 0]
    stop[np.r_[heads[1:], len(start)] - 1] = right[first]
    size = stop - start
    largest = np.flatnonzero(size == np.maximum.reduceat(size, heads)[of])
    small = np.ones(len(start), bool)
    small[largest[np.r_[True, of[largest[1:]] != of[largest[:-1]]]]] = False
    child = np.flatnonzero(small)
    part = np.cumsum(size[child]) // TESTED
    for c in np.split(child, np.flatnonzero(np.diff(part)) + 1):
        total = size[c]
        rank = np.repeat(start[c] - np.cumsum(total) + total, total) + np.arange(total.sum())
        c = np.repeat(c, total)
        low, high = left[first[of[c]]], right[first[of[c]]]
        depth, here = lcp[cut[first[of[c]]]], order[rank]
        for there, begin in ((here + depth, here), (here - depth, here - depth)):
            r = inverse[np.clip(there, 0, n - 1)]
            hit = (there >= 0) & (there < n) & (r >= low) & (r < high) & ((r < start[c]) | (r >= stop[c]))
            yield begin[hit], depth[hit]


def runs_of(tokens: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> np.ndarray:
    """(start, length, period) of every run in tokens; no token may occur in two documents (``doc``, not falling), so no run spans two."""
    none = np.zeros((0, 3), np.int64)
    if not len(tokens):
        return none
    order, levels = suffix_ranks(tokens)
    opening = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    found = []
    for begin, period in branching_squares(order, levels):
        # the square is the last of its run: is the run long enough?
        end = begin + 2 * period
        least = np.maximum(exponent * period, length)
        begin = end - least
        ok = begin >= opening[np.searchsorted(opening, end - 1, side="right") - 1]
        begin, period, end = begin[ok], period[ok], end[ok]
        ok = common(levels, begin, begin + period) >= end - period - begin
        found.append(np.stack([begin[ok], end[ok], period[ok]], 1))
    found = np.unique(np.concatenate(found or [none]), axis=0)
    if not len(found):
        return none
    # rotate to the left as far as the period holds: halving the words in question
    high, end, period = found.T
    low = opening[np.searchsorted(opening, end - 1, side="right") - 1]
    while (low < high).any():
        middle = (low + high) // 2
        holds = common(levels, middle, middle + period) >= end - period - middle
        low, high = np.where(holds | (low == high), low, middle + 1), np.where(holds, middle, high)
    # multiples of a period have the same words: the smallest stays
    by = np.lexsort((period, end, high))
    high, end, period = high[by], end[by], period[by]
    new = np.r_[True, (high[1:] != high[:-1]) | (end[1:] != end[:-1])]
    return np.stack([high, end - high, period], 1)[new]


def repeat_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: in one document of ten the words from some place on repeat the first ones after it."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, kept binary"


def periodic_runs(docs: DataFrame, rewrite: Callable | None = None, exponent: int = EXPONENT, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, kept) of every row: its runs by start, then period, the one of greatest exponent (of equal ones
    the first), and the words left when each run keeps its first period only, joined by one space.

    A run is a stretch of words with smallest period q and at least ``length`` and ``exponent`` x q words that no neighbour
    continues. ``rewrite(doc_id, words)`` may change the words first. Rows are worked on one by one where they lie: nothing is
    shuffled, and repeated rows and ids each give their row. Null and empty texts have no words and no runs, and keep an empty
    text; ``best`` is null without runs. A very long text is sorted alone; memory is some 200 bytes a word. Other columns are not
    read; an empty table gives no rows.
    """

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        sizes = np.array([len(w) for w in texts], np.int64)
        words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        found = runs_of(doc * (len(known) + 1) + words, doc, exponent, length)
        offsets = np.r_[0, np.cumsum(sizes)]
        bounds = np.searchsorted(found[:, 0], offsets)
        runs, best, kept = [], [], []
        for k, t in enumerate(texts):
            own = [(s - int(offsets[k]), n, q) for s, n, q in found[bounds[k] : bounds[k + 1]].tolist()]
            own.sort(key=lambda r: (r[0], r[2]))
            if own:
                change = [0] * (len(t) + 1)
                for s, n, q in own:
                    change[s + q] += 1
                    change[s + n] -= 1
                t = [w for w, inside in zip(t, accumulate(change), strict=False) if not inside]
            top = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            names = ("start", "length", "period")
            runs.append([dict(zip(names, r, strict=True)) for r in own])
            best.append(dict(zip(names, top, strict=True)) if top else None)
            kept.append(b" ".join(t))
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "best", "kept"])

    id_type = pa.int64() if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
    kind = "long" if id_type == pa.int64() else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in slices(batches, "_data"):
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("_data").to_pylist(), strict=True):
                words = split_words(data)
                words = rewrite(doc_id, words) if rewrite else words
                if texts and size + len(words) > CHUNK:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
        if texts:
            yield flush(ids, texts)

    rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("_data"))
    return rows.mapInArrow(run, f"doc_id {kind}, {_OUT}").withColumn("kept", F.col("kept").cast("string"))


def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    """One row per document: how many runs it has, the one of greatest exponent, and digests of all runs and of the words left."""
    from tallyspark.llm.common import table

    out = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    milli = F.expr("(best.length * 1000L) div best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        milli.cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
