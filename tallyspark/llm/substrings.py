"""Removal of passages that repeat across documents, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import slices, split_words, written

#: Words in a window of the contract.
WINDOW = 13
#: The first level has runs of so many words at most.
SHORTEST = 7
#: A null doc_id counts as this one, the largest.
LAST = 2**63 - 1
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """The levels, each at most twice as long as the one before: 7, 13 for 13 words, 7, 13, 25, 50 for 50."""
    out = [(window + 1) // 2, window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def spans(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span first..last of x, equal for equal spans wherever they stand; two passes over x, however long the spans."""
    up, down = _power(len(x))
    term = x * up
    total = np.cumsum(term)
    out = (total[last] - total[first] + term[first]) * down[first]
    out ^= out >> np.uint64(32)
    out *= np.uint64(_BASE)
    return out ^ out >> np.uint64(29)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after another in ``data`` (uint8): the hashes of all words, and how many each text has."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = starts < ends
    first[starts[full]] = word[starts[full]]
    last[ends[full] - 1] = word[ends[full] - 1]
    at, to = np.flatnonzero(first), np.flatnonzero(last)
    counts = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    return (spans(data.astype(np.uint64) + np.uint64(1), at, to) if len(at) else np.zeros(0, np.uint64)), counts


def minima(h: np.ndarray, n: int, use: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash (all of equal ones) of every n neighbours that begin at a position in ``use`` (a mask)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, wide = h.copy(), 1
    while wide < n:  # least[i] is the minimum of h[i : i + wide]
        step = min(wide, n - wide)
        least = np.minimum(least[: len(least) - step], least[step:])
        wide += step
    picked = np.zeros(len(h), bool)
    for k in range(n):
        picked[k : k + m] |= (h[k : k + m] == least[:m]) & use[:m]
    return np.flatnonzero(picked)


def anchors(texts: pa.Array, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of runs of words such that every window holds one wherever it stands: of its
    ``window - run + 1`` runs the one with the smallest hash."""
    cut = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if cut[-1] == cut[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[cut[0] : cut[-1]]
    h, counts = word_hashes(data, cut[:-1] - cut[0], cut[1:] - cut[0])
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - (np.cumsum(counts) - counts)[text]
    runs = spans(h, np.arange(len(h) - run + 1), np.arange(run - 1, len(h))) if len(h) >= run else h[:0]
    at = minima(runs, window - run + 1, place + window <= counts[text])
    return runs[at], text[at], place[at]


def window_digests(words: list[bytes], at: np.ndarray, n: int) -> np.ndarray:
    """XXH3's 128 bits of the n words from each position on, joined by one space: (positions, 2) longs."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    joined = memoryview(b" ".join(words))
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip((end - size)[at].tolist(), end[at + n - 1].tolist(), strict=True)]), "<i8").reshape(-1, 2)


#: The positions of a run (h1, h2) in a row, or those of a row that a batch could tell alone (``done``).
_RUNS = "h1 long, h2 long, id long, row long, pos binary, done boolean"


def _changes(*of: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    return np.r_[True, np.any([x[1:] != x[:-1] for x in of], 0)] if len(of[0]) else np.zeros(0, bool)


def _pieces(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """x[start : start + n] for each start, as binary."""
    ends = np.cumsum(n)
    flat = x[np.repeat(start - (ends - n), n) + np.arange(n.sum())].astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int32)), pa.py_buffer(flat)])


def sifted(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, rows: np.ndarray, pos: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
    """The runs of a batch of texts that others have to be compared with, and the positions that the batch decides by itself.

    A run that several documents of the batch have is found again, at the final level for all but the smallest of them. Of such
    runs one row goes on for the sake of other batches (at the final level that of the smallest document), so that a run that very many
    documents have is not one row for each.
    """
    order = np.lexsort((pos, rows, ids, h2, h1))
    h1, h2, ids, rows, pos = (x[order] for x in (h1, h2, ids, rows, pos))
    own = _changes(h1, h2, ids, rows, pos)  # equal rows of one id come once
    h1, h2, ids, rows, pos = (x[own] for x in (h1, h2, ids, rows, pos))
    if not len(h1):
        return
    start = np.flatnonzero(_changes(h1, h2, ids, rows))
    n = np.diff(np.r_[start, len(h1)])
    new = _changes(h1[start], h2[start])
    key, first, doc = np.cumsum(new) - 1, np.flatnonzero(new), ids[start]
    least = doc[first][key]
    several = (np.maximum.reduceat(doc, first) != doc[first])[key]
    decided = several & (doc != least) if final else several
    send = np.flatnonzero(doc == least if final else ~several | new)
    at = start[send]
    near = np.lexsort((pos[at], rows[at], ids[at]))  # runs of a text lie together, which compresses better
    at, m = at[near], n[send][near]
    names = ["h1", "h2", "id", "row", "pos", "done"]
    yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(ids[at]), pa.array(rows[at]), _pieces(pos, at, m), pa.array(np.zeros(len(at), bool))], names)
    mine = np.repeat(decided, n)
    ids, rows, pos = ids[mine], rows[mine], pos[mine]
    if len(ids):
        order = np.lexsort((pos, rows, ids))
        ids, rows, pos = ids[order], rows[order], pos[order]
        at = np.flatnonzero(_changes(ids, rows))
        m = np.diff(np.r_[at, len(ids)])
        yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(ids[at]), pa.array(rows[at]), _pieces(pos, at, m), pa.array(np.ones(len(at), bool))], names)


def _found(runs: DataFrame, final: bool) -> DataFrame:
    """(id, row, found): the positions of runs that another document has too, a smaller one at the final level."""
    same, own = Window.partitionBy("h1", "h2"), F.when(~F.col("done"), F.col("id"))
    seen = runs.withColumns({"least": F.min(own).over(same), "most": F.max(own).over(same)})
    again = F.col("id") > F.col("least") if final else F.col("least") < F.col("most")
    return seen.where(F.col("done") | again).groupBy("id", "row").agg(F.collect_list("pos").alias("found"))


def _positions(blobs: pa.Scalar) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs.as_py()), "<i4")).astype(np.int64)


def _first_runs(docs: DataFrame, window: int, run: int) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", 8 << 20):
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            parts, at = [], 0
            for part in slices(iter([b]), "data", 1 << 20):
                h, text, pos = anchors(part.column("data"), window, run)
                parts.append((h, text + at, pos))
                at += part.num_rows
            h, text, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from sifted(h.view(np.int64), np.zeros(len(h), np.int64), ids[text], rows[text], pos, False)

    return docs.select("id", "row", "data").mapInArrow(go, _RUNS)


def _next_runs(docs: DataFrame, found: DataFrame, short: int, n: int, final: bool) -> DataFrame:
    """Runs of n words that hold a run of ``short`` words found before."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", 8 << 20):
            hashes, ids, rows, places = [], [], [], []
            for data, blobs, i, row in zip(*(b.column(c) for c in ("data", "found", "id", "row")), strict=True):
                words = split_words(data.as_buffer().to_pybytes())
                at, m = _positions(blobs), len(words) - n + 1
                mark = np.zeros(max(m, 0) + 1, np.int32)
                np.add.at(mark, np.clip(at - (n - short), 0, max(m, 0)), 1)
                np.add.at(mark, np.clip(at + 1, 0, max(m, 0)), -1)
                p = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                if len(p):
                    hashes.append(window_digests(words, p, n))
                    ids.append(np.full(len(p), i.as_py(), np.int64))
                    rows.append(np.full(len(p), row.as_py(), np.int64))
                    places.append(p)
            if hashes:
                h = np.concatenate(hashes)
                yield from sifted(h[:, 0], h[:, 1], *map(np.concatenate, (ids, rows, places)), final)

    return docs.join(found, ["id", "row"]).select(*docs.columns, "found").mapInArrow(go, _RUNS)


def repeated_windows(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(id, row, found, whole): of each row of ``docs`` (id, row, row2, data, others) the start positions of windows that also start in a row
    with a smaller id, or ``whole`` for a text that a smaller id has word for word.

    ``row`` and ``row2`` are two hashes of the text. The first level takes short runs of words, of each window the one with the
    smallest hash. Of equal texts that with the smallest id goes on alone. Runs that two documents share are extended to twice
    their length, and so on until the window's length is reached or none survives. From the second level on, runs are equal if the 128 bits
    of XXH3 of their words are; the first level's 64 bits only choose candidates.
    The levels take all columns of ``docs``: a later join of the same rows on id and row finds them shuffled already.
    """
    levels = lengths(window, shortest)
    found = written(_found(_first_runs(docs, window, levels[0]), False))
    # a text's hash that stands for two texts (of very many) is left out: its rows take part one by one
    copies = docs.groupBy("row").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("row2").alias("x"), F.max("row2").alias("y"))
    copies, docs = written(copies.where("least < most and x = y").select("row", "least")), docs.drop("row2")
    found = written(found.join(copies, "row", "left").withColumn("whole", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("least"))
    whole = found.where("whole").select("id", "row", F.array().cast("array<binary>").alias("found"), "whole")
    found = found.where("not whole").drop("whole")
    for short, n in zip(levels, levels[1:], strict=False):
        if found.isEmpty():
            break
        found = _found(_next_runs(docs, found, short, n, n == window), n == window)
        if n < window:
            found = written(found)
    return found.withColumn("whole", F.lit(False)).unionByName(whole)


def cover(n: int, positions: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at these positions cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, positions, 1)
    np.add.at(step, np.minimum(positions + window, n), -1)
    return np.cumsum(step)[:n] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carried): of each whole text the words that no window of an earlier document covers.

    ``kept`` joins them by one space (binary, UTF-8). Null and empty texts have no words, an empty table gives no rows, a text
    of any length is one row. Rows that repeat a doc_id are the same document and never remove each other's words, whatever their
    texts; each loses its own. A null doc_id counts as 2**63 - 1, the largest. ``carried`` is a struct of the columns in
    ``carry``, whatever their names; other columns are not read.
    """
    extra = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    doc_id = F.col("doc_id").cast("long")
    hashes = [F.xxhash64(data).alias("row"), F.xxhash64(F.lit(7), data).alias("row2")]
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("id"), *hashes, data.alias("data"), extra.alias("carried"))
    found = repeated_windows(rows, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", 8 << 20):
            n_words, n_removed, kept = [], [], []
            for data, blobs, whole in zip(*(b.column(c) for c in ("data", "found", "whole")), strict=True):
                stay = words = split_words(data.as_buffer().to_pybytes())
                if whole.as_py():
                    stay = []
                elif blobs.is_valid:
                    gone = cover(len(words), _positions(blobs), window)
                    stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            columns = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), b.column("carried")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "carried"])

    joined = rows.drop("row2").join(found, ["id", "row"], "left").select("doc_id", "data", "carried", "found", "whole")
    kinds = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept binary").add("carried", rows.schema["carried"].dataType)
    return joined.mapInArrow(run, kinds)


def op10_substring_doubling(spark, sf_dir) -> DataFrame:
    """One row per document: its words, how many go, and the digest of the rest."""
    from tallyspark.llm.common import table

    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS first_id FROM g GROUP BY k),
gone AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS j FROM g JOIN m USING (k) WHERE m.first_id < g.doc_id),
n AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""
