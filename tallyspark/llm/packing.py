"""Packing tokenized documents into sequences of fixed length: pairs of large items first, best fit for the rest."""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, unbroadcast, written

CAPACITY = 2048
#: Rows of one length are numbered in so many separate groups.
GROUPS = 1024
#: A space between two other characters; the class holds all white space that the tokenizer's pattern knows.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUNS = "(?: [{0}]|[{0}] )".format(r"\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
#: Places inside a piece over which nothing merges: a letter before punctuation or a new line, and behind a lone new line.
_PARTS = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[.,;:!?\n])|(?<=\S\n)(?=\S)")


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts to token ids. Byte-level BPE never merges over a single space between two other
    characters, so texts are cut there and each piece is encoded once as long as it is remembered."""

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember, self.young, self.old = remember, {}, {}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Two generations of pieces are kept, so what is in use stays."""
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new, cut = [], {}
        for p in pieces:
            if p in young:
                continue
            if (ids := old.get(p)) is not None:
                young[p] = ids
            elif p[1:].isalnum() or len(parts := _PARTS.split(p)) == 1:  # letters and digits alone have no place to cut
                new.append(p)
            else:
                cut[p] = parts
                new += [q for q in parts if q not in young]
        new = list(dict.fromkeys(new))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            young.update(zip(part, [_bytes(x.ids) for x in found], strict=True))
        for p, parts in cut.items():
            young[p] = b"".join([young[q] for q in parts])
        return [young[p] for p in pieces]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more than there are texts)."""
        whole = pa.array(np.zeros(len(texts), bool))
        for token in self.special:  # the tokenizer cuts them out before all else
            whole = pc.or_(whole, pc.match_substring(texts, token))
        if not whole.true_count:
            return self._plain(texts)
        ids, at = self._plain(pc.if_else(whole, "", texts))
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        runs = pc.match_substring_regex(texts, _RUNS)
        if runs.true_count:
            others = pa.array([_CUT.split(t) for t in texts.filter(runs).to_pylist()], cut.type)
            order = np.argsort(np.r_[np.flatnonzero(~np.asarray(runs)), np.flatnonzero(runs)])
            cut = pa.concat_arrays([cut.filter(pc.invert(runs)), others]).take(pa.array(order))
        words = cut.flatten().dictionary_encode()
        firsts = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())][:-1]
        # A piece has its space before it, but for the first one of a text.
        codes = words.indices.to_numpy().astype(np.int64)
        first_codes, at = np.unique(codes[firsts], return_inverse=True)
        codes[firsts] = len(words.dictionary) + at
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = self._pieces([" " + w for w in known] + [known[c] for c in first_codes])
        ends = np.cumsum([len(x) // 4 for x in pieces])
        table = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), np.frombuffer(b"".join(pieces), "<u4"))
        ids = table.take(pa.array(codes))
        counts = np.add.reduceat(pc.list_value_length(ids).to_numpy(), firsts, dtype=np.int64)
        return ids.flatten().to_numpy(), np.r_[0, np.cumsum(counts)]


#: Pieces that a worker remembers, twice as many at most (about 200 bytes each, kept between tasks).
REMEMBER = 400_000


@cache
def encoder(path: str, remember: int = REMEMBER) -> Encoder:
    return Encoder(path, remember)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``; only longer ones are cut, the first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, remember), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "data", 8 << 20):
            out: list[tuple] = []
            ids, at = encode(b.column("data"))
            for doc, begin, till in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[begin:till].tobytes() + end
                n = len(own) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                out += [(doc, k, a, z - a, zlib.crc32(own[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("data"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, n, first bin, offset): the items of a length with ranks from ``first rank`` go to n bins in a row.

    Works on how many items each length has, so its cost depends on the capacity and not on the number of
    items. Items above a third of the capacity pair greedily: the largest left takes the largest that fits beside
    it, at most two a bin. Smaller ones, largest first, go to the tightest gap that holds them, or open a bin.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first bin, bins)]
    sizes: list[int] = []  # the gaps that there are, sorted
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        if b == a and left[a] == 1:
            b = large[k - 1] if k else 0
        n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
        put(a, n, bins, 0)
        if b:
            put(b, n, bins, a)
        leave(capacity - a - b, bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                gap, first, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            each = gap // s
            full = min(n, left[s] // each)
            for i in range(each if full else 0):
                put(s, full, first, capacity - gap + i * s)
            leave(gap - each * s, first, full)
            n, first = n - full, first + full
            if n and left[s]:
                more = left[s]
                for i in range(more):
                    put(s, 1, first, capacity - gap + i * s)
                leave(gap - more * s, first, 1)
                n, first = n - 1, first + 1
            leave(gap, first, n)
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only how many pieces each length has reaches the driver: ``capacity`` rows at most. Its plan goes back to
    the workers and is bounded by the capacity as well. Within a length, pieces are numbered in GROUPS groups by a hash,
    so no task numbers more than that share of a length. Repeated rows are packed one by one.
    """
    names = pieces.columns
    rows = written(pieces.withColumn("_g", F.pmod(F.xxhash64(*names), F.lit(GROUPS)).cast("int")))
    groups = rows.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    lengths, first, _, bins, offsets = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 5))
    starts = lengths << 44 | first
    before = groups.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).drop("_n")
    in_group = F.row_number().over(Window.partitionBy("length", "_g").orderBy(*names))
    ranked = rows.join(unbroadcast(before), ["length", "_g"]).select(*names, (F.col("_before") + in_group - 1).alias("_rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rank.to_numpy() - first[at], "offset": offsets[at]})

    return ranked.withColumn("_p", place("length", "_rank")).select(*names, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """One row per piece of every document: where its ids are and where they go. Null texts count as empty; each
    row of ``docs`` is packed, also if it repeats another; an empty table gives no rows; other columns are not read. ``remember`` trades a worker's memory
    for its time, the rows are the same."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return packed(token_pieces(docs, str(path), capacity, text=text, remember=remember), capacity)


def op8_best_fit_packing(spark, sf_dir) -> DataFrame:
    """One row per piece of every document."""
    from tallyspark.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
