"""SimHash near-duplicate groups by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, split_words, unbroadcast, written
from tallyspark.llm.components import connected_components

#: Bits of the three fingerprint segments, lowest first; each fits the 23-bit code.
SEGMENTS = (22, 21, 21)
MAX_BITS = 3


def shingle_hashes(data: bytes | None, n_words: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``n_words`` lower-cased words, repeats included; the whole text if it has fewer words."""
    words = split_words(data.lower() if data else None)
    if not words:
        return []
    if len(words) < n_words:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    runs = zip(*(words[i:] for i in range(n_words)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)))


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that are set in over half of it; zero for empty runs."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(counts)
    at, n = starts[full], counts[full]
    for bit in range(64) if len(full) else ():
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), at, dtype=np.int64)
        out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, n_words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            rows = [shingle_hashes(x, n_words) for x in b.column("data").to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((h for r in rows for h in r), np.uint64, int(counts.sum()))
            fp = majority(flat, np.cumsum(counts) - counts, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words (as two half tables), the error pattern of weight <= 3 of each
    syndrome, and the five patterns of weight 4 of each syndrome whose own pattern has weight 3.

    The binary (23, 12) Golay code is perfect: each word lies within 3 bits of exactly one codeword.
    """
    generator = 0xC75

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= generator << (i - 11)
        return x

    halves = np.array([[rest(x) for x in range(4096)], [rest(x << 12) for x in range(2048)] + [0] * 2048], np.int64)
    near, far = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64)
    found = np.zeros(2048, int)
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            s = int(halves[0, e & 4095] ^ halves[1, e >> 12])
            if weight < 4:
                near[s] = e
            else:
                far[s, found[s]] = e
                found[s] += 1
    return halves, near, far


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words: first that of the nearest codeword, then those four bits away, -1 where there are none.

    If two words differ in one bit at most, the nearest codeword of either is in the row of the other.
    """
    halves, near, far = golay()
    s = halves[0, words & 4095] ^ halves[1, words >> 12]
    more = far[s]
    return np.concatenate([((words ^ near[s]) >> 11)[:, None], np.where(more < 0, -1, (words[:, None] ^ more) >> 11)], 1)


def keys(fp: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs under which two fingerprints that differ in 3 bits at most meet, one on side 0 and the other on side 1.

    Three errors over three segments leave either one segment whole and a second one with at most one
    error, or one error in each. The first case meets in 'segment i, codeword of segment j', where side 0
    gives its nearest codeword and side 1 all near ones; the second meets in the three codewords, where side 0
    varies the middle one and side 1 the others.
    """
    u = fp.view(np.uint64)
    parts, shift = [], 0
    for bits in SEGMENTS:
        parts.append(((u >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    codes = [codewords(p) for p in parts]
    rows, out = [], []

    def emit(family: int, whole: np.ndarray, *picks: np.ndarray) -> None:
        key, ok = whole[:, None], np.ones((len(fp), 1), bool)
        for p in picks:
            key = (key[:, :, None] << 12 | np.maximum(p, 0)[:, None, :]).reshape(len(fp), -1)
            ok = (ok[:, :, None] & (p >= 0)[:, None, :]).reshape(len(fp), -1)
        r, c = np.nonzero(ok)
        rows.append(r)
        out.append(key[r, c] | family << 40)

    for i in range(3):
        for j in range(3):
            if i != j:
                emit(3 * i + j, parts[i], codes[j][:, :1] if side == 0 else codes[j])
    one = [c[:, :1] for c in codes]
    emit(9, np.zeros(len(fp), np.int64), *([one[0], codes[1], one[2]] if side == 0 else [codes[0], one[1], codes[2]]))
    return np.concatenate(rows), np.concatenate(out)


def links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints that differ in at most three bits (repeats possible)."""

    def side(which: int, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                    row, key = keys(fp, which)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", name])

        return fps.select(F.col(column)).mapInArrow(run, f"key long, {name} long")

    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    x, y = side(0, "a"), side(1, "b")
    return x.join(unbroadcast(y), (x["key"] == y["key"]) & close).select("a", "b")


def near_duplicates(docs: DataFrame, n_words: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Equal fingerprints are merged first, so that groups of copies, however large, are one node. Null and
    empty texts have fingerprint zero and are linked like any other; rows that repeat a doc_id each get a
    row; a null doc_id never names a component that has other ids. Other columns are not read.
    """
    rows = written(fingerprints(docs, n_words, text))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(nodes))
    nodes = nodes.join(unbroadcast(roots), nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    groups = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(unbroadcast(groups), "root").select("fp", "component_id")
    return rows.join(unbroadcast(named), "fp", "left").select("doc_id", "fp", "component_id")


def op5_simhash_golay(spark, sf_dir) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id of its group."""
    from tallyspark.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", hexed, "component_id")
