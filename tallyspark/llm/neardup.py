"""Near-duplicate texts by Jaccard similarity of word shingles: SimHash fingerprints decoded by the Golay code, then MinHash bands for pairs further apart, give candidates; the exact similarity decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, free_name, hashable, lower_ascii, slices, unbroadcast, wide_hash, written
from tallyspark.llm.components import connected_components
from tallyspark.llm.simhash import links as golay_links
from tallyspark.llm.simhash import majority, shingle_hashes

#: The contract of stages without one of their own.
N_WORDS = 5
LEAST = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**PER_BAND)**BANDS: 0.9998 at 0.8.
BANDS, PER_BAND = 16, 4
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of up to this many texts give their pairs as rows; larger ones are compared in blocks of about so many shingles a side.
FEW, BLOCK = 32, 1 << 16
#: Pairs of nodes that are broadcast at once, some 100 bytes each in the driver.
SENT = 20_000
#: Another round of heads is worth its jobs while it leaves at most this share of the texts outside.
WORTH = 0.5


def node_of(text: Column) -> Column:
    """128 bits, equal for texts with the same lower-cased words; one value for all texts without words."""
    words = F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+", " ")
    return wide_hash(F.trim(words))


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(runs, BANDS): the band values of each run of shingle hashes; no run may be empty."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * PER_BAND if len(starts) else 0):
        x = (hashes ^ _XOR[k]) * _TIMES[k]
        x ^= x >> np.uint64(32)
        band = k // PER_BAND
        out[:, band] = (out[:, band] ^ np.minimum.reduceat(x * _MIX, starts)) * _MIX
        out[:, band] ^= out[:, band] >> np.uint64(29)
    return out


def _signed(rows: DataFrame, n_words: int) -> DataFrame:
    """(node, key, size, fp, bands) of rows (node, key, data): how many different shingles a text has, its SimHash fingerprint, and its band values (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            found = [shingle_hashes(x, n_words) for x in b.column("data").to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for r in found for h in r), np.uint64, int(n.sum()))
            full = n > 0
            values = bands(flat, (np.cumsum(n) - n)[full]).view(np.int64)
            ends = np.cumsum(np.where(full, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values.ravel()))
            size = pa.array([len(set(r)) for r in found], pa.int32())
            fp = pa.array(majority(flat, np.cumsum(n) - n, n).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("key"), size, fp, lists], ["node", "key", "size", "fp", "bands"])

    return rows.mapInArrow(run, "node binary, key binary, size int, fp long, bands array<long>")


def _close(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) among ``nodes`` (node, fp): each with the smallest node of its fingerprint, and the smallest nodes of fingerprints that differ in three bits at most."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    equal = nodes.join(unbroadcast(heads), "fp").where("node <> head").select(*_ordered(F.col("head"), F.col("node")))
    x, y = (heads.select(F.col("fp").alias(fp), F.col("head").alias(head)) for fp, head in (("a", "x"), ("b", "y")))
    near = golay_links(heads.select("fp")).distinct().join(unbroadcast(x), "a").join(unbroadcast(y), "b").select(*_ordered(F.col("x"), F.col("y")))
    return equal.unionByName(near)


def _sets(rows: DataFrame, n_words: int) -> DataFrame:
    """(node, grams): the sorted different shingle hashes of rows (node, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            grams = [np.unique(np.array(shingle_hashes(x, n_words), np.uint64)).tobytes() for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(grams, pa.binary())], ["node", "grams"])

    return rows.mapInArrow(run, "node binary, grams binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float, n: int | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity is ``least`` or more. Up to SENT of them (``n``, where it is known) go to the sets, else these are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if min(len(u), len(v)) < least * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= least * (len(u) + len(v) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    pairs = F.broadcast(pairs) if n is not None and n <= SENT else unbroadcast(pairs)
    return pairs.join(x, "a").join(unbroadcast(y), "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each of the sets ``xs`` has in common with each of ``ys``: products of 0-1 matrices, ``width`` values at a time."""
    flat = np.concatenate([*xs, *ys])
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in (*xs, *ys)])
    first = row < len(xs)
    both = np.intersect1d(flat[first], flat[~first])
    at = np.searchsorted(both, flat)
    known = at < len(both)
    known[known] = both[at[known]] == flat[known]
    out = np.zeros((len(xs), len(ys)), np.float32)
    order = np.argsort(at[known], kind="stable")
    at, row = at[known][order], row[known][order]
    for low in range(0, len(both), width):
        here = slice(*np.searchsorted(at, [low, low + width]))
        ones = np.zeros((len(xs) + len(ys), min(width, len(both) - low)), np.float32)
        ones[row[here], at[here] - low] = 1
        out += ones[: len(xs)] @ ones[len(xs) :].T
    return out


def joining(roots: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the links x[k] - y[k] it takes to join all components that the links join; ``roots`` holds the component of every row."""
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := above.get(r, r)) != r:
            above[r] = above.get(up, up)
            r = up
        return r

    kept = []
    _, firsts = np.unique(np.stack([roots[x], roots[y]]), axis=1, return_index=True)
    for k in firsts.tolist():
        r, s = top(int(roots[x[k]])), top(int(roots[y[k]]))
        if r != s:
            above[r] = s
            kept.append(k)
    return kept


def _alike_in_blocks(outside: DataFrame, members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the components of ``outside`` rows with those of ``members`` rows (bucket, node, size, root) of the
    same bucket as all their pairs of similarity ``least`` would. Either side is dealt by hash into blocks of about BLOCK
    shingles, so a task holds two blocks, and only links leave it, fewer than the blocks have rows."""

    def run(rows: pa.Table) -> pa.Table:
        node, number = rows.column("node").to_pylist(), {}
        root = np.array([number.setdefault(r, len(number)) for r in rows.column("root").to_pylist()], np.int64)
        out = rows.column("outside").to_numpy().astype(bool)
        x, y = np.flatnonzero(out), np.flatnonzero(~out)
        a, b = [], []
        if len(x) and len(y):
            grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in rows.column("grams")]
            n = np.array([len(g) for g in grams], np.float64)
            both = shared_counts([grams[i] for i in x], [grams[i] for i in y]).astype(np.float64)
            near = both >= least * (n[x][:, None] + n[y][None, :] - both) - 1e-9
            i, j = np.nonzero(near & (root[x][:, None] != root[y][None, :]))
            i, j = x[i], y[j]
            kept = joining(root, i, j)
            ends = [sorted((node[u], node[v])) for u, v in zip(i[kept].tolist(), j[kept].tolist(), strict=True)]
            a, b = [e[0] for e in ends], [e[1] for e in ends]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias(name))

    counts = blocks(outside, "n_i").join(blocks(members, "n_j"), "bucket")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = [
        rows.join(counts, "bucket").select("bucket", "node", "root", F.lit(first).alias("outside"), i.alias("i"), j.alias("j"))
        for rows, first, i, j in ((outside, True, of("n_i"), every("n_j")), (members, False, every("n_i"), of("n_j")))
    ]
    return dealt[0].unionByName(dealt[1]).join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _outside(members: DataFrame, turn: int) -> DataFrame:
    """The rows of ``members`` (bucket, node, size, root) that are not of their bucket's largest component, with a text of that: its head,
    another one each turn. Buckets of one component give none."""
    order = F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("turn"), F.col("node").alias("node"), F.col("root").alias("root"))
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    heads = parts.groupBy("bucket").agg(F.max(F.struct("n", "first")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    heads = heads.where("parts > 1").select("bucket", "n", F.col("most.first.node").alias("head"), F.col("most.first.root").alias("head_root"))
    return members.join(heads, "bucket").where("root <> head_root")


def one_per_group(docs: DataFrame, n_words: int = N_WORDS, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per group of near duplicates: that with the smallest id, rows without an id last.

    Rows with the same lower-cased words are one node (texts without words too); nodes of similarity ``least`` or more are
    linked, and groups are the connected components. Ids only choose the row that stays: rows that share one, or have none,
    are told apart by 128 bits of all their columns, and rows that are equal in all are one. Null and empty texts are texts without words; an empty table gives no
    rows. A very long text is one row wherever it goes. Columns may have any name and type.

    The nodes that SimHash finds close (``_close``) are compared first. Then each node of a band's bucket is compared with one node of the bucket's largest component, another in each band and round, as
    long as a round joins many. Then, in buckets that still hold several components, all pairs of different components are compared, those of
    large buckets in blocks inside tasks: no pair that shares a band and would join two components is left out, and the rows
    that leave a group of copies grow with its members, not with its pairs.
    """
    names = docs.columns
    own = free_name(names, "_key")
    keyed = docs.withColumn(own, wide_hash(*hashable(docs)))
    rows = keyed.select(node_of(F.col(f"`{text}`")).alias("node"), F.col(own).alias("key"), F.col(f"`{text}`").cast("binary").alias("data"))
    ids = keyed.select(F.col(own).alias("key"), F.col(f"`{doc_id}`").alias("id"), node_of(F.col(f"`{text}`")).alias("node"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = written(ids.groupBy("node").agg(F.min(rank).alias("first")))
    nodes = written(_signed(rows, n_words).groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    every = written(nodes.select("node", "size", F.posexplode("bands").alias("band", "value")).select("node", "size", F.xxhash64("band", "value").alias("bucket")))

    several = every.groupBy("bucket").count().where("count > 1").select("bucket")
    held = written(every.join(unbroadcast(several), "bucket", "left_semi"))
    close = written(_close(nodes.where("size > 0").select("node", "fp")))
    compared = held.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    whose = first.join(unbroadcast(compared), "node", "left_semi").select(F.col("first.key").alias("key"))
    sets = written(_sets(rows.join(unbroadcast(whose), "key", "left_semi").select("node", "data"), n_words).dropDuplicates(["node"]))
    forget(nodes, every)

    links, before, turn = [written(_alike(close, sets, least, close.count()))], 0, 0
    while True:
        roots = connected_components(reduce(DataFrame.unionByName, links))
        members = held.join(unbroadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        outside = written(_outside(members, turn))
        n = outside.count()
        if turn and n > WORTH * before or not n:
            break
        links.append(written(_alike(outside.select(*_ordered(F.col("head"), F.col("node"))).distinct(), sets, least, n)))
        forget(outside)
        before, turn = n, turn + 1
    if n:
        left = members.join(unbroadcast(outside.select("bucket").distinct()), "bucket", "left_semi")
        small = outside.where(F.col("n") <= FEW).select("bucket", F.col("node").alias("n1"), F.col("size").alias("s1"), F.col("root").alias("r1"))
        others = left.select("bucket", F.col("node").alias("n2"), F.col("size").alias("s2"), F.col("root").alias("r2"))
        near = (F.col("s1") >= least * F.col("s2")) & (F.col("s2") >= least * F.col("s1"))  # else they cannot be similar enough
        pairs = small.join(unbroadcast(others), "bucket").where((F.col("r1") != F.col("r2")) & near).select(*_ordered(F.col("n1"), F.col("n2"))).distinct()
        large = outside.where(F.col("n") > FEW)
        links.append(written(_alike(pairs, sets, least).unionByName(_alike_in_blocks(large, left, sets, least))))
        roots = connected_components(reduce(DataFrame.unionByName, links))
    groups = first.join(unbroadcast(roots), "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    stay = written(groups.select(F.col("first.key").alias(own)))
    forget(first, held, close, sets, outside, *links)
    kept = keyed.join(unbroadcast(stay), own, "left_semi")
    return kept.dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in names])
