"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_length, forget, written
from tallyspark.llm.components import connected_components

COSINE = 0.98
#: Vectors that a cell should have: one pivot is drawn for so many.
CELL = 1000
#: Pivots of a round, over all labels and cells: what is broadcast. Cells that are still too large are split again by pivots of their own.
MOST_PIVOTS = 4096
ROUNDS = 4
#: A cell with more vectors than this is compared block by block.
BLOCK = 4096


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): vectors of length one as little-endian doubles; null for a null label or a vector that can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            labelled = b.column("label").is_valid().to_numpy(zero_copy_only=False)
            for rows, v in by_length(b.column("embedding")):
                most = np.abs(v).max(1)
                good = np.isfinite(most) & (most > 0) & labelled[rows]
                v, most, rows = v[good], most[good][:, None], rows[good]
                n = np.linalg.norm(v / most, axis=1)[:, None] * most
                good = np.isfinite(n[:, 0])
                for k, unit in zip(rows[good].tolist(), (v / n)[good].astype("<f8"), strict=True):
                    out[k] = unit.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, unit binary")


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, home): each vector in the cell of its nearest pivot, its home, and in each further cell whose vectors may lie within ``reach``.

    If y in cell j lies within r of x in cell i, then by the triangle inequality d(x, j) <= d(x, i) + 2 r, and
    x is at most r away from the plane between the two pivots: (d(x, j)^2 - d(x, i)^2) / 2 d(i, j) <= r.
    """
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    for a in range(0, len(x), 1024):
        square = np.maximum(2 - 2 * x[a : a + 1024] @ pivots.T, 0)
        home = square.argmin(1)
        least = square[np.arange(len(home)), home][:, None]
        near = (np.sqrt(square) <= np.sqrt(least) + 2 * reach) & (square - least <= 2 * reach * between[home])
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near)
        yield row + a, cell, cell == home[row]


_PLACED = "node long, label string, width int, cell long, home boolean, copies long, unit binary"
_CELL = ["label", "width", "cell"]


def split(placed: DataFrame, pivots: dict, reach: float) -> DataFrame:
    """``placed`` with the cells that have ``pivots`` split by them; others stay as they are."""
    shared = placed.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in _CELL), strict=True)):
                own.setdefault(key, []).append(i)
            for key, at in own.items():
                part, p = b.take(pa.array(at)), shared.value.get(key)
                if p is None:
                    yield part
                    continue
                for row, sub, near in cells(matrix(part.column("unit").to_pylist()), p, reach):
                    out = part.take(pa.array(row))
                    home = near & out.column("home").to_numpy(zero_copy_only=False)
                    out = out.set_column(3, "cell", pa.array(key[2] * (MOST_PIVOTS + 1) + 1 + sub, pa.int64()))
                    yield out.set_column(4, "home", pa.array(home))

    return placed.mapInArrow(run, _PLACED)


def placed_in_cells(nodes: DataFrame, least: float, cell: int = CELL, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``nodes`` (node, label, unit, copies) in cells: every node in one as its home, and in all others that may hold a node that it links with.

    A label and length of vector is one cell at first. Each round draws pivots by hash from cells of over twice ``cell``
    vectors, one for every ``cell`` of them and ``most_pivots`` in all, and splits these cells. It ends when no cell is too large, or when
    a round saves less than a fifth of the comparisons, as in a dense group that no pivot can part.
    """
    reach = math.sqrt(2 - 2 * least) + 1e-6
    placed = written(nodes.select("node", "label", F.octet_length("unit").alias("width"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "copies", "unit"))
    before = math.inf
    for k in range(ROUNDS):
        sizes = placed.groupBy(*_CELL).agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        large = sizes.where((F.col("n") > 2 * cell) & (F.col("homes") > 1))
        total = sizes.agg(F.sum(F.col("n") * F.col("homes")).alias("pairs"), F.sum(F.when((F.col("n") > 2 * cell) & (F.col("homes") > 1), F.col("homes"))).alias("homes")).first()
        if not total.homes or total.pairs > 0.8 * before:
            break
        before = total.pairs
        u = F.pmod(F.xxhash64(F.lit(7 + k), "node"), F.lit(1 << 30)) / float(1 << 30)
        drawn = placed.where(F.col("home") & (u < min(1 / cell, most_pivots / 2 / total.homes))).join(large, _CELL, "left_semi")
        pivots: dict = {}
        for r in drawn.select(*_CELL, "unit").limit(most_pivots).collect():
            pivots.setdefault((r.label, r.width, r.cell), []).append(bytes(r.unit))
        pivots = {key: matrix(sorted(v)) for key, v in pivots.items() if len(v) > 1}
        if not pivots:
            break
        old, placed = placed, written(split(placed, pivots, reach))
        forget(old)
    return placed


def merge(root: np.ndarray, members: np.ndarray) -> None:
    """The groups of these members become one, named by the smallest."""
    own = root[members]
    low = own.min()
    if (own != low).any():
        root[np.isin(root, own)] = low


def linked(x: np.ndarray, copies: np.ndarray, home: np.ndarray, block: np.ndarray, across: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell its links (for home rows) and the first row of its group; across: only links between different blocks."""
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for a in range(0, len(home), 512):
        h = home[a : a + 512]
        near = x[h] @ x.T >= least
        near[np.arange(len(h)), h] = False
        if across:
            near &= block[h][:, None] != block[None, :]
        for i in np.flatnonzero(near.any(1)):  # few rows have a link at all
            at = np.flatnonzero(near[i])
            links[h[i]] = copies[at].sum()
            merge(root, np.r_[h[i], at])
    return links, root


def range_join(nodes: DataFrame, least: float = COSINE, cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node, label, unit, copies) -> (node, links) of nodes with links, and edges (a, b) that join the same nodes as all links do.

    Each cell joins on its own; cells of more than ``block`` vectors are joined block by block, so that a task never holds more than two blocks.
    """
    placed = placed_in_cells(nodes, least, cell, most_pivots)
    blocks = placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int").alias("mine")
    rows = placed.join(blocks, _CELL).select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).drop("other", "blocks")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        home = np.flatnonzero(pdf["home"].to_numpy())
        links, root = linked(matrix(list(pdf["unit"])), pdf["copies"].to_numpy(), home, pdf["mine"].to_numpy(), pdf["p"].iloc[0] != pdf["q"].iloc[0], least)
        node, some = pdf["node"].to_numpy(), (links > 0) | (root != np.arange(len(root)))
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    found = written(rows.groupBy(*_CELL, "p", "q").applyInPandas(join, "node long, links long, root long"))
    forget(placed)
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, **sizes) -> DataFrame:
    """(vec_id, n_links, component_id) of every row.

    Equal vectors of a label are one node, whatever their number (equal by 128 bits of their hashes). Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without a label, have no links and are their own component; vectors of different length never
    link. Rows that repeat a vec_id are vectors of their own that share a name; a null vec_id names no component that has others. An empty
    table gives no rows. Other columns are not read. ``sizes``: those of ``range_join``.
    """
    rows = written(unit_vectors(vectors).withColumns({"h1": F.xxhash64("label", "unit"), "h2": F.xxhash64(F.lit(7), "label", "unit")}))
    key = ["h1", "h2"]
    nodes = rows.where("unit is not null").groupBy(*key).agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))  # fixed once it is written
    links, edges = range_join(nodes.drop("first_id", *key), least, **sizes)
    named = nodes.join(connected_components(edges), "node", "left").select("node", *key, "first_id", "copies", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = named.join(groups, "root").join(links, "node", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    have = rows.where("unit is not null").select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
    return have.unionByName(rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6_pivot_range_join(spark, sf_dir) -> DataFrame:
    """One row per vector: its links, its component and whether it stays."""
    from tallyspark.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS least_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.least_id, vec_id) AS component_id, coalesce(c.least_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
