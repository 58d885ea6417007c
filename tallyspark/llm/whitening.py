"""Whitening of vectors: blockwise QR, Householder bidiagonalisation, dqds values and twisted factorisations for the directions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(float).eps)
#: Squares of values this far below the largest count as this; nothing underflows.
TINY = 1e-280
#: Triangles that one task merges.
FAN = 16
#: Rows of a QR step.
BLOCK = 4096


# ---- vectors as whole numbers


def whole_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): floor(scale * c) + offset of each entry as little-endian longs; rows whose vector is null or empty, holds a null or non-finite
    entry, or one whose x does not fit, go."""
    most = float(2**62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_vector")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)  # a null becomes nan
            good = np.abs(flat) < most
            owner = np.repeat(np.arange(b.num_rows), lengths)
            keep = (lengths > 0) & (np.bincount(owner[~good], minlength=b.num_rows) == 0)
            x = (np.where(good, flat, 0).astype("<i8") + offset)[keep[owner]].tobytes()
            cuts = 8 * np.r_[0, np.cumsum(lengths[keep])]
            data = [x[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(keep)), pa.array(data, pa.binary())], ["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_vector"))
    return rows.mapInArrow(run, "vec_id long, x binary")


def matrix(blobs: pa.Array) -> np.ndarray:
    rows = blobs.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def sums(fit: DataFrame) -> list:
    """(at, n, s) of each dimension: exact sums over the fit list, added up per task and then by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                wide = int(np.abs(x).max()) > 2**40
                part = np.array([sum(c) for c in x.T.tolist()] if wide else x.sum(0).tolist(), object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))], ["at", "n", "s"])

    rows = fit.select("x").mapInArrow(run, "at int, n long, s decimal(38,0)")
    return rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: longs where they suffice, else Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, total), default=0) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return np.array(deviations(x, n, total) / n, float)


# ---- one triangle of all centred rows


def triangle(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the QR factorisation of the centred fit list: each task keeps the triangle of its rows, then FAN triangles at a time are merged."""
    d = len(total)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                y = centred(matrix(b.column("x").slice(a, BLOCK)), n, total)
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(-1, d) for r in rows.sort_values("node")["r"]])
        return pd.DataFrame({"node": [int(key[0])], "r": [np.linalg.qr(stacked, mode="r").tobytes()]})

    span, rs = fit.rdd.getNumPartitions(), fit.select("x").mapInArrow(of_rows, "node long, r binary")
    while span > 1:
        rs = rs.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).applyInPandas(merged, "node long, r binary")
        span = -(-span // FAN)
    r = np.frombuffer(rs.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


# ---- the small problem: d x d, on the driver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) with U' r V upper bidiagonal for some orthogonal U, by Householder reflections from both sides."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if len(x) < 2 or not norm or not np.abs(x[1:]).max():
            return None
        u = x / norm
        u[0] += math.copysign(1, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < d and (u := mirror(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference step: arrays of the matrix whose values are smaller by the shift, and the sum of 1/d.
    None where the shift is above the smallest value."""
    d, top, side, inverse = q[0] - shift, [], [], 0.0
    for k in range(len(e)):
        if d <= 0 and shift:
            return None
        d = max(d, TINY)
        inverse += 1 / d
        s = d + e[k]
        t = q[k + 1] / s
        top.append(s)
        side.append(e[k] * t)
        d = d * t - shift
    if d < 0:
        return None
    d = max(d, TINY)
    top.append(d)
    return top, side, inverse + 1 / d


def qd_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling: dqds.

    Steps without a shift take turns with steps by 1 / sum(1/d): these d are the reciprocals of the diagonal of the inverse, so
    the shift is 1 over its trace, below the smallest value. Nothing is subtracted but shifts, hence small values are as exact as large ones.
    """
    out, blocks = [], [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        cut = next((k for k in range(len(e)) if e[k] <= max(EPS**2 * (moved + min(q[k], q[k + 1])), TINY)), None)
        if not e:
            out.append(moved + q[0])
        elif cut is not None:
            blocks += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
        else:
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            q, e, inverse = qd_step(q, e, 0.0)
            shift = 1 / inverse
            while (step := qd_step(q, e, shift)) is None:
                shift *= 0.75
            blocks.append((step[0], step[1], moved + shift))
    return np.sort(np.array(out))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The unit vector z with (B'B - value) z = 0 as nearly as may be: factorised from above and from below, twisted where the two differ least."""
    n, tiny = len(diagonal), EPS**2 * float((diagonal**2).max())
    big, low = diagonal**2, upper / diagonal[:-1]

    def safe(x: float) -> float:
        return x if abs(x) > tiny * EPS else math.copysign(tiny * EPS, x)

    for again in (True, False):
        s, p = np.zeros(n), np.zeros(n)
        down, up = np.zeros(n - 1), np.zeros(n - 1)
        s[0], p[-1] = -value, big[-1] - value
        for i in range(n - 1):
            down[i] = big[i] * low[i] / safe(s[i] + big[i])
            s[i + 1] = down[i] * low[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            t = big[i] / safe(big[i] * low[i] ** 2 + p[i + 1])
            up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        k = int(np.abs(gamma).argmin())
        z = np.zeros(n)
        z[k] = 1
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        norm = float(z @ z)
        if again:
            value += gamma[k] / norm
    return z / math.sqrt(norm)


def directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, directions as columns) of r, falling: the first ``most`` that are not zero to working precision.

    Values closer together than rounding allows twisted factorisations to tell apart leave vectors that are not quite orthogonal: rotations of pairs of columns of r Z (one-sided Jacobi)
    mend those, and only those.
    """
    d = r.shape[1]
    diagonal, upper, v = bidiagonal(r)
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, upper = diagonal / scale, upper / scale
    diagonal = np.where(np.abs(diagonal) < EPS**1.25, EPS**1.25, diagonal)
    values, z = [], np.zeros((d, d))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= EPS * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))) + 1).tolist(), d]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for value in qd_values(diagonal[a:b], upper[a : b - 1]):
            z[a:b, len(values)] = twisted(diagonal[a:b], upper[a : b - 1], float(value)) if b - a > 1 else 1.0
            values.append(value)
    order = np.argsort(-np.array(values), kind="stable")
    values, z = np.array(values)[order], z[:, order]
    z, signs = np.linalg.qr(z)
    z = v @ (z * np.sign(np.diag(signs) + (np.diag(signs) == 0)))
    y = r @ z
    for _ in range(30):
        norm = np.linalg.norm(y, axis=0)
        unit = y / np.where(norm > 0, norm, 1)
        # below this two columns are orthogonal to working precision; columns that are zero to it do not count
        live = norm > d * EPS * norm.max()
        i, j = np.nonzero(np.triu((np.abs(unit.T @ unit) > 4 * EPS * math.sqrt(d)) & np.outer(live, live), 1))
        if not len(i):
            break
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            aa, bb, ab = y[:, a] @ y[:, a], y[:, b] @ y[:, b], y[:, a] @ y[:, b]
            if not ab:
                continue
            tau = (bb - aa) / (2 * ab)
            t = math.copysign(1, tau) / (abs(tau) + math.hypot(1, tau))
            c = 1 / math.hypot(1, t)
            for m in (y, z):
                m[:, a], m[:, b] = c * m[:, a] - c * t * m[:, b], c * t * m[:, a] + c * m[:, b]
    norm = np.linalg.norm(y, axis=0)
    order = np.argsort(-norm, kind="stable")
    order = order[norm[order] > max(d, 16) * EPS * norm.max()][:most]
    # dqds is exact for small values too; a rotation may have moved values only within their rounding
    exact = np.sqrt(values)[: len(order)] * scale
    sigma = np.where(np.abs(exact - norm[order]) <= 1e-12 * norm[order], exact, norm[order])
    return sigma, z[:, order] / np.linalg.norm(z[:, order], axis=0)


# ---- whitened rows


def covariance(fit: DataFrame, n: int, total: list[int], w: np.ndarray) -> np.ndarray:
    """The covariance of the fit list's whitened rows; each task adds up its own, then entries are added up by place."""
    k = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                y = centred(matrix(b.column("x")), n, total) @ w
                out += np.vstack([y.T @ y, y.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], ["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    got = np.array([row["v"] for row in rows]).reshape(k + 1, k) / n
    return got[:k] - np.outer(got[k], got[k])


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every valid row and each of the first ``most`` components.

    Mean and covariance are those of the different vectors x (``whole_vectors``), n of them. Components with no variance to working precision are left out:
    fewer than ``most`` where the rank is lower, and no rows at all for an empty table or a single vector. Vectors
    of another length than most different ones (ties: the longer) go too. Repeated rows and null ids give rows of their own. ``deviation`` is
    exact, null where it does not fit a long. Only sums, triangles and covariances reach the driver, of a size that the
    dimension sets. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, offset)
    fit = written(rows.select("x").distinct())
    lengths = fit.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    same = F.octet_length("x") == lengths["size"]
    rows, fit = rows.where(same), fit.where(same)
    by_dim = sums(fit)
    n, total = by_dim[0]["n"], [int(r["s"]) for r in by_dim]
    r = triangle(fit, n, total)
    sigma, z = directions(r, most)
    k = len(sigma)
    if not k:
        return spark.createDataFrame([], _OUT)
    explained = sigma**2 / float((r**2).sum())
    w = z / (sigma / math.sqrt(n))
    error = float(np.abs(covariance(fit, n, total, w) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            dev = deviations(matrix(b.column("x")), n, total)
            if dev.dtype == object or float(np.abs(dev).max()) * math.sqrt(len(total)) >= 2.0**31:
                dev = dev.astype(object)
            square = [s if s < 2**63 else None for s in (dev * dev).sum(1).tolist()]
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()), pa.array(square, pa.int64()).take(at)]
            columns += [pa.array((np.array(dev / n, float) @ w).ravel()), pa.array(np.tile(explained, m)), pa.array([error] * (m * k))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)


def op13_bidiagonal_whitening(spark, sf_dir) -> DataFrame:
    """One row per valid vector and component, up to 16."""
    from tallyspark.llm.common import table

    return whitened(table(spark, sf_dir, "embeddings"))
