"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import by_length, shuffle_partitions, written

K = 5
#: Documents in a block, and queries that meet a range of documents in one task.
BLOCK = 256
QUERIES = 2048
#: Documents that a task holds.
RANGE = 16_384


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): each component x as floor(scale * x) in a little-endian array of longs; invalid vectors and rows without an id take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            for rows, x in by_length(b.column("embedding")):
                good = np.isfinite(x).all(1)
                for k, terms in zip(rows[good].tolist(), np.floor(scale * x[good]).astype("<i8"), strict=True):
                    out[k] = terms.tobytes()
            found = pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "terms"])
            yield found.filter(pc.and_(found.column(0).is_valid(), found.column(1).is_valid()))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, terms binary")


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1)


def search(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score): each query's k best of these documents but itself, ties to the smaller id.

    Documents, in order of their id, form blocks. A term's maximum in a block (its minimum for a negative query weight) bounds what it
    can add, the sum of these bounds any score of the block. A query visits blocks by falling bound, scores them through
    their forward index, a dense matrix, and stops at the first bound below its kth score.
    """
    order = np.argsort(ids, kind="stable")
    # sums of products stay whole in double precision
    ids, docs, queries = ids[order], docs[order].astype(float), queries.astype(float)
    cuts = np.arange(0, len(ids), BLOCK)
    most, least = np.maximum.reduceat(docs, cuts), np.minimum.reduceat(docs, cuts)
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    out = []
    for q, query, bound in zip(query_ids, queries, bounds, strict=True):
        got_ids, got = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if len(got) >= k and bound[b] < got[k - 1]:
                break
            own = slice(cuts[b], cuts[b] + BLOCK)
            score = docs[own] @ query
            use = ids[own] != q
            if len(got) >= k:
                use &= score >= got[k - 1]
            if use.any():
                got, got_ids = np.concatenate([got, score[use]]), np.concatenate([got_ids, ids[own][use]])
                top = np.lexsort((got_ids, -got))[:k]
                got, got_ids = got[top], got_ids[top]
        out += [(int(q), int(i), int(s)) for i, s in zip(got_ids, got, strict=True)]
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``, by integer inner product.

    Ranges of documents and chunks of queries meet in a grid; a task holds one range of about RANGE documents and one chunk
    of about QUERIES queries. Each gives k rows a query at most, of which the best stay. A row's own id is never among its results; rows that repeat an id are candidates one
    by one and one query. Vectors of another length than the query's are no candidates. Other columns are not read.
    """
    rows = integer_vectors(vectors).withColumn("width", F.octet_length("terms"))
    rows = written(rows)
    n = rows.count()
    ranges = max(math.ceil(n / RANGE), min(shuffle_partitions(vectors.sparkSession), math.ceil(n / 1024)), 1)
    docs = rows.repartitionByRange(ranges, "vec_id", F.xxhash64("terms")).withColumn("range", F.spark_partition_id())
    docs = written(docs.select("range", "width", "vec_id", "terms"))
    last = docs.agg(F.max("range")).first()[0] or 0
    chunks = max(1, math.ceil(n / every / QUERIES))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("width", "terms")).alias("v"))
    queries = queries.select(h.alias("chunk"), "v.width", "vec_id", "v.terms")
    left = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = search(d["vec_id"].to_numpy(), matrix(list(d["terms"])), q["vec_id"].to_numpy(), matrix(list(q["terms"])), k) if len(d) and len(q) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["range", "chunk", "width"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_block_max_search(spark, sf_dir) -> DataFrame:
    """Five rows per query."""
    from tallyspark.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

