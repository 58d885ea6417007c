"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' words: runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows and bytes of a batch that goes to a Python worker, unless the session has fewer: whole texts are long, and a task holds a batch on either side.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def size_of(setting: str) -> int:
    """The number of a setting such as 10000, 64m or 1gb, in bytes where it has a unit."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a cluster without that path gets it by --py-files), and bounds their batches."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < size_of(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Jobs in here are not run again from their shuffles: Spark deletes these as a job ends, not when the driver's memory happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{uuid.uuid4().hex}"
    with run_once(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that all who read them have read: what was made of them must be written itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unbroadcast(df: DataFrame) -> DataFrame:
    """For joins of tables that grow with the corpus: both sides are sorted, none is broadcast. Spark takes a table for smaller than it is after an explode or a
    Python function that returns more rows than it gets, and where files are compressed; what it then broadcasts does not fit the driver."""
    return df.hint("merge")


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with as many ``_`` at its end as it takes to be none of ``taken`` (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def wide_hash(*columns: Column) -> Column:
    """128 bits that stand for these values, nulls included. Columns of composite types are to be written as text before (``hashable``)."""
    values = [*columns, *[c.isNull() for c in columns]]
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*values), F.xxhash64(F.lit(42), *values))]
    return F.unhex(F.concat(*halves))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df``; arrays, maps and the like as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if f.dataType.typeName() in ("array", "map", "struct", "variant") else F.col(f"`{f.name}`") for f in df.schema]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Returns this worker's free memory to the system, where its allocators can: the worker goes on to tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``max_bytes`` of a string or binary column (one row at least).
    After the last one the worker's free memory is given back."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // max_bytes
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
            yield batch.slice(int(a), int(b - a))
    give_back()


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length but 0: their numbers, and their values as rows of doubles; a null value is nan. Null lists are left out."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    start = np.cumsum(length) - length
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def split_words(data: bytes | None) -> list[bytes]:
    """``bytes.split()`` cuts at exactly the six characters that WORD leaves out."""
    return data.split() if data else []
