"""Helpers shared by the operators: the shared folder, written intermediate tables, hashing of rows."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by the six ASCII white-space bytes only; `bytes.split()` uses just these.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Bytes that a writing task gathers on the heap before it writes them out; Parquet's default is eight times as many.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, where that is unset and driver and executors are one process, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="groundsearch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when Python ends
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once: written to the shared folder and read from there.

    The written table replaces the lineage, so that an executor lost later costs no recomputation.
    It is removed by `dropped`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundsearch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` gave and that nothing reads any more."""
    for t in tables:
        _forget(t.sparkSession, t._written_at)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_store() -> dict:
    """A dict that lives as long as the Python worker. Functions sent by value have no module there to keep things in.

    What is large lies in its entry "held", which the next operator in the worker frees (`emptied`).
    """
    return sys.modules.setdefault("_groundsearch_worker", types.ModuleType("_groundsearch_worker")).__dict__


def sliced(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes or one row."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def trim() -> None:
    """Gives freed memory back, which idle Python workers would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def frugal(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, where the session has the default of 64: each task holds some in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, "8m")


def emptied() -> None:
    """Frees what an earlier operator's tasks left in this worker's store."""
    if worker_store().pop("held", None) is not None:
        trim()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], limit: int = 4_000_000, holds: bool = False):
    """For mapInArrow: `run` over small batches, with memory given back at the end of a task.

    Only a `run` that holds things from task to task finds the worker's store as it left it.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            emptied()
        yield from run(sliced(batches, limit))
        trim()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    """The same for applyInArrow."""

    def tidied(rows: pa.Table) -> pa.Table:
        emptied()
        out = run(rows)
        trim()
        return out

    return tidied


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo: the rule that holds rows out. A null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
