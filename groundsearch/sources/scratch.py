"""Tables computed once: written to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str):
    """The path and its file system, whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where that is unset and driver and executors are one process, a temporary folder."""
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


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """The path of a folder of its own for this call; it goes when Python ends, unless it is to be kept."""
    path = f"{shared_dir(spark)}/groundsearch/{name}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at, fs = files(spark, path)
        fs.delete(at, True)
    except Exception:  # the session may be gone when Python ends
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once. What is read several times costs one computation, and a lost executor costs none."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
