"""Keeps a store of passages up to date with a growing table of documents.

    spark-submit jobs/refresh_passages.py --documents PATH --out PATH --checkpoint PATH [--config FILE]

A stream over the documents' files takes what came since the last run (its checkpoint knows the files) and stops. Texts are
cut into bounded, overlapping passages under ids made from source, section and text; a passage that the store holds already is
not stored again, so copies cost one passage. The store is Parquet under `out`, by `batch` and `lang`.

Reruns. A batch writes its own `batch` folder in place of what was there, and compares with all other batches: a batch that
is repeated after a failure, or a checkpoint that was lost, gives the same set of passages. With no new file nothing is written.

Defined results. Null and empty texts have no passages. A null source counts as empty. Of equal passages in one batch the one of the
smallest (doc_id, pos) stays, null ids first; a passage of an earlier batch stays where it is. Equal passages are summed up
map-side before they meet, so a group of copies costs no task more than its share. Other columns of documents are not read. A file
that changes after it was taken is not taken again: new versions come as new files.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from groundsearch.functions import text as T
from groundsearch.operators import chunking
from jobs import common

#: max_files: of one batch; 0 for all that are there.
DEFAULTS = {"max_tokens": 480, "overlap_tokens": 64, "section": "general", "max_files": 0}
COLUMNS = ("doc_id", "text", "lang", "source")
PASSAGE = "chunk_id string, doc_id bigint, pos int, source string, header string, text string, tokens int, n_chars int, batch bigint, lang string"


def passages(docs: DataFrame, config: Mapping) -> DataFrame:
    """Passages of documents, each once."""
    pieces = docs.select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("source"), F.posexplode(chunking.split_text(F.col("text"), config["max_tokens"], config["overlap_tokens"])).alias("pos", "text")).where(F.col("text") != "")
    section, none = F.lit(config["section"]), F.lit(None).cast("string")
    place = F.struct("doc_id", "pos", "lang", "source", "text")
    first = pieces.groupBy(T.chunk_id(F.col("source"), none, section, F.col("text")).alias("chunk_id")).agg(F.min(place).alias("p")).select("chunk_id", "p.*")
    header = chunking.header(F.col("source"), none, none, F.initcap(section), none)
    return first.select("chunk_id", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "source", header.alias("header"), "text", T.token_estimate(F.col("text")).alias("tokens"), F.length("text").alias("n_chars"), "lang")


def store(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PASSAGE).parquet(out)


def pattern(path: str) -> str:
    """A pattern that only this path fits: a stream's plain path must be a folder, but tables may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Mapping | None = None) -> list[dict]:
    """Takes the files that came since the last run with this checkpoint. Returns what each batch read and wrote."""
    config = common.settings(DEFAULTS, config or {})
    spark.createDataFrame([], PASSAGE).write.mode("append").partitionBy("batch", "lang").parquet(out)  # so that a first run can read the store
    done: list[dict] = []

    def take(docs: DataFrame, batch: int) -> None:
        session = docs.sparkSession
        held = store(session, out).where(F.col("batch") != batch).select("chunk_id")
        new = passages(docs, config).join(held, "chunk_id", "left_anti").withColumn("batch", F.lit(batch).cast("bigint"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(out)
        written = store(session, out).where(F.col("batch") == batch).agg(F.count("*").alias("passages"), F.count_distinct("doc_id").alias("documents")).first()
        done.append({"batch": batch, "documents_read": docs.count(), "passages_written": written.passages, "documents_with_new_passages": written.documents})
        common.LOG.info("refresh_passages: batch %d of %s: read %d documents, wrote %d passages of %d documents to %s", batch, documents, done[-1]["documents_read"], written.passages, written.documents, out)

    reader = spark.readStream.schema(spark.read.parquet(documents).schema)
    reader = reader.option("maxFilesPerTrigger", config["max_files"]) if config["max_files"] else reader
    stream = reader.parquet(pattern(documents)).select(*COLUMNS)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    common.LOG.info("refresh_passages: %d batches", len(done))
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="refresh_passages")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    spark = common.session("refresh_passages")
    try:
        run(spark, args.documents, args.out, args.checkpoint, common.load(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
