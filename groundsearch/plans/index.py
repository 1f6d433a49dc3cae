"""An index on disk: versions of chunks, their postings and vectors, and a stamp that names the version that counts.

A build writes a version of its own and puts its stamp over the old one last, by a rename: readers find the old version or the
new one, never a half, and a build that dies leaves the old. Chunks that the old version holds unchanged keep their postings
and vectors; only added and changed ones are tokenised and embedded. The last two versions stay, for readers that began before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import bm25
from ..operators.chunking import chunk_documents, embed_text
from ..sources import corpus
from ..sources.scratch import files, written


class StaleIndexError(RuntimeError):
    """There is no index, or it was built otherwise."""


def _put(spark: SparkSession, path: str, text: str) -> None:
    """The file's whole new content at once, by a rename over the old."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, fs = files(spark, path)
    new, _ = files(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(at), over)


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = files(spark, path)
    return fs.exists(at)


def differences(held: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The key and status of every chunk: added, removed, changed or kept. Chunks of one id differ if any other column of both tables does.

    Rows are compared by digests, so texts don't meet; a key stands once in each table.
    """
    columns = sorted(c for c in held.columns if c in new.columns and c != key)
    parts = [F.coalesce(F.base64(F.encode(F.col(c).cast("string"), "utf-8")), F.lit("-")) for c in columns]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    both = held.select(key, digest.alias("was")).join(new.select(key, digest.alias("is")), key, "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed").otherwise("kept")
    return both.select(key, status.alias("status"))


def build(docs: DataFrame, directory: str, settings: Settings = Settings(), *, embed: Callable[[DataFrame], DataFrame] | None = None, manifest_version: str = "unversioned") -> dict:
    """Chunks normalised documents into a new version of the index; `embed` turns (chunk_id, text) into (chunk_id, embedding). Returns the stamp, with the number of chunks of each status."""
    spark = docs.sparkSession
    folder = f"versions/{uuid.uuid4().hex}"
    path = f"{directory}/{folder}"
    try:
        old = verify(spark, directory, settings)
    except StaleIndexError:  # nothing of it can be kept
        old = None
    corpus.write_chunks(chunk_documents(docs, max_tokens=settings.chunk_max_tokens, overlap_tokens=settings.chunk_overlap_tokens), f"{path}/chunks")
    new = corpus.read_chunks(spark, f"{path}/chunks")
    total = new.count()
    held = chunks(spark, directory) if old else new.where("false")
    found = written(differences(held, new), "differences")
    counts = {r.status: r.n for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}  # four
    same = found.where("status = 'kept'").select("chunk_id")
    text = embed_text(F.col("header"), F.col("text")).alias("text")
    fresh = new.join(same, "chunk_id", "left_anti").select("chunk_id", text)
    bm25.write(fresh, f"{path}/lexicon", key="chunk_id", kept=lexicon(spark, directory).postings.join(same, "chunk_id", "left_semi") if old else None)
    if embed:
        before = vectors(spark, directory).join(same, "chunk_id", "left_semi") if old else None
        fresh = new.select("chunk_id", text).join(before, "chunk_id", "left_anti") if old else fresh  # the old version may have been built without vectors
        made = embed(fresh).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
        (made.unionByName(before) if old else made).write.mode("overwrite").parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors").agg(F.count_distinct("chunk_id").alias("n"), F.count("embedding").alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if (stored.n, stored.vectors) != (total,) * 2 or stored.least != stored.most:
            raise ValueError(f"{stored.vectors} vectors of {stored.least} to {stored.most} components for {total} chunks")
    stamp = {
        "embedding_model": settings.embedding_model, "config_hash": settings.index_hash, "manifest_version": manifest_version,
        "chunk_count": total, "built_at": datetime.now(timezone.utc).isoformat(), "folder": folder, "previous": old and old["folder"],
        "statuses": {k: counts.get(k, 0) for k in ("added", "changed", "kept", "removed")},
    }
    _put(spark, f"{directory}/stamp.json", json.dumps(stamp, indent=2) + "\n")
    at, fs = files(spark, f"{directory}/versions")
    for status in fs.listStatus(at):
        if status.getPath().getName() not in {f.split("/")[1] for f in (folder, stamp["previous"]) if f}:
            fs.delete(status.getPath(), True)
    return stamp


def _stamp(spark: SparkSession, directory: str) -> dict:
    if not _exists(spark, f"{directory}/stamp.json"):
        raise StaleIndexError(f"no index stamp in {directory}; build the index")
    try:
        stamp = json.loads("\n".join(r.value for r in spark.read.text(f"{directory}/stamp.json").collect()))
        [stamp[k] for k in ("embedding_model", "config_hash", "chunk_count", "folder")]
    except Exception as e:  # a broken file fails in many ways, and none must show its content
        raise StaleIndexError(f"the index stamp in {directory} can't be read ({type(e).__name__}); build the index") from None
    return stamp


def current(spark: SparkSession, directory: str) -> str:
    """The folder of the version that counts."""
    return f"{directory}/{_stamp(spark, directory)['folder']}"


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    return corpus.read_chunks(spark, f"{current(spark, directory)}/chunks")


def vectors(spark: SparkSession, directory: str) -> DataFrame:
    """chunk_id, embedding; no rows where the index was built without."""
    path = f"{current(spark, directory)}/vectors"
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "chunk_id string, embedding array<float>")


def lexicon(spark: SparkSession, directory: str) -> bm25.Lexicon:
    """The postings of the chunks, header and text, under their ids."""
    return bm25.read(spark, f"{current(spark, directory)}/lexicon")


def embed_questions(questions: DataFrame, embed: Callable[[DataFrame], DataFrame] | None, settings: Settings = Settings()) -> DataFrame:
    """Questions with `embedding` (null without `embed`, which turns query_id, text into query_id, embedding). The model's prefix stands before each question exactly once."""
    if embed is None:
        return questions.withColumn("embedding", F.lit(None).cast("array<float>"))
    prefix = F.lit(settings.query_prefix)
    asked = F.when(F.startswith("query", prefix), F.col("query")).otherwise(F.concat(prefix, "query"))
    return questions.join(embed(questions.select("query_id", asked.alias("text"))).select("query_id", "embedding"), "query_id", "left")


def verify(spark: SparkSession, directory: str, settings: Settings = Settings()) -> dict:
    """The stamp, if the index fits the settings and holds as many chunks and postings as it says."""
    stamp = _stamp(spark, directory)
    if (stamp["embedding_model"], stamp["config_hash"]) != (settings.embedding_model, settings.index_hash):
        raise StaleIndexError(f"the index in {directory} was built with {stamp['embedding_model']}, {stamp['config_hash']}; wanted: {settings.embedding_model}, {settings.index_hash}")
    try:
        held = {"chunks": chunks(spark, directory).count(), "postings": lexicon(spark, directory).summary.first().n}
    except Exception as e:
        raise StaleIndexError(f"the chunks and postings in {directory} can't be read ({type(e).__name__}); build the index") from None
    for what, n in held.items():
        if n != stamp["chunk_count"]:
            raise StaleIndexError(f"the index in {directory} has {what} of {n} chunks, not of the {stamp['chunk_count']} of its stamp")
    return stamp
