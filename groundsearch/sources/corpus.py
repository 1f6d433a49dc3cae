"""Readers and writers of the corpus: manifest, normalised documents, chunks, gold sets, raw files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CHUNK, COMMIT_POLICIES, COMMITTABLE, GOLD_ITEM, NORMALIZED_DOC, PARSERS
from .scratch import files

MANIFEST = "doc_id string, title string, publisher string, source_url string, sha256 string, retrieval_date string, plan_year int, doc_type string, license_posture string, commit_policy string, parser_id string"


class CorpusError(ValueError):
    """Input that breaks a rule of the corpus."""


class IntegrityError(CorpusError):
    """Bytes that differ from what the manifest pins."""


def committable(posture: Column) -> Column:
    return posture.isin(*COMMITTABLE)


def load_manifest(spark: SparkSession, path: str | Path) -> DataFrame:
    """The whitelist of documents, from YAML. A text that may not be redistributed must not be marked for committing."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8"))["documents"]
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    df = spark.createDataFrame([tuple(str(r[n]) if n != "plan_year" and r.get(n) is not None else r.get(n) for n in names) for r in rows], MANIFEST)
    check_manifest(df)
    return df


def check_manifest(manifest: DataFrame) -> None:
    bad = manifest.where(
        ~F.col("commit_policy").isin(*COMMIT_POLICIES) | ~F.col("parser_id").isin(*PARSERS) | ((F.col("commit_policy") == "commit_normalized") & ~committable(F.col("license_posture")))
    ).select("doc_id").take(20)
    if bad:
        raise CorpusError(f"manifest rows break the licence or name rules: {sorted(r.doc_id for r in bad)}")


def by_id(manifest: DataFrame, doc_id: str) -> DataFrame:
    found = manifest.where(F.col("doc_id") == doc_id)
    if not found.take(1):
        raise KeyError(doc_id)
    return found


def cache_name(doc_id: Column, url: Column) -> Column:
    suffix = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"[^/](\.[A-Za-z0-9]+)$", 1)
    return F.concat(doc_id, F.when(suffix == "", ".bin").otherwise(suffix))


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", digest(F.col("content")).alias("sha256"))


def verify_raw(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest whose bytes are as pinned; raises if any differ."""
    named = manifest.select("doc_id", F.col("sha256").alias("pinned"), cache_name(F.col("doc_id"), F.col("source_url")).alias("name"))
    joined = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name")
    bad = joined.where(F.col("sha256") != F.col("pinned")).select("doc_id").take(20)
    if bad:
        raise IntegrityError(f"bytes differ from the manifest's digest: {sorted(r.doc_id for r in bad)}")
    return joined.drop("pinned")


def load_normalized(spark: SparkSession, directory: str) -> DataFrame:
    """Normalised documents, one JSON file each. An empty folder is an error."""
    docs = spark.read.schema(NORMALIZED_DOC).option("multiLine", True).option("mode", "FAILFAST").json(directory)
    if not docs.take(1):
        raise CorpusError(f"no normalised documents in {directory}")
    return docs


def write_normalized(docs: DataFrame, manifest: DataFrame, directory: str) -> None:
    """Only documents that the manifest marks for committing, one in a file, as they are read."""
    allowed = manifest.where("commit_policy = 'commit_normalized'").select("doc_id")
    docs.join(allowed, "doc_id", "left_semi").write.mode("overwrite").option("maxRecordsPerFile", 1).json(directory)


def has_normalized(spark: SparkSession, directory: str) -> bool:
    at, fs = files(spark, f"{directory}/*.json")
    return bool(fs.globStatus(at))


def read_texts(spark: SparkSession, directory: str, manifest: DataFrame) -> DataFrame:
    """The manifest's rows with `text`: extracted texts with page marks, one document a file, named by doc_id. A document without a file is an error."""
    texts = spark.read.text(f"{directory}/*.txt", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"))
    docs = manifest.join(texts, "doc_id", "left")
    lost = docs.where("text is null").select("doc_id").take(20)
    if lost:
        raise CorpusError(f"no extracted text of {sorted(r.doc_id for r in lost)} in {directory}")
    return docs


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of every line of text files, blank ones too; lines count from 1 in each file.

    A large file is read in blocks. A line's number is its place in its block and the lines of the blocks before, so no
    task holds more than a block, and only the blocks' counts meet.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"), at.alias("block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    return lines.withColumn("place", place).join(counts, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Records with their file and line, and the places (file, line, reason) of lines that hold none; blank lines are neither.

    A line holds no record if it isn't JSON of the schema's types, or lacks the key. Reasons name no content.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.select("file", "line", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "not readable").when(F.col(f"r.{key}").isNull(), f"no {key}")
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select("file", "line", "r.*").drop("_corrupt"), marked.where("reason is not null").select("file", "line", "reason")


def _refuse(bad: DataFrame, what: str) -> None:
    rows = bad.orderBy("file", "line").take(20)
    if rows:
        raise CorpusError(f"{what} that can't be read: " + "; ".join(f"{r.file.rsplit('/', 1)[-1]} line {r.line}: {r.reason}" for r in rows))


def read_chunk_lines(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Chunks as JSON lines. Of one id the last line counts, by file and line. Lines without a chunk are an error, or are set aside: their places are written to `quarantine`."""
    good, bad = read_json_lines(spark, path, CHUNK, "chunk_id")
    if quarantine:
        bad.write.mode("overwrite").parquet(quarantine)
    else:
        _refuse(bad, "lines of chunks")
    rest = [c for c in good.columns if c not in ("chunk_id", "file", "line")]
    return good.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("c")).select("chunk_id", "c.*")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold items from JSON lines; blank lines are skipped, lines without an item are an error that names them."""
    good, bad = read_json_lines(spark, path, GOLD_ITEM, "item_id")
    _refuse(bad, "lines")
    return good.drop("file", "line")
