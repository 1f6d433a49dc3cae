"""A corpus pipeline in five stages, each an operator of `groundsearch.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`.

Defined results, in all stages. Null and empty texts are documents of no text: the first stage scores them like any other,
no line of them goes, they are copies of each other, of which the near-copies stage keeps one, and packing gives it its end
id alone. Very long texts are read whole. Repeated rows are scored, cut and packed each; the near-copies stage keeps
one row of a text. A null `doc_id` stays with its row; null labels, items and sources teach and match nothing. Columns that
have an operator's own names stay as they are. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm import common, decontam, lines, packing, quality, similar, simhash
from groundsearch.llm.queries import tokenizer_file

#: A document stays if its probability of being good is at least this.
KEEP_QUALITY = 0.3
#: A line goes if it stands in more than this share of its source's distinct texts, and in five of them. Copies are left to
#: the next stage: a text counts once, and one that would lose all its lines keeps them.
MAX_LINE_RATIO = 0.1


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good reaches KEEP_QUALITY; equal texts share one fate, since the text alone is scored."""
    labels = common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, learn_from=common.crc_mod("doc_id", 5) != 0)
    score = common.fresh(docs, "quality_score")
    return quality.scored(docs, model, into=score).where(F.col(score) >= KEEP_QUALITY).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; `n_chars`, if there, counts what is left. A null source is a source of none: nothing goes."""
    stats = common.fresh(docs, "line_stats")
    done = lines.drop_boilerplate(docs, host="source", max_ratio=MAX_LINE_RATIO, copies=False, into=stats).drop(stats)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one of smallest id. Texts without a word are copies of each other; rows without an id stay."""
    return simhash.one_of_each(docs, similar.similar_documents(docs, words=5, least=0.8))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item; without items, all."""
    overlaps = common.fresh(docs, "overlaps")
    return decontam.with_overlaps(docs, common.table(spark, sf_dir, "benchmark"), into=overlaps).where(F.size(overlaps) == 0).drop(overlaps)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 tokens, each document's end id included."""
    return packing.pack(docs, tokenizer=tokenizer_file(), window=2048, end_id=1)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
