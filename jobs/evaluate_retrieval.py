"""Measures how well search by words finds the documents that hold a benchmark's passages, and holds it against a baseline.

    spark-submit jobs/evaluate_retrieval.py --documents PATH --benchmark PATH --out PATH [--config FILE] [--gate]

The gold set is made from the tables themselves: a document that holds a passage verbatim is what a search for it should
find. Documents are ranked by BM25, items get hit@1, mrr, precision and recall, and means are taken over each language and all.
The output is Parquet under `out`, by `scope`: `item` (one row an item and metric), `category`, `overall`, `gate` (the baseline's
metrics, value 1 where the ratchet finds a regression). With --gate a regression is the exit code 1.

Reruns replace the output by the same rows. Items that no document holds carry no metric; a metric `documents` of each item
tells how many hold it. An item's category is the language of the first document, by id, that holds it (`none` if that is null, or
if no document does). Null and empty texts are documents without words; null and empty passages are held by none. Documents
of one id count as one. Empty tables give gates only: a metric that is missing is a regression.
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

from groundsearch.operators import bm25, containment, evaluation
from groundsearch.sources.scratch import written
from jobs import common

DEFAULTS = {"k": 8, "recall_at": [5, 8], "baseline": {"recall@8": 0.9, "mrr": 0.9}, "tolerance": 0.02}


def results(docs: DataFrame, benchmark: DataFrame, config: Mapping) -> DataFrame:
    """scope, name, metric, value."""
    spark = docs.sparkSession
    lexicon = bm25.lexicon(docs.select("doc_id", "text"))
    gold = written(containment.holding(benchmark.select("item_id", "text"), docs, lexicon).distinct(), "gold")
    ranked = bm25.top_k(lexicon, benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), config["k"])
    ranked = ranked.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("chunk_id"), "rank")
    first = gold.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("doc_id")).join(docs.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", "left")
    items = benchmark.select("item_id").distinct().join(first, "item_id", "left")
    items = items.select("item_id", F.coalesce("lang", F.lit("none")).alias("category"), F.lit("all").alias("split"), F.lit(False).alias("is_refusal"), F.lit(None).cast("boolean").alias("refused"), F.coalesce("documents", F.lit(0)).cast("double").alias("documents"))
    metrics = written(evaluation.item_metrics(items, ranked, gold.withColumnRenamed("doc_id", "chunk_id"), tuple(config["recall_at"])), "metrics")
    means = evaluation.report(metrics).where("scope <> 'split'")
    baseline = spark.createDataFrame(sorted(config["baseline"].items()), "metric string, baseline double")
    gate = evaluation.ratchet(means, baseline, config["tolerance"]).select(F.lit("gate").alias("scope"), F.lit("").alias("name"), "metric", F.col("regressed").cast("double").alias("value"))
    name = F.col("item_id").cast("string").alias("name")
    each = metrics.select(F.lit("item").alias("scope"), name, "metric", "value").unionByName(items.select(F.lit("item").alias("scope"), name, F.lit("documents").alias("metric"), F.col("documents").alias("value")))
    return each.unionByName(means).unionByName(gate)


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("name string, metric string, value double, scope string").parquet(out)


def run(spark: SparkSession, documents: str, benchmark: str, out: str, config: Mapping | None = None) -> list[str]:
    """Writes the report in place of what was there. Returns the metrics that fell below the baseline."""
    config = common.settings(DEFAULTS, config or {})
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang")
    items = spark.read.parquet(benchmark).select("item_id", "text")
    common.LOG.info("evaluate_retrieval: read %d documents of %s, %d items of %s", docs.count(), documents, items.count(), benchmark)
    results(docs, items, config).hint("rebalance", "scope").write.mode("overwrite").partitionBy("scope").parquet(out)
    kept = read(spark, out)
    for r in kept.groupBy("scope").agg(F.count("*").alias("n")).orderBy("scope").collect():  # four scopes
        common.LOG.info("evaluate_retrieval: wrote %d rows of scope %s to %s", r.n, r.scope, out)
    worse = sorted(r.metric for r in kept.where("scope = 'gate' and value = 1").collect())  # the baseline's metrics
    common.LOG.info("evaluate_retrieval: below the baseline: %s", ", ".join(worse) or "none")
    return worse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evaluate_retrieval")
    for name in ("documents", "benchmark", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    parser.add_argument("--gate", action="store_true")
    args = parser.parse_args(argv)
    spark = common.session("evaluate_retrieval")
    try:
        worse = run(spark, args.documents, args.benchmark, args.out, common.load(args.config))
    finally:
        spark.stop()
    return int(args.gate and bool(worse))


if __name__ == "__main__":
    sys.exit(main())
