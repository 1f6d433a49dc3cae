"""Reciprocal rank fusion of two ranked lists, and what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_id, score, dense_rank, bm25_rank, rank: the sum of 1 / (k + rank) over the lists that hold a document."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = d.join(b, ["query_id", "doc_id"], "full").withColumn("score", part("dense_rank") + part("bm25_rank"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id"))
    return both.withColumn("rank", order)


def with_fallback(first: DataFrame, second: DataFrame, filtered: DataFrame, least: int = 4) -> DataFrame:
    """Where a query with a filter found fewer than `least`, the unfiltered list's other documents follow, in their order.

    filtered: query_id of the queries whose filter was set. Adds used_fallback; ranks run on and scores may rise again.
    """
    counts = filtered.select("query_id").join(first.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left")
    starved = counts.where(F.coalesce("found", F.lit(0)) < least).select("query_id")
    more = second.join(starved, "query_id", "left_semi").join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = first.withColumn("turn", F.lit(0)).unionByName(more.withColumn("turn", F.lit(1)))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "rank"))
    flags = starved.withColumn("used_fallback", F.lit(True))
    return both.withColumn("rank", order).drop("turn").join(flags, "query_id", "left").withColumn("used_fallback", F.coalesce("used_fallback", F.lit(False)))
