"""Hybrid retrieval for a table of questions: both legs under the same filters, fusion, fallback, limit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import bm25, dense, fusion
from ..sources import scratch

Reranker = Callable[[DataFrame], DataFrame]


def ranked_lists(chunks: DataFrame, questions: DataFrame, settings: Settings, lists: list[list[str]], *, lexical: bool = True, index: bm25.Lexicon | None = None, texts: DataFrame | None = None) -> DataFrame:
    """list, leg (`dense` or `bm25`), query_id, doc_id, score, rank: the best of each question under each list of filters.

    A list names the columns of both tables that filter it: a question's value, or one of its own list, must be the chunk's;
    null or an empty list is no filter. Every pair is scored once, whatever the number of lists; a pair stands in each list whose
    filters it passes, and a task hands on the k best of each. Written, so that arms and fallbacks read it and don't score again.
    texts: doc_id, text and the filter columns of the same chunks, where they can be had without a join to vectors.
    """
    columns = sorted({c for group in lists for c in group})
    asked = [questions.select(F.struct(F.lit(n).alias("list"), "query_id").alias("task"), "embedding", *[F.col(c) if c in group else F.lit(None).cast(dict(questions.dtypes)[c]).alias(c) for c in columns]) for n, group in enumerate(lists)]
    found = dense.top_k(chunks.select("doc_id", "embedding", *columns), reduce(DataFrame.unionByName, asked), settings.dense_k, groups=columns, query_key="task")
    found = found.select("task.list", F.lit("dense").alias("leg"), "task.query_id", "doc_id", "score", "rank")
    if lexical:
        asked = questions.select("query_id", "query", *columns)
        held = chunks.select("doc_id", *columns) if columns and index else None
        best = bm25.best(index or (chunks if texts is None else texts).select("doc_id", "text", *columns), asked, settings.bm25_k, lists=lists, held=held)
        found = found.unionByName(best.select("list", F.lit("bm25").alias("leg"), "query_id", "doc_id", "score", "rank"))
    return scratch.written(found, "lists")


def list_of(ranked: DataFrame, number: int, leg: str) -> DataFrame:
    return ranked.where((F.col("list") == number) & (F.col("leg") == leg)).drop("list", "leg")


def legs(chunks: DataFrame, questions: DataFrame, settings: Settings, *, group: list[str] | None = None, lexical: bool = True, index: bm25.Lexicon | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked lists (query_id, doc_id, score, rank) by vectors and by BM25, under the filters of `group`."""
    found = ranked_lists(chunks, questions, settings, [group or []], lexical=lexical, index=index, texts=texts)
    return list_of(found, 0, "dense"), list_of(found, 0, "bm25")


def arms(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), *, measure: str | None = None, year: str | None = None, lexical: tuple[bool, ...] = (True,), rerank: Reranker | None = None, index: bm25.Lexicon | None = None, texts: DataFrame | None = None) -> list[DataFrame]:
    """For each arm (hybrid, or, where `lexical` is false, dense first lists): query_id, doc_id, rank, score, dense_rank, bm25_rank, used_fallback of the final_k best.

    chunks: doc_id, text, embedding (may be null) and the filter columns; questions: query_id, query, embedding and the
    filter columns (values, lists of values, or null for no filter). Where a measure filter leaves fewer than four, the
    list without it (but with the year) follows; that list is hybrid in every arm. `rerank` may reorder and
    drop, but what it adds goes. All arms and both lists come from one scoring. index: postings of the same chunks; texts: see `ranked_lists`.
    """
    group = [c for c in (measure, year) if c]
    lists = [group, [year] if year else []] if measure else [group]
    found = ranked_lists(chunks, questions, settings, lists, lexical=any(lexical) or bool(measure), index=index, texts=texts)
    out = []
    for hybrid in lexical:
        words = list_of(found, 0, "bm25")
        first = fusion.fuse(list_of(found, 0, "dense"), words if hybrid else words.where("false"), settings.rrf_k)
        if measure:
            second = fusion.fuse(list_of(found, 1, "dense"), list_of(found, 1, "bm25"), settings.rrf_k)
            best = fusion.with_fallback(first, second, questions.where(dense.allowed(questions, measure).isNotNull()).select("query_id"))
        else:
            best = first.withColumn("used_fallback", F.lit(False))
        best = rerank(best).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi") if rerank else best
        out.append(best.where(F.col("rank") <= settings.final_k))
    return out


def retrieve(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), *, lexical: bool = True, **options) -> DataFrame:
    """One arm of `arms`."""
    return arms(chunks, questions, settings, lexical=(lexical,), **options)[0]


def best_similarity(chunks: DataFrame, questions: DataFrame, floor: float = 0.35) -> DataFrame:
    """query_id, best_similarity, refused: the cosine of the nearest candidate, and whether it is too low."""
    top = dense.top_k(chunks.where("embedding is not null").select("doc_id", "embedding"), questions.where("embedding is not null").select("query_id", "embedding"), 1)
    joined = questions.select("query_id").join(top.select("query_id", F.col("score").alias("best_similarity")), "query_id", "left")
    return joined.withColumn("refused", F.coalesce(F.col("best_similarity") < floor, F.lit(False)))


def hydrate(ranked: DataFrame, chunks: DataFrame, *columns: Column | str) -> DataFrame:
    return ranked.join(chunks.select("doc_id", *columns), "doc_id")
