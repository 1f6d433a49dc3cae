"""Context blocks, citations, refusal gates and the outcome of answering, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Turns query_id, question, context, correction (null in the first pass) into query_id, reply, in batches of its own.
Generate = Callable[[DataFrame], DataFrame]

#: A reply that holds this sentence is a refusal. A fixed value.
REFUSAL = "The public documents in my corpus do not contain the information needed to answer this."
MARKER = r"\[(\d+)\]"


@dataclass(frozen=True)
class Messages:
    """What is shown beside generated answers; projects set their own."""

    low_confidence: str = f"{REFUSAL} Try asking about a specific measure."
    citation_invalid: str = "No answer is shown, since its citations did not all resolve to retrieved passages."
    retrieval_only: str = "No model is configured; the most relevant passages are cited below."
    disclaimer: str = "Summarises public documents; not advice."
    correction: str = "Correction: {problem}. Answer again, citing only markers [1] to [{n}]."


def title(header: Column, doc_id: Column) -> Column:
    """The first part of a chunk's header, or its document's id."""
    inner = F.regexp_replace(header, r"^[\[ \]]+|[\[ \]]+$", "")
    return F.coalesce(F.nullif(F.substring_index(inner, " | ", 1), F.lit("")), doc_id)


def context_block(n: Column, chunk_id: Column, head: Column, measure: Column, year: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.concat_ws(" | ", chunk_id, head, F.coalesce(measure, F.lit("General")), year.cast("string"), url), F.lit("\n"), body)


def contexts(ranked: DataFrame, block: Column, query_key: str = "query_id") -> DataFrame:
    """query_key, context: a query's numbered blocks in order of rank; a query has at most final_k of them."""
    collected = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return ranked.groupBy(query_key).agg(F.array_join(F.transform(collected, lambda b: b.block), "\n\n").alias("context"))


def markers(text: Column) -> Column:
    """All citation markers in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda m: m.cast("int"))


def invalid_markers(text: Column, chunks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(markers(text), lambda m: (m < 1) | (m > chunks))))


def citations_valid(text: Column, chunks: Column) -> Column:
    return (F.size(markers(text)) > 0) & (F.size(invalid_markers(text, chunks)) == 0)


def cited(text: Column, chunks: Column) -> Column:
    """Valid markers in order of first appearance, each once."""
    return F.array_distinct(F.filter(markers(text), lambda m: (m >= 1) & (m <= chunks)))


def cards(replies: DataFrame, ranked: DataFrame, *, reply: str = "reply", query_key: str = "query_id") -> DataFrame:
    """Citation cards: the ranked chunk behind each cited marker. replies: query_key, reply, chunks."""
    wanted = replies.select(query_key, F.posexplode(cited(F.col(reply), F.col("chunks"))).alias("place", "marker"))
    return wanted.join(ranked, (wanted[query_key] == ranked[query_key]) & (wanted.marker == ranked["rank"])).drop(ranked[query_key])


def refused_for_confidence(chunks: Column, similarity: Column, floor: float = 0.35) -> Column:
    return (F.coalesce(chunks, F.lit(0)) == 0) | F.coalesce(similarity < floor, F.lit(False))


def outcome(chunks: Column, similarity: Column, has_model: Column, first: Column, second: Column, floor: float = 0.35) -> Column:
    """answered, retrieval_only, refused_low_confidence, refused_by_model or refused_citation_invalid; `second` is the reply after a correction."""
    after = F.when(F.contains(second, F.lit(REFUSAL)), "refused_by_model").when(citations_valid(second, chunks), "answered").otherwise("refused_citation_invalid")
    return (
        F.when(refused_for_confidence(chunks, similarity, floor), "refused_low_confidence")
        .when(~has_model, "retrieval_only")
        .when(F.contains(first, F.lit(REFUSAL)), "refused_by_model")
        .when(citations_valid(first, chunks), "answered")
        .otherwise(after)
    )


def correction_hint(text: Column, chunks: Column, messages: Messages = Messages()) -> Column:
    bad = invalid_markers(text, chunks)
    named = F.array_join(F.transform(bad, lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), ", ")
    problem = F.when(F.size(bad) > 0, F.concat(F.lit("it cited nonexistent passage(s) "), named)).otherwise("it contained no citation markers at all")
    before, between, after = messages.correction.replace("{problem}", "\0").replace("{n}", "\0").split("\0")
    return F.concat(F.lit(before), problem, F.lit(between), chunks.cast("string"), F.lit(after))


def shown(kind: Column, reply: Column, messages: Messages = Messages()) -> Column:
    """The text of an answer, with the disclaimer that every path carries."""
    body = (
        F.when(kind == "answered", reply)
        .when(kind == "refused_by_model", REFUSAL)
        .when(kind == "refused_low_confidence", messages.low_confidence)
        .when(kind == "refused_citation_invalid", messages.citation_invalid)
        .otherwise(messages.retrieval_only)
    )
    return F.concat(body, F.lit(f"\n\n{messages.disclaimer}"))


def _replies(asked: DataFrame, generate: Generate, name: str) -> DataFrame:
    """One reply for each question, null where the model gave none. Written, so that nothing is generated twice, whatever reads it."""
    given = generate(asked.select("query_id", "question", "context", "correction")).groupBy("query_id").agg(F.min("reply").alias(name))
    return written(asked.select("query_id").join(given, "query_id", "left"), name)


def answers(asked: DataFrame, generate: Generate | None = None, *, floor: float = 0.35, messages: Messages = Messages()) -> DataFrame:
    """query_id, kind, text, reply of every question. asked: query_id, question, context, chunks (their number), similarity (or null).

    Only questions that pass the confidence gate reach the model, and only those whose first reply is no refusal and cites
    badly reach it again, with what was wrong. A reply that still cites badly is never shown. Without a model the passages
    stand alone. reply: the text that counts, or null.
    """
    if generate is None:
        first = second = None
    else:
        open_ = written(asked.where(~refused_for_confidence(F.col("chunks"), F.col("similarity"), floor)).withColumn("correction", F.lit(None).cast("string")), "asked")
        first = _replies(open_, generate, "first")
        reply = F.coalesce("first", F.lit(""))
        wrong = open_.join(first, "query_id").where(~F.contains(reply, F.lit(REFUSAL)) & ~citations_valid(reply, F.col("chunks")))
        second = _replies(wrong.withColumn("correction", correction_hint(reply, F.col("chunks"), messages)), generate, "second")
    rows = asked.select("query_id", "chunks", "similarity")
    for given, name in ((first, "first"), (second, "second")):
        rows = rows.join(given, "query_id", "left") if given is not None else rows.withColumn(name, F.lit(None).cast("string"))
    one, two = F.coalesce("first", F.lit("")), F.coalesce("second", F.lit(""))
    kind = outcome(F.col("chunks"), F.col("similarity"), F.lit(generate is not None), one, two, floor)
    kept = F.when(kind == "answered", F.when(citations_valid(one, F.col("chunks")), F.col("first")).otherwise(F.col("second")))
    rows = rows.select("query_id", kind.alias("kind"), kept.alias("reply"))
    return rows.select("query_id", "kind", shown(F.col("kind"), F.col("reply"), messages).alias("text"), "reply")
