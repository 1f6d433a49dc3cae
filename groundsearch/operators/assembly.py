"""Rows of sections back to nested documents: the inverse of `chunking.sections_of`.

A document's order is that of its rows' positions (m_pos, s_pos), never that of arrival. The rows of a document are brought
together once, by its key; its measures and then its arrays are made there. A document is one row of the result, so that it
meets in one task is its size, not a choice.

Defined results. Documents without sections get empty arrays; a null key has none. Sections of no document, and sections
without a text, go nowhere. Repeated documents each get the sections; repeated sections stay. Rows of equal positions are ordered by
their other fields. An empty table gives an empty result. Columns called `measures` or `general_sections` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NORMALIZED_DOC, PARSERS, SECTION
from ..sources.corpus import CorpusError
from . import parsing

SECTIONS = f"array<{SECTION}>"
MEASURES = f"array<struct<measure_id:string,measure_name:string,sections:{SECTIONS}>>"
#: What a document carries besides its sections.
FIELDS = tuple(f.split()[0] for f in NORMALIZED_DOC.split(", measures ")[0].split(", "))


def _sections(rows: Column) -> Column:
    return F.transform(F.array_sort(rows), lambda s: F.struct(s.kind.alias("kind"), s.heading.alias("heading"), s.text.alias("text"), s.page.alias("page"))).cast(SECTIONS)


def nested(sections: DataFrame, documents: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """`documents` with `measures` and `general_sections` made of `sections`: key, measure_id, measure_name, m_pos, s_pos, kind, heading, text, page. Those of a null measure_id are general."""
    row = F.struct("s_pos", "kind", "heading", "text", "page")
    rows = sections.where("text <> ''").select(key, "measure_id", "measure_name", "m_pos", *["s_pos", "kind", "heading", "text", "page"]).repartition(key)
    measures = rows.groupBy(key, "m_pos", "measure_id", "measure_name").agg(_sections(F.collect_list(row)).alias("sections"))
    general, at = F.col("measure_id").isNull(), F.struct("m_pos", "measure_id", "measure_name", "sections")
    whole = measures.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(~general, at))), lambda m: m.dropFields("m_pos")).alias("measures"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(general, at))), lambda m: m.sections)).alias("general_sections"),
    )
    empty = lambda kind: F.from_json(F.lit("[]"), kind)
    held = documents.drop("measures", "general_sections").join(whole, key, "left")
    return held.withColumns({"measures": F.coalesce(F.col("measures").cast(MEASURES), empty(MEASURES)), "general_sections": F.coalesce(F.col("general_sections").cast(SECTIONS), empty(SECTIONS))})


def parsed(docs: DataFrame) -> DataFrame:
    """Normalised documents of extracted texts: a manifest's columns beside `text`, each parsed as its `parser_id` says.

    A parser that reads no extracted text is an error, which names the documents.
    """
    able = ("technical_notes", "generic_pdf")
    bad = docs.where(~F.coalesce(F.col("parser_id").isin(*able), F.lit(False))).select("doc_id", "parser_id").take(20)
    if bad:
        raise CorpusError(f"no parser of extracted text for {sorted((r.doc_id, r.parser_id) for r in bad)}; of {PARSERS} there are {able}")
    texts = docs.select("doc_id", "text", "parser_id")
    notes, pages = (texts.where(F.col("parser_id") == p) for p in able)
    none = F.lit(None).cast("string")
    columns = ["doc_id", "measure_id", "measure_name", "m_pos", "s_pos", "kind", "heading", "text", "page"]
    general = lambda df, s_pos: df.select("*", none.alias("measure_id"), none.alias("measure_name"), F.lit(0).alias("m_pos"), s_pos.alias("s_pos")).select(columns)
    rows = parsing.note_sections(notes).select(columns)
    rows = rows.unionByName(general(parsing.page_sections(pages), F.col("page")))
    return nested(rows, docs.select(*FIELDS)).select(*FIELDS, "measures", "general_sections")
