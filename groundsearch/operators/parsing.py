"""Extracted document text to measures and labelled sections.

The text of a document holds page marks (NUL PAGE:n NUL). Headings, fields and pages are found by cutting the text at
marks that are put before them, so that everything stays in Spark expressions. Characters of a text that are such marks are
escaped before and restored after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_block

#: Field labels and the kinds of their sections. Fixed values.
FIELD_KINDS = {
    "Metric": "description",
    "HEDIS Label": "description",
    "Measure Reference": "description",
    "Label for Stars": "description",
    "Title": "description",
    "Description": "description",
    "Numerator": "numerator",
    "Denominator": "denominator",
    "Exclusions": "exclusions",
    "Data Time Frame": "timeline",
    "Data Display": "general",
    "Data Source": "coding",
    "Primary Data Source": "coding",
    "Data Source Category": "coding",
    "General Trend": "general",
    "Statistical Method": "general",
    "Weighting Category": "general",
    "Weighting Value": "general",
    "Improvement Measure": "general",
    "Reporting Requirements": "general",
    "General Notes": "general",
    "Historical Notes": "general",
    "NQF": "general",
    "Metric Notes": "general",
}
#: How labels, headings of measures and dot leaders look. Fixed values.
LABEL = r"(?m)^[ \t]*(" + "|".join(label.replace(" ", r"\s+") for label in FIELD_KINDS) + r")\s*:\s*"
HEADING = r"(?m)^[ \t]*Measure:\s*([CD]\d{2})\s*[-–—:]\s*(.+?)[ \t]*$"
DOTS = r"\.{5,}"
CUT, PART, ESCAPE = "␞", "␟", "␛"


def escaped(text: Column) -> Column:
    for n, mark in enumerate((ESCAPE, CUT, PART)):
        text = F.replace(text, F.lit(mark), F.lit(f"{ESCAPE}{n}"))
    return text


def restored(text: Column) -> Column:
    for n, mark in ((2, PART), (1, CUT), (0, ESCAPE)):
        text = F.replace(text, F.lit(f"{ESCAPE}{n}"), F.lit(mark))
    return text


def _bound(value: Column, then) -> Column:
    """`then` of a value computed once: an expression that stands several times inside an array function is computed as often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, r"(?U)\s+", " "))


def fields(block: Column) -> Column:
    """Array of (label, text). Text before the first label, if there is any, is `Body`; a block without labels is one."""
    cut = F.split(F.regexp_replace(escaped(block), LABEL, f"{CUT}$1{PART}"), CUT)

    def of(cut: Column) -> Column:
        labelled = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda p: F.struct(canonical_label(F.substring_index(p, PART, 1)).alias("label"), restored(p.substr(F.locate(PART, p) + 1, F.length(p))).alias("text")))
        body = F.array(F.struct(F.lit("Body").alias("label"), restored(F.get(cut, F.lit(0))).alias("text")))
        return F.when(F.length(F.get(cut, F.lit(0))) > 0, F.concat(body, labelled)).otherwise(F.when(F.size(cut) == 1, body).otherwise(labelled))

    return _bound(cut, of)


def section_kind(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FIELD_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), F.lit("general"))


def is_body_heading(name: Column, following: Column) -> Column:
    """Not a line of a table of contents: no dot leader in the name, and a field label soon after, before any dot leader."""
    window = escaped(F.substring(following, 1, 1500))
    label_at = F.length(F.get(F.split(F.regexp_replace(window, LABEL, CUT), CUT), F.lit(0)))
    dots_at = F.length(F.get(F.split(F.regexp_replace(window, DOTS, CUT), CUT), F.lit(0)))
    return ~F.regexp_like(name, F.lit(DOTS)) & F.regexp_like(window, F.lit(LABEL)) & (~F.regexp_like(window, F.lit(DOTS)) | (label_at < dots_at))


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, blocks, page, head (id, name), body: what runs from each body heading to the next, over rejected ones; block 0 stands before the first, blocks is the last one's number. Its page is that of the last page mark before its heading."""
    cut = F.split(F.regexp_replace(escaped(F.col(text)), HEADING, f"{CUT}$1{PART}$2{PART}$0{PART}"), CUT)
    parts = docs.select(key, F.posexplode(F.transform(cut, lambda part: F.transform(F.split(part, PART), restored))).alias("pos", "pieces"))
    piece, body = (lambda n: F.get("pieces", F.lit(n))), F.element_at("pieces", -1)
    mark = F.try_element_at(F.regexp_extract_all(F.array_join("pieces", PART), F.lit("\\x00PAGE:(\\d+)\\x00"), F.lit(1)), F.lit(-1))
    is_head = F.col("pos") > 0
    parts = parts.select(key, "pos", mark.alias("mark"), F.array(piece(0), piece(1)).alias("head"), piece(2).alias("line"), body.alias("body"), (is_head & is_body_heading(piece(1), body)).alias("real"))
    by_doc = Window.partitionBy(key).orderBy("pos")
    last_mark = F.last("mark", ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(key, "pos", "head", "line", "body", "real", last_mark.cast("int").alias("page"), F.sum(F.col("real").cast("int")).over(by_doc).cast("int").alias("block"))
    whole = F.when(F.col("real") | ~is_head, F.col("body")).otherwise(F.concat("line", "body"))
    return (
        parts.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", whole.alias("body")))).alias("bodies"), F.min_by("page", "pos").alias("page"), F.min_by(F.when(F.col("real"), F.col("head")), "pos").alias("head"))
        .select(key, "block", F.max("block").over(Window.partitionBy(key)).alias("blocks"), "page", "head", F.array_join(F.transform("bodies", lambda b: b.body), "").alias("body"))
    )


def note_sections(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measure_id, measure_name, page, m_pos, s_pos, kind, heading, text: the sections of each measure in a marked text, and its introduction, whose measure is null. Texts are cut once for both."""
    body, number = F.col("body"), F.col("block")
    clean = lambda label, said: F.struct(label.alias("label"), normalized_block(said).alias("text"))
    before = F.when(F.locate(CONTENTS, body) > 1, F.substring_index("body", CONTENTS, 1)).otherwise(body)
    # Normalised where they are made: a filter on a generated column is no second computation of it.
    found = F.when(number > 0, F.transform(fields(body), lambda f: clean(f.label, f.text))).when(F.col("blocks") > 0, F.array(clean(F.lit("Introduction"), before)))
    made = _blocks(docs, key, text).select(key, "block", "page", "head", F.posexplode(found).alias("s_pos", "f")).where("f.text <> ''")
    page, m_pos = F.when(number > 0, F.col("page")).otherwise(1), F.greatest(number - 1, F.lit(0))
    name = F.when(number > 0, normalized_block(F.get("head", F.lit(1))))
    return made.select(key, F.when(number > 0, F.get("head", F.lit(0))).alias("measure_id"), name.alias("measure_name"), page.alias("page"), m_pos.alias("m_pos"), "s_pos", section_kind(F.col("f.label")).alias("kind"), F.col("f.label").alias("heading"), F.col("f.text").alias("text"))


def measure_sections(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measure_id, measure_name, page, m_pos, s_pos, kind, heading, text: the sections of each measure in a marked text."""
    return note_sections(docs, key=key, text=text).where("measure_id is not null")


#: The first line of a table of contents. A fixed value.
CONTENTS = "Measure: C01"


def introductions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, heading, text, page: what stands before the first measure, cut where the table of contents begins. Texts without a measure have none."""
    return note_sections(docs, key=key, text=text).where("measure_id is null").select(key, "kind", "heading", "text", "page")


def page_sections(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One general section for each page with text: key, kind, heading, text, page."""
    parts = F.transform(F.split(F.col(text), "\\x00PAGE:\\d+\\x00"), normalized_block)
    pages = docs.select(key, F.posexplode(parts).alias("page", "text")).where("page > 0 and text <> ''")
    return pages.select(key, F.lit("general").alias("kind"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("heading"), "text", "page")
