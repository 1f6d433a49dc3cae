"""Sections to bounded, overlapping, content-addressed chunks, by array expressions within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = "struct<text:string,tokens:int>"
STATE = f"struct<windows:array<string>,units:array<{UNIT}>,tokens:int>"


def most_words(max_tokens: int) -> int:
    return max(int(max_tokens / 1.3), 1)


def word_windows(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Windows of max_tokens / 1.3 words, each overlapping the last by overlap_tokens / 1.3."""
    most = most_words(max_tokens)
    step = max(most - int(overlap_tokens / 1.3), 1)
    found = T.words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(step))
    return F.when(F.size(found) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, F.lit(most)), " ")))


def units(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Sentences and bullets; one of too many words becomes word windows. Long characters alone are left to `bounded`."""
    split = F.filter(F.transform(F.split(text, r"(?U)(?<=[.;])\s+|\n(?=[•-])"), T.stripped), lambda u: u != "")
    sized = F.flatten(F.transform(split, lambda u: F.when(F.size(T.words(u)) > most_words(max_tokens), word_windows(u, max_tokens, overlap_tokens)).otherwise(F.array(u))))
    return F.transform(sized, lambda u: F.struct(u.alias("text"), T.token_estimate(u).alias("tokens")).cast(UNIT))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda u: u.text), " ")


def _carried(found: Column, overlap_tokens: int) -> Column:
    """The last units whose tokens add up to no more than the overlap."""
    kind = f"struct<units:array<{UNIT}>,tokens:int,open:boolean>"
    zero = F.expr(f"cast(named_struct('units', array(), 'tokens', 0, 'open', true) as {kind})")

    def step(s: Column, u: Column) -> Column:
        fits = s.open & (s.tokens + u.tokens <= overlap_tokens)
        return (
            F.when(fits, F.struct(F.concat(F.array(u), s.units).alias("units"), (s.tokens + u.tokens).alias("tokens"), F.lit(True).alias("open")))
            .otherwise(F.struct(s.units.alias("units"), s.tokens.alias("tokens"), F.lit(False).alias("open")))
            .cast(kind)
        )

    return F.aggregate(F.reverse(found), zero, step, lambda s: s.units)


def packed(found: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Greedy windows of units; each new window begins with the units carried over."""
    zero = F.expr(f"cast(named_struct('windows', array(), 'units', array(), 'tokens', 0) as {STATE})")

    def add(windows: Column, before: Column, u: Column) -> Column:
        tokens = F.aggregate(before, F.lit(0), lambda n, x: n + x.tokens) + u.tokens
        return F.struct(windows.alias("windows"), F.concat(before, F.array(u)).alias("units"), tokens.alias("tokens")).cast(STATE)

    def step(s: Column, u: Column) -> Column:
        full = (F.size(s.units) > 0) & (s.tokens + u.tokens > max_tokens)
        return F.when(full, add(F.concat(s.windows, F.array(_joined(s.units))), _carried(s.units, overlap_tokens), u)).otherwise(add(s.windows, s.units, u))

    return F.aggregate(found, zero, step, lambda s: F.when(F.size(s.units) > 0, F.concat(s.windows, F.array(_joined(s.units)))).otherwise(s.windows))


def bounded(windows: Column, max_tokens: int) -> Column:
    """Windows still too long are cut by characters."""
    size = max_tokens * 4

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(w) - 1, F.lit(0)), F.lit(size))
        pieces = F.filter(F.transform(starts, lambda i: T.stripped(w.substr(i + 1, F.lit(size)))), lambda p: p != "")
        return F.when(T.token_estimate(w) > max_tokens, pieces).otherwise(F.array(w))

    return F.flatten(F.transform(windows, cut))


def split_text(text: Column, max_tokens: int = 480, overlap_tokens: int = 64) -> Column:
    """A section's chunks. One that fits stays as it is."""
    found = units(text, max_tokens, overlap_tokens)
    return F.when(T.token_estimate(text) <= max_tokens, F.array(text)).otherwise(bounded(packed(found, max_tokens, overlap_tokens), max_tokens))


def header(title: Column, measure_id: Column, measure_name: Column, heading: Column, year: Column) -> Column:
    measure = F.when(measure_id.isNull(), F.lit("General")).otherwise(F.concat_ws(" ", measure_id, measure_name))
    return F.concat(F.lit("["), F.concat_ws(" | ", title, measure, heading, year.cast("string")), F.lit("]"))


def sections_of(docs: DataFrame) -> DataFrame:
    """Normalised documents to rows of sections in reading order: measures first, then general ones."""
    base = ["doc_id", "title", "plan_year", "license_posture", "source_url"]
    measured = docs.select(*base, F.posexplode("measures").alias("m_pos", "m")).select(*base, F.col("m.measure_id"), F.col("m.measure_name"), "m_pos", F.posexplode("m.sections").alias("s_pos", "s"))
    general = docs.select(*base, F.lit(None).cast("string").alias("measure_id"), F.lit(None).cast("string").alias("measure_name"), F.lit(2**31 - 1).alias("m_pos"), F.posexplode("general_sections").alias("s_pos", "s"))
    return measured.unionByName(general).select(*base, "measure_id", "measure_name", "m_pos", "s_pos", "s.*")


def chunk_documents(docs: DataFrame, *, max_tokens: int = 480, overlap_tokens: int = 64) -> DataFrame:
    """Chunks of normalised documents; of equal chunk ids the first in reading order stays."""
    pieces = sections_of(docs).select("*", F.posexplode(split_text(F.col("text"), max_tokens, overlap_tokens)).alias("c_pos", "piece"))
    made = pieces.select(
        T.chunk_id(F.col("doc_id"), F.col("measure_id"), F.col("kind"), F.col("piece")).alias("chunk_id"),
        "doc_id", "measure_id", "measure_name", F.col("kind").alias("section"),
        header(F.col("title"), F.col("measure_id"), F.col("measure_name"), F.col("heading"), F.col("plan_year")).alias("header"),
        F.col("piece").alias("text"), "plan_year", "license_posture", "source_url", "page", F.struct("m_pos", "s_pos", "c_pos").alias("place"),
    )
    return keep_first(made, "chunk_id", "place").drop("place")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("n", first).where(F.col("n") == 1).drop("n")


def embed_text(head: Column, text: Column) -> Column:
    return F.concat_ws("\n", head, text)
