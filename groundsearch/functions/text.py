"""Text expressions. All are built from Spark functions and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"(?U)\W+"
SPACE = r"(?U)\s+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters, in order, with duplicates."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """The larger of 1.3 tokens a word and a token for four characters."""
    return F.greatest(F.floor(F.size(words(text)) * F.lit(1.3)), F.floor(F.length(text) / 4)).cast("int")


def normalized_block(text: Column) -> Column:
    """Wrapped lines joined; bullets keep lines of their own; page marks, runs of blanks and spaced hyphens go."""
    unmarked = F.regexp_replace(text, "\\x00PAGE:(\\d+)\\x00", " ")
    lines = F.filter(F.transform(F.split(unmarked, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), stripped), lambda x: x != "")
    is_bullet = lambda x: x.startswith("•") | x.startswith("-") | x.startswith("–")
    flat = F.array_join(F.transform(lines, lambda x: F.concat(F.when(is_bullet(x), F.lit("\n")).otherwise(F.lit(" ")), x)), "")
    flat = F.regexp_replace(F.regexp_replace(flat, "[ \\t]{2,}", " "), r"(?U)•\s+", "• ")
    return stripped(F.regexp_replace(flat, "(?<=[A-Za-z0-9]) ?- ?(?=[A-Za-z0-9])", "-"))


def snippet(text: Column, committable: Column, limit: int = 40) -> Column:
    """All of a text that may be redistributed; else its first words."""
    found = words(text)
    return F.when(committable | (F.size(found) <= limit), text).otherwise(F.concat(F.array_join(F.slice(found, 1, limit), " "), F.lit(" …")))


def chunk_id(doc: Column, measure: Column, section: Column, text: Column) -> Column:
    """The id hashes a null measure as `None` and shows it as `doc`."""
    digest = F.sha2(F.concat_ws("|", doc, F.coalesce(measure, F.lit("None")), section, text), 256)
    return F.concat_ws(":", doc, F.coalesce(measure, F.lit("doc")), section, F.substring(digest, 1, 16))
