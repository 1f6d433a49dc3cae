"""Which texts hold which passages, verbatim: a substring join without comparing all pairs.

A text that holds a passage holds the passage's inner tokens whole (its first and last may be parts of the text's
words). The rarest inner token of each passage meets postings, so candidates number its document frequency; `contains`
then decides on the texts themselves. A passage with fewer than three tokens has no inner one: those few are compared
with all texts, BLOCK of them at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import written
from .bm25 import BROADCAST_ROWS, Lexicon

BLOCK = 1000


def candidates(passages: DataFrame, lexicon: Lexicon, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """A passage (its key and text) with the key of each text that holds its rarest inner token. A passage with a token that no text holds has none."""
    found = tokens(F.col(text))
    inner = passages.select(key, text).distinct().select(key, text, F.array_distinct(F.slice(found, F.lit(2), F.greatest(F.size(found) - 2, F.lit(0)))).alias("inner"))
    each = inner.select(key, text, F.size("inner").alias("n"), F.explode("inner").alias("token")).join(lexicon.terms.select("token", "df"), "token")
    rarest = each.groupBy(key, text, "n").agg(F.count("*").alias("known"), F.min(F.struct("df", "token")).alias("rarest")).where("known = n").select(key, text, F.col("rarest.token").alias("token"))
    rarest = written(rarest, "rarest")
    held, asked = lexicon.postings.select(lexicon.key, F.explode("terms.token").alias("token")), rarest.select("token").distinct()
    if asked.count() <= BROADCAST_ROWS:  # then no other token of the postings is shuffled
        held = held.join(F.broadcast(asked), "token", "left_semi")
    return held.join(rarest, "token").select(key, text, lexicon.key)


def holding(passages: DataFrame, docs: DataFrame, lexicon: Lexicon, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """The key of a passage and of each text that holds it. Both tables have their text in a column of one name; null and empty passages are held by none. Repeated rows of passages count once, those of texts each."""
    asked = passages.where(F.length(text) > 0).select(key, F.col(text).alias("passage")).distinct()
    size = F.size(tokens(F.col("passage")))
    long, short = asked.where(size >= 3), asked.where(size < 3)
    pairs = candidates(long, lexicon, key=key, text="passage")
    found = pairs.join(docs.select(lexicon.key, text), lexicon.key).where(F.contains(text, F.col("passage"))).select(key, lexicon.key)
    blocks = -(-short.count() // BLOCK)
    few = [short.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == n) for n in range(blocks)]
    return reduce(DataFrame.unionByName, [docs.join(F.broadcast(b), F.contains(text, F.col("passage"))).select(key, lexicon.key) for b in few], found)
