"""Spelling variants grouped by a symmetric-delete join, in DataFrame functions only.

Every word emits itself and its distinct single deletions. Words that meet at a key are near if one is the key and
the other's deletion, or if both lose the same position; any other two of a key differ by more. That test is part of
the join, so a key with many words hands on near pairs only, each once, and `levenshtein` verifies them. A word's
form is its most frequent near word; roots are found by joining forms with themselves, which doubles the steps
taken each round (an occurrence count grows fivefold a step, so a few rounds do).

Bounds. Occurrences are summed map-side, so a frequent word costs no task more than its share. A key of m code points
stands for at most 90 * (m + 1) words, since letters are 90 in all. A word of L code points has L deletions of L - 1: words
of more than WHOLE code points therefore travel as digests, and their keys are digests too, of the text before and after
a block of sqrt(L) code points and of the block's deletions, so that emitting takes L rows of one size and L ** 1.5 steps.
Vocabulary tables are written to the shared folder; nothing is gathered in one task or the driver.

Defined results. Null and empty texts have no words; so have texts without a run of six letters. A null id counts as the
empty string where it is hashed. Repeated rows count each. Equal counts: the word that is smaller in code-point order
is the form. Words without a near word are their own root. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words up to so many code points are their own keys.
WHOLE = 64


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, damage: int | None = 199) -> DataFrame:
    """word, n of the words that occur often enough.

    damage: where it divides the crc32 of `<id>:<run>`, the run loses one code point, as a misspelling would (None: never).
    Runs shorter than `least_length` can't become words, so the pattern leaves them out.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % damage == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _handle(word: Column) -> Column:
    """What a word is called in pairs: itself, or, if it is long, its digest after a character that no word holds."""
    return F.when(F.length(word) <= WHOLE, word).otherwise(F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256)))


def _part(word: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` (counted from 0)."""
    return F.substring(word, start.cast("int") + 1, length.cast("int"))


def _width(key_length: Column) -> Column:
    """Code points of a block: all of a key that is short, else the square root of its length."""
    return F.when(key_length <= WHOLE, key_length + 1).otherwise(F.ceil(F.sqrt(key_length))).cast("int")


def _key(before: Column, block: Column, after: Column, key_length: Column, number: Column) -> Column:
    whole = F.concat(before, block, after)
    digests = F.concat_ws(",", key_length.cast("string"), number.cast("string"), *[F.md5(c.cast("binary")) for c in (before, block, after)])
    return F.when(key_length <= WHOLE, whole).otherwise(F.concat(F.lit("#"), F.md5(digests.cast("binary"))))


def keys(words: DataFrame) -> DataFrame:
    """key, lo, hi, opens, handle, n: each word by its own text (lo -1) and by its distinct deletions.

    lo to hi: the positions whose loss gives the key, which are a run of one letter. opens: the run begins there, not in an earlier block.
    """
    w, size = F.col("word"), F.length("word")

    def blocks(key_length: Column) -> DataFrame:
        width = _width(key_length)
        number = F.explode(F.sequence(F.lit(0), (F.ceil((key_length + 1) / width) - 1).cast("int")))
        return words.select("word", "n", _handle(w).alias("handle"), key_length.alias("m"), width.alias("s"), number.alias("b"))

    b, s, m = F.col("b"), F.col("s"), F.col("m")
    before = _part(w, F.lit(0), b * s)
    own = blocks(size).select(
        _key(before, _part(w, b * s, s - 1), _part(w, b * s + s - 1, size), m, b).alias("key"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(False).alias("opens"), "handle", "n"
    )
    parts = blocks(size - 1).select("handle", "n", "m", "b", "s", before.alias("before"), _part(w, b * s, s).alias("block"), _part(w, b * s + s, size).alias("after"))
    block, i = F.col("block"), F.col("i")
    heads = F.filter(F.sequence(F.lit(0), F.length(block) - 1), lambda x: (x == 0) | (_part(block, x, F.lit(1)) != _part(block, x - 1, F.lit(1))))
    each = parts.where(F.length(block) > 0).select("*", F.explode(heads).alias("i"))
    rest = _part(block, i + 1, F.length(block))
    run = F.length(rest) - F.length(F.ltrim(rest, _part(block, i, F.lit(1))))
    opens = (i > 0) | (b == 0) | (F.right("before", F.lit(1)) != F.left(block, F.lit(1)))
    deleted = each.select(
        _key(F.col("before"), F.concat(_part(block, F.lit(0), i), rest), F.col("after"), m, b).alias("key"), (b * s + i).cast("int").alias("lo"), (b * s + i + run).cast("int").alias("hi"), opens.alias("opens"), "handle", "n"
    )
    return own.unionByName(deleted)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words, once, that differ by one inserted, deleted or replaced code point. words: word, n."""
    emitted = common.written(keys(words), "deletions")
    side = lambda x: emitted.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("lo", "hi", "opens", "handle", "n")])
    lo_a, hi_a, lo_b, hi_b = map(F.col, ("lo_a", "hi_a", "lo_b", "hi_b"))
    inserted = ((lo_a == -1) & F.col("opens_b")) | ((lo_b == -1) & F.col("opens_a"))
    replaced = (lo_a >= 0) & (lo_b >= 0) & (lo_a <= hi_b) & (lo_b <= hi_a)
    met = side("a").join(side("b"), "key").where((F.col("handle_a") < F.col("handle_b")) & (inserted | replaced)).select("handle_a", "n_a", "handle_b", "n_b")
    long = words.where(F.length("word") > WHOLE).select(_handle(F.col("word")).alias("handle"), "word")
    for x in ("a", "b"):  # short words are their own handles
        met = met.join(long.select(F.col("handle").alias(f"handle_{x}"), F.col("word").alias(f"word_{x}")), f"handle_{x}", "left").withColumn(x, F.coalesce(f"word_{x}", f"handle_{x}"))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. forms: word, form, none null; chains have no circles."""
    now = common.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.dropped(now)
        now = step
        if not now.where("moved").take(1):
            return now.select("word", "root")


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, damage: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word: its near words' number, the most frequent of them if it occurs `ratio` times as often, and the end of that chain."""
    words = common.written(vocabulary(docs, doc_id=doc_id, text=text, least_length=least_length, least_count=least_count, damage=damage), "words")
    pairs = common.written(near_pairs(words), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    fits = -F.col("best.order") >= ratio * F.col("n")
    marked = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n"))
    marked = common.written(marked, "forms")
    ends = roots(marked.where("form is not null").select("word", "form"))
    return marked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
