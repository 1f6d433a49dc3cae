"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, neighbours of one role are merged by array
functions, and the blocks are joined to one string:

    <|turn|>role\\ntext<|and|>text<|end|>\\n

`<|and|>` stands between the texts of merged turns, so that reading back gives the turns as they were.
The loss mask is an array of (start, length) spans, in characters of the formatted string, one for each
assistant text. Where texts start is a running sum over the turns, before they are collected: one exchange
serves the sum and the collecting, and no step's work grows faster than the turns.

Defined results. Null text: empty. Null role: the role `unknown`. Rows of one conversation are ordered by
(turn, role, text), so ties have one order; repeated rows are turns of their own. Null conv_id: a
conversation of its own. An empty table gives an empty result. Further columns are ignored.
One conversation is one string, so its length is bounded by what a string can hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, AND, END = "<|turn|>", "<|and|>", "<|end|>"
#: What no text may hold as it is. Only the first character is replaced.
CONTROL = {"<|": "\\l|", "</s>": "\\l/s>", "<s>": "\\ls>", "[INST]": "\\sINST]", "[/INST]": "\\s/INST]"}


def escaped(text: Column) -> Column:
    """Backslash becomes \\b first, so that what follows is the only source of \\l and \\s."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONTROL.items(), F.replace(text, F.lit("\\"), F.lit("\\b")))


def unescaped(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\s", "["), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once: what a lambda takes from outside would be worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged(turns: Column) -> Column:
    """Sorted turns to an array of blocks: arrays of neighbouring turns of one role."""

    def blocks(known: Column) -> Column:
        starts = F.filter(F.transform(known, lambda t, i: F.when(t.opens, i + 1)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, j: F.slice(known, i, F.coalesce(F.get(at, j + 1), F.size(known) + 1) - i)))

    return let(turns, blocks)


def format_chats(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans."""
    rows = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", F.row_number().over(order).alias("n"), F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).alias("opens"), escaped(F.col("text")).alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    closing = F.when(F.col("n") > 1, len(END) + 1).otherwise(0)
    before = F.when(F.col("opens"), closing + F.length(head)).otherwise(len(AND))
    sizes = rows.select("*", head.alias("head"), before.alias("before"), F.length("text").alias("length"))
    so_far = F.sum(F.col("before").cast("bigint") + F.col("length")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("conv_id", F.struct("n", "role", "head", "text", "opens", (so_far - F.col("length")).alias("start"), "length").alias("t"))
    chats = sizes.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    block = lambda b: F.concat(F.get(b, F.lit(0)).head, F.array_join(F.transform(b, lambda t: t.text), AND), F.lit(f"{END}\n"))
    formatted = F.array_join(F.transform(merged(F.col("turns")), block), "")
    learned = F.filter("turns", lambda t: t.role == "assistant")
    spans = F.transform(learned, lambda t: F.struct(t.start.cast("int").alias("start"), t.length.alias("length")))
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted conversations parsed again: conv_id, turns (role, text), learned (the assistant texts)."""
    parts = F.split("formatted", "<\\|turn\\|>")
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def turns(b: Column) -> Column:
        at = F.locate("\n", b)
        role = unescaped(b.substr(F.lit(1), at - 1))
        body = b.substr(at + 1, F.length(b) - at - len(END) - 1)
        return F.transform(F.split(body, "<\\|and\\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    # Four bytes a character, so that a span is cut out without counting characters from the start.
    cut = lambda wide, s: F.decode(F.substring(wide, 4 * s.start + 1, 4 * s.length), "UTF-32")
    learned = let(F.encode("formatted", "UTF-32"), lambda wide: F.transform("loss_spans", lambda s: unescaped(cut(wide, s))))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    """What reading back gives, as counts and digests."""
    back = read_back(chats)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
