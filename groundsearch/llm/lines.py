"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on its host if it stands on more than `max_ratio` of the host's pages and on at least
`min_pages` of them. Boilerplate lines are dropped from every page of that host.

A page's lines are made distinct before they are counted, and counts are summed map-side, so that a host or
a line with a third of all rows costs no task more than its share. Lines travel as 128-bit digests. A host
has at most (mean distinct lines of its pages / max_ratio) boilerplate lines, which bounds the array that
joins its pages. The table of these arrays is written, measured, and broadcast up to BROADCAST_BYTES, so that
pages are not shuffled at all; beyond it is joined by host, where Spark splits the pages of a frequent host.

Defined results. Lines are compared without leading and trailing ASCII white space; empty lines always stay.
A host of fewer than `min_pages` pages loses no line. The column of counts has underscores before its name if there is one so called.
Null text: it stays null. Null host: those pages form one host. Repeated rows are pages of their own.
A page that loses all its lines stays with an empty text. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BROADCAST_BYTES = 16_000_000
SPACE = " \t\n\x0b\f\r"
#: Tags inside a line of text; all others end the line.
INLINE_TAGS = r"(?i)</?(?:a|abbr|b|code|em|i|small|span|strong|sub|sup|u)(?:\s[^>]*)?>"
BLOCKS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def html_lines(html: Column) -> Column:
    """The text of a page: inline tags vanish, scripts, styles, comments and other tags become line ends."""
    return F.regexp_replace(F.regexp_replace(html, INLINE_TAGS, ""), BLOCKS, "\n")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def bare(line: Column) -> Column:
    """Without leading and trailing ASCII white space."""
    return F.trim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(bare(line).cast("binary")))


def drop_boilerplate(df: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 5, copies: bool = True, into: str = "line_stats") -> DataFrame:
    """`df` with `text` less its boilerplate lines, and a further column with the counts `n_lines` and `n_dropped`.

    Without `copies`, pages of one host and text count as one page, and a page that would lose all its lines keeps them:
    lines of a text that was copied often are no boilerplate, which stands around other text.
    """
    if not 0 < max_ratio < 1:
        raise ValueError("max_ratio must lie between 0 and 1")
    into = common.fresh(df, into)
    key = F.struct(F.col(host).alias("host"))
    pages = df.select(key.alias("site"), F.split(text, "\n").alias("lines"))
    distinct = F.array_distinct(F.transform(F.filter("lines", lambda x: bare(x) != ""), _key))
    if copies:
        seen = pages.select("site", F.explode(distinct).alias("line"))
        counted = pages
    else:  # summed map-side too, so copies of a page cost no task more than its share
        digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("page")
        pages = df.select(key.alias("site"), F.split(text, "\n").alias("lines"), digest)
        seen = pages.select("site", "page", F.explode(distinct).alias("line")).distinct()
        counted = pages.select("site", "page").distinct()
    seen = seen.groupBy("site", "line").agg(F.count("*").alias("pages"))
    totals = counted.groupBy("site").agg(F.count("*").alias("total"))
    bad = (
        seen.where(F.col("pages") >= min_pages)
        .join(totals, "site")
        .where(F.col("pages") > max_ratio * F.col("total"))
        .groupBy("site")
        .agg(F.collect_list("line").alias("boilerplate"))
    )
    bad = common.written(bad, "boilerplate")
    size = bad.agg(F.sum(16 * F.size("boilerplate") + F.coalesce(F.octet_length("site.host"), F.lit(0)) + 32)).first()[0] or 0
    bad = F.broadcast(bad) if size <= BROADCAST_BYTES else bad
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("site")).join(bad, "site", "left")
    lines = F.split(F.col("row").getField(text), "\n")
    kept = F.when(F.col("boilerplate").isNull(), lines).otherwise(F.filter(lines, lambda x: (bare(x) == "") | ~F.array_contains("boilerplate", _key(x))))
    rows = rows.select("row", lines.alias("lines"), kept.alias("kept"))
    if not copies:
        rows = rows.select("row", "lines", F.when(F.exists("kept", lambda x: bare(x) != ""), F.col("kept")).otherwise(F.col("lines")).alias("kept"))
    stats = F.struct(F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), (F.coalesce(F.size("lines"), F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).cast("bigint").alias("n_dropped"))
    out = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    return rows.select(*out, stats.alias(into))


def dedup_pages(pages: DataFrame, *, max_ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """Lines of raw web pages, by the host of their url: page_id, host, text, n_lines, n_dropped. Two pages are the least that show a line to be the site's."""
    text = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), F.regexp_replace(html_lines(F.col("html")), "[ \\t\\r\\f]*\n[ \\t\\r\\f\n]*", "\n").alias("text"))
    done = drop_boilerplate(text, text="text", host="host", max_ratio=max_ratio, min_pages=min_pages)
    return done.select("page_id", "host", "text", "line_stats.n_lines", "line_stats.n_dropped")
