"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are runs of word characters, case-folded; in scripts that put no spaces between words, each
character is a token. A document and an item are compared only if they share a seed, a string of `min_match` tokens (of
all tokens of an item that has fewer), found by Karp-Rabin hashes of the document's windows among those of the
items. Tiling then marks, again and again, the longest matches of unmarked tokens that do not overlap, until none as
long as the seed is left: Karp-Rabin hashes of one length run over both texts, and the length
falls from round to round to the longest that still matches; tokens decide. The share of an item's tokens that is
marked is its coverage: passages that were cut up and put in another order are covered piece by piece. A document
is contaminated if any item's coverage reaches `threshold`.

Items are broadcast in blocks of at most about `block_bytes` of text, with one pass over the documents for each
block; between passes documents are written, so a worker holds one block whatever the benchmark's size. With one
block documents are neither shuffled, written nor cut.

Defined results. Null or empty text: no overlap. Null text or id of an item, or an item without tokens: it takes no
part. An item of fewer than `min_match` tokens is covered whole or not at all. Repeated items count as one each; repeated documents each get their result. Ties for
the best item go to the smallest id. An empty table gives an empty result. All columns of the documents stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, frugal, tidy, written

BASE = np.uint64(0x100000001B3)
OVERLAPS = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<doc_start:int,item_start:int,length:int>>>>"
#: Scripts written without spaces: Thai to Myanmar, Khmer, kana, Han (with its supplementary planes). Fixed ranges.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"(?=\w)[{UNSPACED}]|[^\W{UNSPACED}]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hashes of all windows of n tokens, modulo 2^64."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * BASE + ids[i : len(ids) - n + 1 + i].astype(np.uint64)
    return out


class Running:
    """Karp-Rabin hashes of windows of any length over one text, and which tokens are still unmarked."""

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        self.ids, self.free = ids, free
        steps = [np.full(len(ids), s, np.uint64) for s in (int(BASE), pow(int(BASE), -1, 1 << 64))]
        up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(s, dtype=np.uint64))) for s in steps)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of unmarked tokens."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        starts = np.flatnonzero(taken[size:] == taken[:-size]) if size <= len(self.ids) else np.empty(0, np.int64)
        return starts, (self.total[starts + size] - self.total[starts]) * self.down[starts]


def tile(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length) of n tokens or more, longest first, ties from the left of the document. A token 0 matches nothing."""
    left, right = Running(doc, doc != 0), Running(item, item != 0)
    tiles: list[tuple[int, int, int]] = []

    def met(size: int) -> bool:
        return bool(np.isin(left.windows(size)[1], right.windows(size)[1]).any())

    high = min(len(doc), len(item))
    while high >= n and met(n):
        low = n  # the longest common length: what matches at a length does at all shorter ones
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if met(middle) else (low, middle - 1)
        (t, a), (p, b) = left.windows(low), right.windows(low)
        order = np.argsort(b, kind="stable")
        p, b = p[order], b[order]
        first, last = np.searchsorted(b, a), np.searchsorted(b, a, "right")
        found = 0
        for start, i, j in zip(t[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
            if not left.free[start : start + low].all():
                continue
            for at in p[i:j].tolist():
                if right.free[at : at + low].all() and np.array_equal(doc[start : start + low], item[at : at + low]):
                    left.free[start : start + low] = right.free[at : at + low] = False
                    tiles.append((start, at, low))
                    found += 1
                    break
        high = low if found else low - 1  # hashes that agree by chance
    return sorted(tiles, key=lambda x: x[1])


class Items:
    """A block of benchmark items: vocabulary, token ids, and by seed length the items of each seed hash."""

    def __init__(self, texts: list[tuple[int, str]], n: int):
        self.vocabulary, self.items = {}, []
        seeds = defaultdict(lambda: defaultdict(set))
        for item, text in sorted(set(texts)):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], dtype=np.int64)
            if not len(ids):
                continue
            size = min(n, len(ids))
            hashes = window_hashes(ids, size)
            for h in hashes.tolist():
                seeds[size][h].add(len(self.items))
            self.items.append((item, ids, size, hashes))
        self.seeds = {size: dict(of) for size, of in sorted(seeds.items())}
        self.hashes = {size: np.sort(np.array(list(of), dtype=np.uint64)) for size, of in self.seeds.items()}

    def shared(self, ids: np.ndarray, run: np.ndarray, size: int) -> list[int]:
        """The seed hashes of one length that stand in a text. run: unknown tokens before each place."""
        whole = np.flatnonzero(run[size:] == run[:-size]) if size < len(run) else np.empty(0, np.int64)  # windows of known words only
        h = np.zeros(len(whole), np.uint64)
        for i in range(size):
            h = h * BASE + ids[whole + i].astype(np.uint64)
        known = self.hashes[size]
        return np.unique(h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]).tolist()

    def overlaps(self, text: str, least: float) -> list[dict]:
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in tokens(text)], dtype=np.int64)
        run = np.concatenate(([0], np.cumsum(ids == 0)))
        found = {size: set(self.shared(ids, run, size)) for size in self.seeds}
        touched = {at for size, keys in found.items() for key in keys for at in self.seeds[size][key]}
        out = []
        for at in sorted(touched):
            item, item_ids, size, hashes = self.items[at]
            reach = np.zeros(len(item_ids), bool)  # no tiling can cover more
            for p, key in enumerate(hashes.tolist()):
                if key in found[size]:
                    reach[p : p + size] = True
            if reach.mean() < least:
                continue
            tiles = tile(ids, item_ids, size)
            coverage = sum(t[2] for t in tiles) / len(item_ids)
            if coverage >= least:
                out.append({"item_id": item, "coverage": coverage, "tiles": [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in tiles]})
        return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, min_match: int = 4, block_bytes: int = 16_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "overlaps") -> DataFrame:
    """`docs` with a further column: the items covered to `threshold` or more, with coverage and tiles, by item id."""
    if not 0 < threshold <= 1 or min_match < 1:
        raise ValueError("threshold must lie in (0, 1] and min_match must be positive")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    frugal(docs.sparkSession)
    keep = docs.columns
    at = keep.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.expr(f"cast(array() as {OVERLAPS})").alias("overlaps"))
    for block in range(blocks):
        if block:  # else all blocks would stand in one stage's workers
            now = written(rows, "overlaps")
            if block > 1:
                dropped(before)
            rows = before = now
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in held])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, min_match)
            for batch in batches:
                found = [before + known.overlaps(text or "", threshold) for text, before in zip(pa.compute.struct_field(batch.column(0), [at]).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield batch.set_column(1, "overlaps", pa.array(found, batch.schema.field(1).type))

        rows = rows.mapInArrow(tidy(run), T.StructType(rows.schema.fields))
    found = F.array_sort("overlaps")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in keep], found.alias(into))
