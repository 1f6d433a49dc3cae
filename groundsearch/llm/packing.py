"""Packing of tokenised documents into windows by best-fit decreasing.

A document of n tokens is cut into full windows and one rest. The rests are packed best-fit decreasing: the
next longest piece goes to the open window with the least room that still holds it, found in a segment tree
indexed by remaining capacity. What the packer decides depends on lengths alone, and pieces of one length are
alike, so it runs over the histogram of lengths: at most `window` lengths, whatever the number of documents.
Windows of equal content history are kept as runs of consecutive sequence ids, and each length's pieces are
assigned to runs by their rank among the pieces of that length.

Bounds. Each length splits at most one run and opens at most two, and a run that takes part loses at least
half its room, so there are under 2 * window * (2 + log2(window)) assignments (about 50,000 for 2,048): these
are broadcast. Ranks come from counts per (block of documents, length), so no task ranks all pieces of a
frequent length.

Defined results. Null text: empty, which is one piece holding only the end token. Null ids and repeated rows
are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy, worker_store
from .slots import Slots, WordHasher

#: Entries of the per-worker caches of words and of their pieces; each is emptied when full.
CACHE_WORDS, CACHE_PIECES = 500_000, 200_000
#: Characters that Python and the tokenizer might treat apart, and what control tokens begin with.
UNLIKE = re.compile("[^\t\n\r -~\u00a1-\u012f\u0131-\u024f]|<\\|")
#: Line ends, which part words, contractions, letter runs, single digits, runs of signs.
PIECE = re.compile("\n|'(?:s|t|re|ve|m|ll|d)|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\s\\w]|_)+")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class SegmentTree:
    """Which remaining capacities have open windows; `tightest(n)` is the least such capacity of at least n."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Assignments (length, first rank, pieces, first sequence, pieces for each sequence, first offset), and the number of sequences.

    The piece of rank r within an assignment goes to sequence first + (r - rank) // per at offset + ((r - rank) % per) * length.
    """
    tree = SegmentTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # capacity -> (first sequence, number of sequences)
    out, sequences = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per = window // length
                n = -(-left // per)
                put(window, sequences, n)
                sequences += n
                capacity = window
            first, n = runs[capacity].pop()
            if not runs[capacity]:
                del runs[capacity]
                tree.mark(capacity, False)
            per = capacity // length
            full = min(n, left // per)
            taken = full * per
            rest = left - taken if full < n else 0
            out.append((length, rank, taken + rest, first, per, window - capacity))
            put(capacity - per * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
                put(capacity, first + full + 1, n - full - 1)
            else:
                put(capacity, first + full, n - full)
            left -= taken + rest
            rank += taken + rest
    return out, sequences


class WordTokenizer:
    """Texts to little-endian 32-bit ids, for a tokenizer that lower-cases, drops white space and keeps letter runs apart.

    Words are kept by two hashes; new ones are cut where the tokenizer itself cuts: into letter runs, contractions,
    digits and runs of signs. Each distinct piece is encoded once and kept; new letter runs are encoded a hundred at
    a time, as one text, and told apart by the tokens that end words. Cutting and case folding by Python are used for characters below U+0250
    only, where both agree; other words, and those that may hold a control token, are encoded as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.hasher = WordHasher()
        self.forget()

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        runs = [p for p in new if p.isalpha()]
        for piece in new:
            if not piece.isalpha() and piece != "\n":
                self.kept[piece] = self.one(piece.removeprefix("\0"))
        for at in range(0, len(runs), 100):
            part = runs[at : at + 100]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                data, start = ids.tobytes(), 0
                for run, stop in zip(part, (4 * stops).tolist(), strict=True):
                    self.kept[run] = data[start:stop]
                    start = stop
            else:
                self.kept.update((run, self.one(run)) for run in part)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's number of ids."""
        text = b"\n".join(words).decode("utf-8", "replace")
        if UNLIKE.search(text):
            cut = []
            for word in text.split("\n"):
                cut += [f"\0{word}"] if UNLIKE.search(word) else PIECE.findall(word.lower())
                cut.append("\n")
        else:
            cut = PIECE.findall(text.lower())
            cut.append("\n")
        new = set(cut).difference(self.kept)
        if len(self.kept) + len(new) > CACHE_PIECES:
            self.kept = {}
            new = set(cut)
        self.learn(list(new))
        self.kept["\n"] = b""
        ids = [self.kept[p] for p in cut]
        last = np.flatnonzero(np.array([p == "\n" for p in cut]))
        total = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last] // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.diff(total, prepend=0)

    def forget(self) -> None:
        self.table, self.check = Slots(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS + 1, np.uint64)
        self.size, self.start, self.flat, self.words = np.zeros(CACHE_WORDS + 1, np.int64), np.zeros(CACHE_WORDS + 1, np.int64), np.zeros(1 << 20, "<u4"), 0
        self.used = 0

    def keep(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words: their two hashes, ids and numbers of ids. A word whose first hash is known stays out."""
        rows = self.words + np.arange(len(keys))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.check[rows], self.size[rows], self.start[rows] = checks, sizes, self.used + np.cumsum(sizes) - sizes
        fresh = ~self.table.find(keys)[1]
        self.table.insert(keys[fresh], rows[fresh])
        self.used += len(ids)
        self.words += len(keys)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words between ASCII white space are looked up by two 64-bit hashes, all of a list of texts at once."""
        data = [(t if UNLIKE.search(t) else t.lower()).encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        joined = b"\n".join(data) + b"\n"
        a = np.frombuffer(joined, np.uint8)
        begin, end, key, check = self.hasher.words(a)
        row, found = self.table.find(key)
        found &= self.check[np.minimum(row, CACHE_WORDS)] == check
        if not found.all():
            new = np.flatnonzero(~found)
            new = new[np.unique(key[new], return_index=True)[1]]
            if self.words + len(new) > CACHE_WORDS:
                self.forget()
                new = np.unique(key, return_index=True)[1]
                if len(new) > CACHE_WORDS:
                    return [x for at in range(0, len(texts), max(1, len(texts) // 2)) for x in self.encode(texts[at : at + max(1, len(texts) // 2)])] if len(texts) > 1 else [self.one(texts[0])]
            self.keep(key[new], check[new], *self.of_words([joined[s:e] for s, e in zip(begin[new].tolist(), end[new].tolist(), strict=True)]))
            row, found = self.table.find(key)
            found &= self.check[np.minimum(row, CACHE_WORDS)] == check
        size, start = self.size[row], self.start[row]
        flat, stop = self.flat, np.cumsum(size)
        ids = flat[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        first = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths + 1))))
        at = np.concatenate(([0], stop))[first]
        out = [ids[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for text in np.unique(np.searchsorted(first, np.flatnonzero(~found), side="right") - 1).tolist():  # a collision of hashes
            out[text] = self.one(texts[text])
        return out


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def cut(docs: DataFrame, *, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_store().setdefault("held", {})
        if ("tokenizer", tokenizer) not in held:
            held["tokenizer", tokenizer] = WordTokenizer(tokenizer)
        encode = held["tokenizer", tokenizer].encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in (s for b in batches for s in _slices(b, 200)):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(pieces, holds=True), PIECES)


def pack(docs: DataFrame, *, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    common.frugal(spark)
    pieces = common.written(
        cut(docs, tokenizer=tokenizer, window=window, end_id=end_id, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    # A block is a stretch of one task's pieces; its number holds the task in the upper bits.
    rests = pieces.withColumn("block", F.shiftright("row", 12) if block == 4096 else F.floor(F.col("row") / block))
    counts = rests.groupBy("block", "length").agg(F.count("*").alias("n"))
    counts = common.written(counts, "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    assigned, _ = plan(histogram, window)
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("block", "length", F.coalesce(before, F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("block", "length").orderBy("row"))
    ranked = rests.withColumn("local", local).join(first.hint("merge"), ["block", "length"]).withColumn("rank", F.col("first") + F.col("local") - 1)
    shared = spark.sparkContext.broadcast(np.array(assigned, dtype=np.int64).reshape(-1, 6))  # bounded, see above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        order = np.lexsort((runs[:, 1], -runs[:, 0]))
        runs = runs[order]
        shift = int((runs[:, 1] + runs[:, 2]).max()) + 1 if len(runs) else 1
        keys = (window - runs[:, 0]) * shift + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            run = runs[np.searchsorted(keys, (window - length) * shift + rank, side="right") - 1]
            at = rank - run[:, 1]
            sequence, offset = run[:, 3] + at // run[:, 4], run[:, 5] + at % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(tidy(place), f"{PIECES}, sequence_id bigint, offset bigint")
