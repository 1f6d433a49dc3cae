"""Language-model scoring by context-tree weighting over bytes.

Text is its words, ASCII letters in lower case, joined by single spaces, and one end byte (0xFF, which UTF-8
never holds); before the first byte stand end bytes. Each byte is eight binary decisions. A node of the tree is
a context of 0 to `depth` bytes with the bits so far, and holds how often 0 and 1 followed. Its
Krichevsky-Trofimov estimate is mixed with what its longer contexts say, by the weights that context-tree
weighting gives after the training text: w = P_kt / (P_kt + product of the children's P_w). A context that
training never saw adds nothing: the longest seen one stands alone there.

What the corpus gives: counts of all (depth + 1)-byte strings and of all words of the training rows, summed
map-side and shuffled. No process holds the whole tree. What lies under a context of two bytes is a tree of its
own; a group of Spark's builds it and hands on the logarithms that its parent node sums. The driver gathers these
sums, at most 65,536 numbers for each of eight bits, and mixes the two uppermost levels. Then come slices, one
after the other: the strings of some two-byte contexts, at most `slice_rows` unless one context alone has more, of
which there can be 256^(depth - 1). A slice's log probabilities of seen strings are a hash table; bytes of unseen
strings are worked out through the slice's tree. Both are broadcast for a pass over the texts; a text's score is
the sum over slices.

The base score is that of an add-0.1 unigram model of words, which are counted by 128 bits of hashes. The most
frequent words, at most `hot_words`, are broadcast as a hash table; all others are looked up by a join.

Defined results. Null or empty text: the end token alone. Null ids belong to the held-out rows. Repeated rows
stay. An empty table gives an empty result. Without training rows the tree is empty and every bit has
probability one half; base scores are then null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy, tidy_group
from .slots import Slots, WordHasher

END = b"\xff"
FLUSH_BYTES = 8_000_000


def windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte string at every byte of every text with its end, newest byte uppermost, and the texts' first positions."""
    pad = END * depth
    data = np.frombuffer(b"".join([pad + t + END for t in texts]) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    keys = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,)) & np.uint64((1 << 8 * (depth + 1)) - 1)
    start = first + depth * np.arange(len(texts))  # where each text's first window begins
    at = np.repeat(start - first, sizes) + np.arange(sizes.sum())
    return keys[at], first


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + i) for i in range(8))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level(NamedTuple):
    """Counts by (context of d bytes, next byte), sorted, with running totals."""

    keys: np.ndarray
    total: np.ndarray


def nodes_of(level: Level, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A level's nodes after so many bits, and how often 0 and 1 followed."""
    keys, total = level
    node = keys >> np.uint64(8 - bits)
    edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)
    count = np.diff(total)
    one = (keys >> np.uint64(7 - bits) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(count * one, edge) if len(edge) else count[:0]
    every = np.add.reduceat(count, edge) if len(edge) else count[:0]
    return node[edge], every - ones, ones


def parents(nodes: np.ndarray, bits: int) -> np.ndarray:
    """The nodes of contexts that are one byte shorter."""
    return nodes >> np.uint64(bits + 8) << np.uint64(bits) | nodes & np.uint64((1 << bits) - 1)


#: By bits: nodes, and what the product of their children's probabilities is (a logarithm).
Sums = list[tuple[np.ndarray, np.ndarray]]


class Tree(NamedTuple):
    """levels[d]: counts; weights[d][bits]: nodes (context, bits so far) and how much each node's own estimate counts, but for the longest contexts."""

    levels: list[Level]
    weights: list[list[tuple[np.ndarray, np.ndarray]]]

    @staticmethod
    def built(strings: np.ndarray, counts: np.ndarray, longest: int, shortest: int = 0, below: Sums | None = None) -> tuple["Tree", Sums]:
        """Levels of contexts from `shortest` to `longest`, and the logarithms of the shortest ones' probabilities. `strings`: the longest contexts (newest byte uppermost) with their next byte lowest, sorted. `below`: what lies under them; leaves without."""
        levels = []
        for d in range(shortest, longest + 1):
            keys, n = (strings, counts) if d == longest else counted(strings >> np.uint64(8 * (longest - d + 1)) << np.uint64(8) | strings & np.uint64(255), counts)
            levels.append(Level(keys, np.concatenate(([0], np.cumsum(n)))))
        weights: list = [[] for _ in range(shortest, longest + (below is not None))]
        out = []
        for bits in range(8):
            under = below and below[bits]
            for d in range(longest, shortest - 1, -1):
                nodes, zeros, ones = nodes_of(levels[d - shortest], bits)
                own = log_kt(zeros, ones)
                if under is None:
                    mixed = own
                else:
                    children = np.bincount(np.searchsorted(nodes, under[0]), weights=under[1], minlength=len(nodes))
                    both = np.logaddexp(own, children)
                    weights[d - shortest].append((nodes, np.exp(own - both).astype(np.float32)))
                    mixed = both - np.log(2)
                under = parents(nodes, bits) if d else nodes, mixed
            out.append(under)
        return Tree(levels, weights), out

    @staticmethod
    def whole(strings: np.ndarray, counts: np.ndarray, depth: int) -> "Tree":
        return Tree.built(strings, counts, depth)[0]

    def on(self, lower: "Tree") -> "Tree":
        """This tree of short contexts on one of longer contexts."""
        return Tree([*self.levels, *lower.levels], [*self.weights, *lower.weights])

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def log2(self, strings: np.ndarray) -> np.ndarray:
        """log2 of the probability of each string's last byte after its others."""
        out = np.zeros(len(strings))
        for bits in range(8):
            bit = strings >> np.uint64(7 - bits) & np.uint64(1)
            p = np.full(len(strings), 0.5)
            for d in range(self.depth, -1, -1):
                keys, total = self.levels[d]
                path = strings >> np.uint64(8 * (self.depth - d + 1)) << np.uint64(8) | strings & np.uint64(255) if d < self.depth else strings
                node = path >> np.uint64(8 - bits)
                low, high = np.searchsorted(keys, node << np.uint64(8 - bits)), np.searchsorted(keys, (node + np.uint64(1)) << np.uint64(8 - bits))
                middle = np.searchsorted(keys, (node << np.uint64(1) | np.uint64(1)) << np.uint64(7 - bits))
                every = total[high] - total[low]
                ones = total[high] - total[middle]
                seen = every > 0
                one = (ones + 0.5) / (every + 1.0)
                own = np.where(bit == 1, one, 1 - one)
                if d == self.depth:
                    p, deeper = np.where(seen, own, p), seen
                else:
                    nodes, weight = self.weights[d][bits]
                    w = weight[np.minimum(np.searchsorted(nodes, node), max(0, len(nodes) - 1))] if len(nodes) else np.ones(len(strings))
                    p = np.where(seen, np.where(deeper, w * own + (1 - w) * p, own), p)
                    deeper = seen
            out += np.log2(p)
        return out


def ordered(keys: np.ndarray, depth: int) -> np.ndarray:
    """From the newest byte uppermost (as windows are) to the next byte lowest."""
    return (keys & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | keys >> np.uint64(8 * depth)


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of text, or one text."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy()
        part = (np.cumsum(size) - size) // limit
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.empty(0, np.int64)
        for a, b in zip(edge, edge[1:], strict=False):
            yield batch.slice(a, b - a)


class Batch:
    """Normalised texts of a batch: one buffer of words parted by spaces, and each text's place."""

    def __init__(self, texts: list[str | None], hasher: WordHasher):
        self.texts = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
        joined = b"\n".join(self.texts) + b"\n"
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + 1
        self.begin, self.end, self.hash, self.check = hasher.words(np.frombuffer(joined, np.uint8))
        self.joined = joined
        self.first = np.searchsorted(self.begin, np.concatenate(([0], np.cumsum(sizes))))  # each text's first word


def counted_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
    return a[edge], b[edge], np.add.reduceat(n, edge) if len(edge) else n


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """word (true or false), a, b, n: counts of words by their two hashes, and of byte windows (in a; b is 0), of column `text`."""

    def rows(word: bool, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), word)), pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["word", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held = {True: [], False: []}
        size = {True: 0, False: 0}

        def merge(word: bool) -> None:
            if word:
                whole = counted_pairs(*(np.concatenate(x) for x in zip(*held[word], strict=True)))
            else:
                k, n = counted(np.concatenate([x[0] for x in held[word]]), np.concatenate([x[2] for x in held[word]]))
                whole = k, np.zeros(len(k), np.uint64), n
            held[word], size[word] = [whole], len(whole[0])

        for batch in _groups(batches, FLUSH_BYTES // 2):
            texts = Batch(batch.column("text").to_pylist(), hasher)
            k, n = counted(windows(texts.texts, depth)[0])
            held[False].append((k, np.zeros(len(k), np.uint64), n))
            order = np.argsort(texts.hash)
            a, b = texts.hash[order], texts.check[order]
            edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
            held[True].append((a[edge], b[edge], np.diff(np.append(edge, len(a)))))
            for word in (True, False):
                if sum(len(x[0]) for x in held[word]) > size[word] + 1_500_000:
                    merge(word)
                    if size[word] > 2_500_000:
                        yield from rows(word, *held[word][0])
                        held[word], size[word] = [], 0
        for word in (True, False):
            if held[word]:
                merge(word)
                yield from rows(word, *held[word][0])

    found = docs.select("text").mapInArrow(tidy(run), "word boolean, a bigint, b bigint, n bigint")
    return found.groupBy("word", "a", "b").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, *, held_out: Column, depth: int = 5, hot_words: int = 800_000, slice_rows: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits_per_byte (code length over the bytes of the normalised text and its end)."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must lie between 1 and 6")
    spark = docs.sparkSession
    common.frugal(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = common.written(corpus_counts(training, depth), "counts")
    words = counts.where("word").select("a", "b", "n")
    by_count = sorted(((r.n, r.words) for r in words.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    train_docs = training.select("held_out").count()
    all_tokens, distinct = sum(n * w for n, w in by_count) + train_docs, sum(w for _, w in by_count) + (train_docs > 0)
    least, total = by_count[0][0] + 1 if by_count else 1, 0
    for n, w in by_count:  # the least count whose words are not too many
        total += w
        if total > hot_words:
            break
        least = n
    shared_hot = spark.sparkContext.broadcast(_hot_table(words.where(F.col("n") >= least)))
    strings = counts.where("not word").select((F.col("a") % (1 << 8 * depth) * 256 + F.shiftright("a", 8 * depth)).alias("string"), "n")  # as `ordered` has it
    top = _top(strings, depth)
    end_log = float(np.log10(train_docs + 0.1))
    fields = "doc_id bigint, held_out boolean, text string, n_tokens bigint, hot_known bigint, hot_log double, rare array<struct<a:bigint,b:bigint>>, n_bytes bigint, log2 double"
    scored = rows
    for low, high in _cuts(strings, depth, slice_rows):
        if low:  # else the workers of all passes would hold their slices at once
            scored = common.written(scored, "passes")
        last = high == 256 ** stem(depth)
        model = spark.sparkContext.broadcast(_slice(strings, depth, low, None if last else high, top))
        scored = scored.mapInArrow(tidy(_pass(model, low, high, last, None if low else shared_hot, int(train_docs > 0), end_log)), fields.replace("text string, ", "") if last else fields)
    kept = common.written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = kept.select("row", F.inline("rare"))
    sums = rare.join(words.where(F.col("n") < least), ["a", "b"]).groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + F.lit(0.1))).alias("logs"))
    done = kept.drop("rare").join(sums, "row", "left").withColumn("n_known", F.col("hot_known") + F.coalesce("known", F.lit(0)))
    each = float(np.log10(all_tokens + 0.1 * (distinct + 1))) if train_docs else None
    unknown = F.col("n_tokens") - F.col("n_known")  # log10(0.1) is -1
    base_score = F.col("hot_log") + F.coalesce("logs", F.lit(0.0)) - unknown - F.col("n_tokens") * F.lit(each).cast("double")
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(all_tokens).cast("bigint").alias("train_tokens"), base_score.alias("base_score"), (F.col("log2") * F.lit(float(np.log10(2)))).alias("score"),
        (-F.col("log2") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _hot_table(words: DataFrame) -> tuple:
    """Hash table of the frequent words: hash to row; second hashes and log10(count + 0.1) by row."""
    found = words.toArrow()
    a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
    key, first = np.unique(a.view(np.uint64), return_index=True)  # of two words with one hash the other is looked up like a rare one
    table = Slots(len(key), np.int32)
    table.insert(key, np.arange(len(key)))
    return table.bits, table.keys, table.values, b[first].view(np.uint64), np.log10(n[first] + 0.1)


def stem(depth: int) -> int:
    """Bytes of a context that name its subtree."""
    return min(2, depth)


def _stem(strings: DataFrame, depth: int) -> DataFrame:
    return strings.withColumn("stem", F.shiftright("string", 8 * (depth + 1 - stem(depth))))


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Strings and their counts, sorted."""
    keys = rows.column("string").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


def _top(strings: DataFrame, depth: int) -> Tree:
    """The levels above all subtrees: of fewer than stem(depth) bytes, at most 65,536 strings."""
    least = stem(depth)

    def summed(rows: pa.Table) -> pa.Table:
        _, sums = Tree.built(*_arrays(rows), depth, least)
        node = np.concatenate([nodes for nodes, _ in sums])
        return pa.table({"bits": pa.array(np.repeat(np.arange(8), [len(nodes) for nodes, _ in sums])), "node": pa.array(node.astype(np.int64)), "log": pa.array(np.concatenate([logs for _, logs in sums]))})

    each = _stem(strings, depth).groupBy("stem").applyInArrow(tidy_group(lambda rows: summed(rows.drop_columns(["stem"]))), "bits bigint, node bigint, log double")
    # Decimals, whose sum no order of rows changes.
    found = each.groupBy("bits", "node").agg(F.sum(F.col("log").cast("decimal(30,9)")).cast("double").alias("log")).orderBy("bits", "node").toArrow()
    bits, node, log = (found.column(c).to_numpy() for c in ("bits", "node", "log"))
    below = [(node[bits == b].view(np.uint64), log[bits == b]) for b in range(8)]
    short = F.shiftright("string", 8 * (depth + 2 - least)) * 256 + F.col("string") % 256
    upper = strings.groupBy(short.alias("string")).agg(F.sum("n").alias("n")).toArrow()
    return Tree.built(*_arrays(upper), least - 1, 0, below)[0]


def _cuts(strings: DataFrame, depth: int, slice_rows: int) -> list[tuple[int, int]]:
    """Bounds (low, high) of slices by stem, each of at most slice_rows strings unless one stem has more."""
    by_stem = _stem(strings, depth).groupBy("stem").count().orderBy("stem").collect()  # 65,536 at most
    cuts, held = [0], 0
    for r in by_stem:
        if held and held + r["count"] > slice_rows:
            cuts.append(r.stem)
            held = 0
        held += r["count"]
    return list(zip(cuts, [*cuts[1:], 256 ** stem(depth)], strict=True))


def _slice(strings: DataFrame, depth: int, low: int, high: int | None, top: Tree) -> tuple:
    """Plain tables, for a broadcast: the tree of a slice under `top`, and the hash table of its strings' log probabilities."""
    mine = _stem(strings, depth).where((F.col("stem") >= low) & (F.col("stem") < high if high else F.lit(True))).select("string", "n")
    keys, n = _arrays(mine.toArrow())
    tree = top.on(Tree.built(keys, n, depth, stem(depth))[0])
    table = Slots(len(keys), np.float32)
    table.insert((keys & np.uint64(255)) << np.uint64(8 * depth) | keys >> np.uint64(8), np.concatenate([np.zeros(0), *[tree.log2(keys[at : at + 300_000]) for at in range(0, len(keys), 300_000)]]))
    return [tuple(x) for x in tree.levels], tree.weights, (table.bits, table.keys, table.values)


def _pass(model, low: int, high: int, last: bool, hot, end_known: int, end_log: float):
    """One slice's log probabilities, added to column log2; the first pass, which has `hot`, makes the other columns."""

    def base(batch: pa.RecordBatch, texts: Batch, table: Slots, check: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
        row, found = table.find(texts.hash)
        found &= check[np.minimum(row, max(0, len(check) - 1))] == texts.check if len(check) else False
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[texts.first])
        log = np.zeros(len(row))
        log[found] = logs[row[found]]
        rare = np.flatnonzero(~found)
        offsets = np.searchsorted(rare, texts.first).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(texts.hash[rare].view(np.int64)), pa.array(texts.check[rare].view(np.int64))], ["a", "b"])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(texts.first) + 1), pa.array(summed(found) + end_known), pa.array(summed(log) + end_log), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array(np.fromiter(map(len, texts.texts), np.int64, batch.num_rows) + 1), pa.array(np.zeros(batch.num_rows))],
            [*batch.schema.names, "n_tokens", "hot_known", "hot_log", "rare", "n_bytes", "log2"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, weights, slots = model.value
        tree, table, hasher = Tree([Level(*x) for x in levels], weights), Slots.of(*slots), WordHasher()
        words, check, logs = (Slots.of(*hot.value[:3]), *hot.value[3:]) if hot else (None, None, None)
        depth = tree.depth
        for batch in _groups(batches):
            texts = Batch(batch.column("text").to_pylist(), hasher)
            if hot:
                batch = base(batch, texts, words, check, logs)
            keys, first = windows(texts.texts, depth)
            values, found = table.find(keys)
            values = values.astype(np.float64)
            if low or not last:
                newest = keys >> np.uint64(8 * (depth - stem(depth))) & np.uint64(256 ** stem(depth) - 1)
                other = (newest < low) | (newest >= high)
                values[other], found[other] = 0, True
            new = np.flatnonzero(~found)
            if len(new):
                strings, where = np.unique(ordered(keys[new], depth), return_inverse=True)
                values[new] = tree.log2(strings)[where]
            total = np.add.reduceat(values, first) if len(first) else np.zeros(0)
            at = batch.schema.get_field_index("log2")
            batch = batch.set_column(at, "log2", pa.array(batch.column(at).to_numpy() + total))
            yield batch.drop_columns(["text"]) if last else batch

    return run
