"""Near-copies by five-word shingles: every pair of Jaccard similarity `least` or more links its texts.

Proposals only save work; what links two texts is always their similarity over distinct shingles, and no pair is missed.

1. SimHash: fingerprints over the shingles meet by anchor-point covering (`simhash.links`, two bits); each text proposes
   the least text of a fingerprint that its own is linked to, and similar pairs make the first components.
2. Prefix filter, for what two bits miss. Shingles have one order, the rare ones first, by counts of 2^20 cells; of a text x
   of |x| shingles the first |x| - ceil(least |x|) + k are its prefix. Of two texts, let x be the one whose prefix ends
   first in the order: what of that prefix is not in the other's is not in the other at all. So two texts share no more
   than their common prefix shingles and what stands behind x's prefix, nor more than x's rest: what it holds besides
   prefix shingles that no other prefix has. Both bounds prune, and miss none.
3. Hubs: in each shingle's list the text that shares most is the hub; each text of another component proposes the hub that
   most of its lists name. A family of near-copies becomes a component so, for one pair a text.
4. All other pairs: texts of different components that may meet in as many lists as their sizes ask for, whatever their
   number. The prefix filter works here again, on the lists themselves, the short ones first. Within a component nothing
   pairs, so a family costs its lists, not their square.

Lists, votes and pairs are plain rows, joined and summed by Spark, which splits hot lists; only the table of cells, of
fixed size, is broadcast. Shingles of hot cells skip the count of step 2, so no task gathers a list.

Defined results. Equal token sequences (by 64 bits) are one text; null and wordless texts are equal to each other. A text
of fewer words than a shingle is one shingle. Null ids: no component (null). Repeated rows share one. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .common import tidy, tidy_group
from .components import connected
from .slots import WordHasher
from .suffixes import BITS, bit_table, group_of

BITS_APART = 2
#: Shingles that both prefixes must share; cells of the table that orders shingles, and the pieces in which it is summed.
SHARED, CELLS, PIECES = 4, 1 << 20, 64
EPSILON = 1e-6


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[list[bytes]], size: int, hasher: WordHasher) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit hashes."""
    lines = [b" ".join(t) for t in texts]
    begin, _, word, check = hasher.words(np.frombuffer(b"\n".join(lines) + b"\n", np.uint8))
    ends = np.cumsum([0, *[len(line) + 1 for line in lines]])
    first = np.searchsorted(begin, ends)
    total = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for i in range(size):
        total = total * np.uint64(WordHasher.ODD[0]) + (word ^ check >> np.uint64(7))[i : i + len(total)]
    total = mixed(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        else:  # all words at once; no words are a shingle of their own
            x = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                x = x * np.uint64(WordHasher.ODD[1]) + w
            out.append(mixed(x))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(WordHasher.ODD[1])
    return x ^ x >> np.uint64(29)


def contents(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, content (a hash of the token sequence), fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            content = np.array([xxhash.xxh64_intdigest(b" ".join(tokens(t)), simhash.SEED) for t in texts], np.uint64)
            prints = np.array([simhash.fingerprint(t, words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content.view(np.int64)), pa.array(prints.view(np.int64))], ["doc_id", "content", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, 1_000_000), "doc_id bigint, content bigint, fingerprint bigint")


class Sets:
    """The shingle sets of `nodes` (content, doc_id), read from `docs`."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
        self.nodes, self.words, self.shared = nodes, words, []

    def free(self) -> None:
        """Takes back the filters of tables that are written by now."""
        while self.shared:
            self.shared.pop().destroy()

    def each(self, wanted: DataFrame, then: Callable, schema: str) -> DataFrame:
        """What `then` makes of batches of (doc_id, content, shingles). Documents that are not `wanted` (doc_id) are left out by a filter of fixed size, which lets some pass."""
        spark, words = self.docs.sparkSession, self.words
        shared = spark.sparkContext.broadcast(bit_table(wanted, "doc_id"))
        self.shared.append(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            hasher = WordHasher()
            for batch in batches:
                bit = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
                if not batch.num_rows:
                    continue
                split = [tokens(t.as_py()) for t in batch.column(1)]
                content = np.array([xxhash.xxh64_intdigest(b" ".join(w), simhash.SEED) for w in split], np.uint64)
                sets = [s.view(np.int64) for s in shingle_sets(split, words, hasher)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "content", "shingles"])

        rows = self.docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)).alias("bit"))
        return rows.mapInArrow(tidy(lambda batches: then(run(batches)), 400_000), schema)

    def of(self, contents: DataFrame, then: Callable, columns: str) -> DataFrame:
        """One row (content, `columns`) for each of `contents`, a subset of the nodes."""
        held = self.nodes.join(contents, "content", "left_semi").select("doc_id", "content")
        return self.each(held, then, f"doc_id bigint, content bigint, {columns}").join(held, ["doc_id", "content"]).dropDuplicates(["content"]).drop("doc_id")

    def similar(self, pairs: DataFrame, least: float) -> DataFrame:
        """The pairs (a, b) of similarity `least` or more."""
        ends = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct()
        sets = common.written(self.of(ends, lambda rows: rows, "shingles array<bigint>"), "shingles")
        self.free()
        side = lambda name, other: sets.select(F.col("content").alias(name), F.col("shingles").alias(other))
        shared = F.size(F.array_intersect("x", "y"))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        found = common.written(both.where(shared >= least * (F.size("x") + F.size("y") - shared) - EPSILON).select("a", "b"), "similar")
        common.dropped(sets)
        return found


def cell_counts(sets: Sets) -> np.ndarray:
    """How many texts hold a shingle of each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            total += np.bincount(batch.column(2).flatten().to_numpy().view(np.uint64) & np.uint64(CELLS - 1), minlength=CELLS).astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int64()), pa.array([pack(x.tobytes()) for x in np.split(total, PIECES)], pa.binary())], ["piece", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(CELLS // PIECES, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(unpack(x.as_buffer()), np.uint32)
        return pa.table({"piece": rows.column("piece")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros((PIECES, CELLS // PIECES), np.uint32)
    for r in sets.each(sets.nodes, count, "piece bigint, counts binary").groupBy("piece").applyInArrow(tidy_group(add), "piece bigint, counts binary").collect():
        out[r.piece] = np.frombuffer(r.counts, np.uint32)
    sets.free()
    return out.ravel()


def prefix_length(size: int, least: float) -> int:
    must = max(1, ceil(least * size - EPSILON))
    return size - must + min(SHARED, must)


def postings(sets: Sets, least: float) -> DataFrame:
    """token, id, size, rest, weight, ends: tokens of prefixes that another prefix holds too.

    rest: how many shingles a text has besides the prefix's others; weight: how much its lists hold; ends: where in the
    order the prefix ends (to 31 bits of a hash; two that are equal say nothing).
    """
    spark = sets.docs.sparkSession
    counts = cell_counts(sets)
    shared = spark.sparkContext.broadcast(counts)
    often = 4096 + 8 * int(counts.mean())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.compute.list_value_length(batch.column(2)).to_numpy()
            flat, edge, out, ends = batch.column(2).flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(n))), [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = flat[a:b]
                x = x[np.lexsort((x, shared.value[x & np.uint64(CELLS - 1)]))][: prefix_length(b - a, least)]
                out.append(x.tobytes())
                ends.append(int(shared.value[x[-1] & np.uint64(CELLS - 1)]) << 31 | int(x[-1]) >> 33)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), pa.array(out, pa.binary()), pa.array(ends, pa.int64())], ["doc_id", "content", "size", "prefix", "ends"])

    rows = common.written(sets.of(sets.nodes.select("content"), cut, "size int, prefix binary, ends bigint"), "prefixes")
    sets.free()
    groups = max(common.partitions(spark), -(-(rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 2_000_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            if not held:
                continue
            n = np.fromiter(map(len, held), np.int64, len(held))
            token, row = np.concatenate(held), np.repeat(np.arange(len(held)), n)
            ids, size, ends = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            # A token of a frequent cell counts as shared, and goes to a group by its text.
            hot = shared.value[token & np.uint64(CELLS - 1)] > often
            group = np.where(hot, group_of(ids.view(np.uint64)[row], groups) + np.uint64(groups), group_of(token, groups))
            order = np.argsort(group, kind="stable")
            edge = np.searchsorted(group[order], np.arange(2 * groups + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(edge))
            blobs = []
            for g in used.tolist():
                x = order[edge[g] : edge[g + 1]]
                blobs.append(np.array([len(x)], "<i8").tobytes() + token[x].tobytes() + ids[row[x]].tobytes() + size[row[x]].astype("<i4").tobytes() + ends[row[x]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "postings"])

    def keep(rows: pa.Table) -> pa.Table:
        parts = []
        for blob in rows.column("postings"):
            raw = blob.as_buffer()
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            parts.append((np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), np.frombuffer(raw, "<i4", n, 8 + 16 * n), np.frombuffer(raw, "<i8", n, 8 + 20 * n)))
        token, ids, size, ends = (np.concatenate(c) for c in zip(*parts, strict=True))
        if rows.column("grp")[0].as_py() >= groups:
            n = np.full(len(token), often)
        else:
            n = np.unique(token, return_inverse=True, return_counts=True)
            n = n[2][n[1]]
        mine = n > 1
        return pa.table({"token": token[mine], "id": ids[mine], "size": size[mine], "n": n[mine], "ends": ends[mine]})

    found = rows.mapInArrow(tidy(deal, 2_000_000), "grp bigint, postings binary").groupBy("grp").applyInArrow(tidy_group(keep), "token bigint, id bigint, size int, n bigint, ends bigint")
    by_text = Window.partitionBy("id")
    rest = found.select("token", "id", "size", (behind(F.col("size"), least) + F.count("*").over(by_text)).cast("int").alias("rest"), F.sum("n").over(by_text).alias("weight"), "ends")
    out = common.written(rest, "postings")
    shared.destroy()
    common.dropped(rows)
    return out


def behind(size: Column, least: float) -> Column:
    """How many shingles stand behind the prefix of a text."""
    must = F.greatest(F.lit(1), F.ceil(size * least - EPSILON))
    return must - F.least(F.lit(SHARED), must)


def common_least(least: float) -> Column:
    """How many shingles texts x and y (structs) must share to have similarity `least`."""
    return F.ceil(least / (1 + least) * (F.col("x.size") + F.col("y.size")) - EPSILON)


def first_ended(x: Column, y: Column) -> Column:
    """Of values of texts x and y that of the one whose prefix ends first; the larger if that is not known."""
    return F.when(F.col("x.ends") < F.col("y.ends"), x).when(F.col("y.ends") < F.col("x.ends"), y).otherwise(F.greatest(x, y))


def may(least: float) -> Column:
    """Whether the sizes and rests of texts x and y (structs) let them have similarity `least`."""
    return first_ended(F.col("x.rest"), F.col("y.rest")) >= common_least(least)


def within_size(least: float) -> Column:
    return F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - EPSILON


def needed(least: float) -> Column:
    """In how many lists texts x and y (structs) must meet to have similarity `least`."""
    return F.greatest(F.lit(1), common_least(least) - first_ended(behind(F.col("x.size"), least), behind(F.col("y.size"), least)))


def met(pairs: DataFrame, least: float) -> DataFrame:
    """a, b, votes of pairs (x, y: structs of id, size; tokens: how many they meet by) that meet as often as similar texts must."""
    votes = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), needed(least).alias("need"), "tokens").groupBy("a", "b").agg(F.sum("tokens").alias("votes"), F.first("need").alias("need"))
    return votes.where("votes >= need").select("a", "b", "votes")


def hub_pairs(lists: DataFrame, least: float) -> DataFrame:
    """a, b: each text with the hub of another component that most of its lists name."""
    text = F.struct("weight", "id", "comp", "size", "rest", "ends")
    hubs = lists.groupBy("token").agg(F.max(text).alias("y"))
    asked = lists.select("token", text.alias("x")).join(hubs, "token").where((F.col("x.comp") != F.col("y.comp")) & within_size(least) & may(least))
    return met(asked.withColumn("tokens", F.lit(1)), least).groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))


def other_pairs(lists: DataFrame, least: float) -> DataFrame:
    """a, b: all texts of different components that may meet often enough. Shingles that only one's own component holds are no part of its rest here.

    Two texts that must share `need` of their lists, ordered by length, share one that leaves need - 1 of either text's lists
    behind it: the first that they share. Only there do they pair, so a long list, which comes late, pairs few of its texts.
    """
    held = lists.groupBy("token", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q"))
    main = held.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q")).where("comps > 1")
    # Lists of the same texts are one list of so many tokens.
    main = main.groupBy("n", "p", "q").agg(F.min("token").alias("token"), F.first("main").alias("main"), F.count("*").alias("tokens")).select("token", "main", "tokens", "n")
    by_text = Window.partitionBy("id")
    mixed = lists.join(main, "token").withColumn("mixed", F.sum("tokens").over(by_text)).withColumn("before", F.sum("tokens").over(by_text.orderBy("n", "token")) - F.col("tokens"))
    text = F.struct("id", "comp", "size", (behind(F.col("size"), least) + F.col("mixed")).cast("int").alias("rest"), "ends", "mixed", "before")
    mixed_lists = mixed.select("token", "main", text.alias("y"))
    outside = mixed_lists.where("y.comp <> main").select("token", F.col("y").alias("x"))
    once = (F.col("y.comp") == F.col("main")) | (F.col("x.id") < F.col("y.id"))
    early = (F.col("x.before") + needed(least) <= F.col("x.mixed")) & (F.col("y.before") + needed(least) <= F.col("y.mixed"))
    pairs = outside.join(mixed_lists, "token").where((F.col("x.comp") != F.col("y.comp")) & once & within_size(least) & may(least) & early)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each text with the least of its fingerprint, and that one with the least of a linked fingerprint."""
    reps = common.written(nodes.groupBy("fingerprint").agg(F.min("content").alias("rep")), "fingerprints")
    linked = simhash.links(reps.select("fingerprint"), t=BITS_APART)
    named = lambda column, name: reps.select(F.col("fingerprint").alias(column), F.col("rep").alias(name))
    across = linked.join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    within = nodes.join(reps, "fingerprint").select(F.col("content").alias("a"), F.col("rep").alias("b")).where("a <> b")
    return across.unionByName(within).distinct()


def similar_documents(docs: DataFrame, *, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over pairs of similarity `least` or more."""
    common.frugal(docs.sparkSession)
    marked = common.written(contents(docs, words, id_col, text_col), "contents")
    nodes = common.written(marked.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint")), "nodes")
    sets = Sets(docs, nodes, words, id_col, text_col)
    links = sets.similar(common.written(fingerprint_pairs(nodes), "pairs"), least)
    lists = postings(sets, least)
    with_components = lambda links: lists.join(connected(links), F.col("id") == F.col("node"), "left").select("token", "id", "size", "rest", "weight", "ends", F.coalesce("root", "id").alias("comp"))
    asked = common.written(hub_pairs(with_components(links), least), "pairs")
    links = links.unionByName(sets.similar(asked, least))
    done = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = common.written(other_pairs(with_components(links), least).join(done, ["a", "b"], "left_anti"), "pairs")
    roots = connected(links.unionByName(sets.similar(more, least)))
    classes = nodes.join(roots, nodes.content == roots.node, "left").select("content", "doc_id", F.coalesce("root", "content").alias("root"))
    named = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = classes.join(named, "root").select("content", "component_id")
    return marked.join(of, "content", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
