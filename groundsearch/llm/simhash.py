"""SimHash near-duplicates, found by anchor-point covering.

Fingerprints are 64 bits. The anchors are the words of a covering code on 46 of them: two binary Golay codes
of length 23, each of which has exactly one word within 3 bits of any point. If two fingerprints differ in t
bits or fewer, they differ in e1 + e2 <= t bits on the two halves, and the anchor nearest to one of them lies
within 3 + e1 and 3 + e2 bits of the other. So each fingerprint is copied to the anchors whose two distances
exceed 3 by t in all (about 61 of 16.8 million for t = 2), and fingerprints are compared within an anchor
only. No link within t bits is lost.

Equal fingerprints are one node, so exact copies cost one row whatever their number. Within an anchor,
linked fingerprints leave as a star round the least of them, not as pairs; an anchor with many distinct
fingerprints is resolved by their common neighbours at one bit (for t = 2), in time linear in their number.
Components are then joined over all anchors by `components.connected`.

Defined results. Null or wordless text: fingerprint zero, linked like any other. Null ids: such rows get a
fingerprint and the component of their fingerprint, but name none. Repeated rows stay. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy, tidy_group
from .components import connected, local_roots

SEED = 42
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. A fixed value.
GOLAY = 0b101011100011
LENGTH, MESSAGE, RADIUS = 23, 12, 3
#: Copies that one group of anchors should hold: 12 bytes each.
GROUP_COPIES = 600_000
#: Anchors with more fingerprints than this are resolved one by one.
SMALL = 24


def fingerprint(text: str, words: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = functools.partial(xxhash.xxh64_digest, seed=SEED)
    hashes = b"".join([digest(joined[s:e]) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = sum(np.unpackbits(rows[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(rows), 65_536))
    return int.from_bytes(np.packbits(2 * count > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (bigint, the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id bigint, fingerprint bigint")


class Golay(NamedTuple):
    """Syndromes of a point's two halves (their sum is its own), and by syndrome the patterns that lead to a code word, lightest first, with their weights."""

    low: np.ndarray
    high: np.ndarray
    patterns: np.ndarray
    weights: np.ndarray

    def syndrome(self, points: np.ndarray) -> np.ndarray:
        return self.low[points & np.uint32((1 << MESSAGE) - 1)] ^ self.high[points >> np.uint32(MESSAGE)]


def code(heaviest: int = LENGTH) -> Golay:
    """The Golay code's patterns up to a weight; all cosets have some within RADIUS. Rows are filled up with weight 99."""
    check = np.zeros(LENGTH, np.uint16)  # the syndrome of each bit
    for bit in range(LENGTH):
        left = 1 << bit
        for b in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
            if left >> b & 1:
                left ^= GOLAY << (b - (LENGTH - MESSAGE))
        check[bit] = left

    def table(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.uint16)
        for c in bits:
            out = np.concatenate((out, out ^ c))
        return out

    layer, layers = np.zeros(1, np.uint32), [np.zeros(1, np.uint32)]
    for _ in range(heaviest):
        highest = np.frexp(layer.astype(np.float64))[1]  # one above the highest bit
        n = LENGTH - highest
        first = np.repeat(highest, n)
        added = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        layer = np.repeat(layer, n) | np.uint32(1) << added.astype(np.uint32)
        layers.append(layer)
    points = np.concatenate(layers)
    weight = np.repeat(np.arange(len(layers)), [len(x) for x in layers])
    golay = Golay(table(check[:MESSAGE]), table(check[MESSAGE:]), points, weight)
    syndrome = golay.syndrome(points)
    order = np.lexsort((points, weight, syndrome))
    syndrome, points, weight = syndrome[order], points[order], weight[order]
    size = np.bincount(syndrome, minlength=1 << (LENGTH - MESSAGE))
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    patterns, weights = np.zeros((len(size), size.max()), np.uint32), np.full((len(size), size.max()), 99, np.uint8)
    patterns[syndrome, place], weights[syndrome, place] = points, weight
    return golay._replace(patterns=patterns, weights=weights)


def anchors(fps: np.ndarray, t: int, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 46-bit anchors: every fingerprint with each anchor that it is copied to. golay: code(RADIUS + t) or more."""
    half = (1 << LENGTH) - 1
    parts = [(fps >> np.uint64(LENGTH * i) & np.uint64(half)).astype(np.uint32) for i in (0, 1)]
    rows, out = [], []
    cosets = [golay.syndrome(p) for p in parts]
    excess = np.maximum(golay.weights.astype(np.int64) - RADIUS, 0)
    bounds = np.stack([np.count_nonzero(excess <= e, axis=1) for e in range(t + 1)])  # patterns of a coset up to each excess
    for e1 in range(t + 1):
        lo1 = bounds[e1 - 1] if e1 else np.zeros_like(bounds[0])
        first, n1 = lo1[cosets[0]], (bounds[e1] - lo1)[cosets[0]]
        n2 = bounds[t - e1][cosets[1]]
        n = n1 * n2
        row = np.repeat(np.arange(len(fps)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        i1, i2 = first[row] + at // n2[row], at % n2[row]
        a1 = parts[0][row] ^ golay.patterns[cosets[0][row], i1]
        a2 = parts[1][row] ^ golay.patterns[cosets[1][row], i2]
        rows.append(row)
        out.append(a1.astype(np.uint64) | a2.astype(np.uint64) << np.uint64(LENGTH))
    return np.concatenate(rows), np.concatenate(out)


def _links_of_many(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all pairs within t bits in an anchor of many distinct fingerprints, without listing the pairs."""
    if t == 2:  # two points within two bits have a common neighbour at one bit or fewer
        bits = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        a, b, slices = [], [], -(-len(fps) * 65 // 4_000_000)
        for part in range(slices):  # a share of the neighbours at a time, to bound memory
            near = [], []
            for bit in bits:
                z = fps ^ bit
                mine = np.flatnonzero((z * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == part) if slices > 1 else np.arange(len(fps))
                near[0].append(z[mine])
                near[1].append(mine)
            z, who = np.concatenate(near[0]), np.concatenate(near[1])
            order = np.argsort(z, kind="stable")
            same = np.flatnonzero(z[order][1:] == z[order][:-1])
            a.append(who[order[same]])
            b.append(who[order[same + 1]])
        return np.concatenate(a), np.concatenate(b)
    a, b, left = [], [], np.arange(len(fps))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo.append(left[0])
            left = left[1:]
        x = todo.pop()
        hit = np.bitwise_count(fps[left] ^ fps[x]) <= t
        found = left[hit]
        left = left[~hit]
        todo.extend(found.tolist())
        a.append(np.full(len(found), x))
        b.append(found)
    return np.concatenate(a) if a else left, np.concatenate(b) if b else left


def resolve(anchor: np.ndarray, fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the least of those linked to them over the given anchors."""
    order = np.argsort(anchor, kind="stable")
    anchor, fps = anchor[order], fps[order]
    points, who = np.unique(fps, return_inverse=True)
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    size = np.diff(edge)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    few = np.repeat(size <= SMALL, size)
    at = np.flatnonzero(few)
    for k in range(1, SMALL):
        at = at[at + k < len(anchor)]
        at = at[anchor[at] == anchor[at + k]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= t]
        a.append(who[hit])
        b.append(who[hit + k])
    for i in np.flatnonzero(size > SMALL):
        part = slice(edge[i], edge[i + 1])
        x, y = _links_of_many(fps[part], t)
        a.append(who[part][x])
        b.append(who[part][y])
    root = local_roots(len(points), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def links(fps: DataFrame, *, t: int = 2) -> DataFrame:
    """Distinct fingerprints (bigint column `fingerprint`) to links (a, b) that join all within t bits."""
    spark = fps.sparkSession
    copies = fps.count() * (61 if t == 2 else 1 if t == 0 else 61 * 4 ** (t - 2))
    groups = max(common.partitions(spark), -(-copies // GROUP_COPIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = code(RADIUS + t)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(values), 4_000):
                part = values[start : start + 4_000]
                row, anchor = anchors(part, t, golay)
                group = ((anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
                order = np.argsort(group, kind="stable")
                edge = np.searchsorted(group[order], np.arange(groups + 1))
                packed = np.empty(len(row), dtype=[("anchor", "<u8"), ("fp", "<u8")])
                packed["anchor"], packed["fp"] = anchor[order], part[row[order]]
                used = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([packed[edge[g] : edge[g + 1]].tobytes() for g in used], pa.binary())], ["grp", "copies"])

    def compare(rows: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(rows.column("copies").to_pylist()), dtype=[("anchor", "<u8"), ("fp", "<u8")])
        a, b = resolve(packed["anchor"].copy(), packed["fp"].copy(), t)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = fps.select("fingerprint").mapInArrow(tidy(deal), "grp bigint, copies binary")
    return dealt.groupBy("grp").applyInArrow(tidy_group(compare), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = 3, t: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id: the smallest doc_id reachable over links of t bits or fewer."""
    common.frugal(docs.sparkSession)
    marked = common.written(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = common.written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(links(nodes, t=t))
    member = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(member.join(named, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """`docs` less all but one of each component of `found` (doc_id, component_id): the one that names it.

    Of repeated rows with that id one stays. Rows with null ids stay. Only the ids that go are joined.
    """
    gone = common.written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, docs[id_col] == gone.doc_id, "left_anti")
    often = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__often"))
    often = common.written(often, "often")
    if not often.count():
        return kept
    same = kept[id_col] == often["__often"]
    return kept.join(often, same, "left_anti").unionByName(kept.join(often, same, "left_semi").dropDuplicates([id_col]))
