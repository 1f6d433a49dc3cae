"""Removal of repeated byte strings, by suffix arrays built one bucket of suffixes at a time.

A byte goes if it lies in a `length`-byte string that also starts in a document with a smaller id. Texts are
UTF-8 bytes, and matches never cross documents.

1. Documents with one text are one content: all but the least id lose everything (if `length` bytes long).
2. Every `length`-byte string has one anchor, the least hash among its k-byte strings (k = length // 2 - 1), the
   leftmost of equals; equal strings have equal anchors at one offset. Contents send the hashes of their anchors to
   groups by hash; anchors that occur in two contents or more come back to the contents that hold them.
3. The least document of such a content sends each repeated anchor's strings, which start next to each other, to the
   anchor's group, as one stretch of bytes. All suffixes that can match meet in one group.
4. A group's stretches are one text. Its suffixes at the positions of the difference cover {0, 1, 2, 4} modulo 8 are ranked
   first, by doubling. All suffixes are then sorted one bucket at a time, those of one first byte: by eight bytes, and
   where these tie by the ranks of the sampled suffixes at a distance less than eight at which both meet the cover.
   Neighbours in that order with a common prefix of `length` bytes are one string. Rolling hashes first leave out
   stretches that hold no string twice.
5. Each document takes the union of its removed strings.

Why not all suffixes: sending every suffix to its bucket shuffles over ten bytes for each byte of text. Anchors leave
the suffixes that can match, and what is sorted is still every one of these.

Skew. An anchor that many documents of one slice, or of all, hold is hot: each of its strings goes to a bucket of its
own content, after equal strings of the slice have become one (the least document's first; those of other documents are
decided on the spot, and its own further ones, as runs, share the first's fate). So no task collects a frequent passage, line or copy. Buckets and slices are bounded in bytes on average.

Defined results. Null text: empty. Null ids: such a document loses nothing and takes nothing. Repeated rows of one
id have one text and don't count against each other. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy, tidy_group

P = 0x9E3779B97F4A7C15
MARK = np.uint64(2**64 - 1)
#: Documents of one slice, or of all, that make an anchor hot; bytes of a slice, of a stretch worked on at once, and of text for each bucket.
HOT, OFTEN, SLICE, PART, BUCKET = 48, 1000, 6_000_000, 100_000, 5_000_000
BITS = 26
#: Contents that hold more than one in so many documents are joined by a broadcast.
FREQUENT = 100_000
#: Any two positions come, less than PERIOD bytes on, both to residues of the cover.
COVER, PERIOD = (0, 1, 2, 4), 8


def sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of every n neighbours, by doubling."""
    out, width = values, 1
    while 2 * width <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    left = len(values) - n + 1
    return best(out[:left], out[n - width : n - width + left]) if width < n else out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all k-byte strings."""
    parts = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(P)}
    width = 1
    while 2 * width <= k:
        x = parts[width]
        parts[2 * width] = x[:-width] * np.uint64(pow(P, width, 1 << 64)) + x[width:]
        width *= 2
    out, done, n = None, 0, len(data) - k + 1
    for width in sorted(parts, reverse=True):
        if k & width:
            x = parts[width][done : done + n]
            out = x if out is None else out * np.uint64(pow(P, width, 1 << 64)) + x
            done += width
    out = out ^ out >> np.uint64(31)
    out = out * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ out >> np.uint64(29)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all elements of stretches."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def anchored(texts: list[np.ndarray], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors that some string of `length` bytes of a text has: hash, position, first string's start, number of strings, text.

    Texts are worked on in stretches of about PART bytes at once; strings across texts are left out.
    """
    out = []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    part = (np.cumsum(sizes) - sizes) // PART
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.empty(0, np.int64)
    w = length - k + 1
    for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        data, size = np.concatenate(texts[a:b]), sizes[a:b]
        if len(data) < length:
            continue
        begin = np.cumsum(size) - size
        h = gram_hashes(data, k)
        least = sliding(h, w, np.minimum)
        starts = np.maximum(0, size - length + 1)
        valid = ragged(begin, starts)  # starts of strings within a text
        within = np.zeros(len(least), np.uint64)
        within[valid] = least[valid]
        pad = np.zeros(w - 1, np.uint64)
        selected = sliding(np.concatenate((pad, within, pad)), w, np.maximum) == h
        hits = np.flatnonzero(selected)
        at = (np.cumsum(selected) - selected)[valid]  # the first selected position in or after each string's start
        owner, least = hits[np.minimum(at, len(hits) - 1)], least[valid]
        wrong = np.flatnonzero(h[owner] != least)
        while len(wrong):  # a selected position that is another string's anchor stands before ours
            at[wrong] += 1
            owner[wrong] = hits[at[wrong]]
            wrong = wrong[h[owner[wrong]] != least[wrong]]
        if not len(owner):
            continue
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        text = np.repeat(np.arange(len(size)), starts)[first]
        out.append((h[owner[first]], owner[first] - begin[text], valid[first] - begin[text], np.diff(np.append(first, len(owner))), text + a))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4)


def slices(batches: Iterator[pa.RecordBatch], sizes: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(sizes)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.maximum((np.cumsum(size) - size) // SLICE, np.arange(len(size)) // 50_000)
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.empty(0, np.int64)
        for a, b in zip(edge, edge[1:], strict=False):
            yield batch.slice(a, b - a)


def six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def group_of(values: np.ndarray, groups: int) -> np.ndarray:
    return (values * np.uint64(P) >> np.uint64(33)) % np.uint64(groups)


def _dealt(group: np.ndarray, groups: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(groups + 1, dtype=group.dtype))
    for g in np.flatnonzero(np.diff(edge)).tolist():
        rows = order[edge[g] : edge[g + 1]]
        yield g, [c[rows] for c in columns]


def to_parts(owner: np.ndarray, payload: list[bytes], parts: int) -> list[tuple[int, bytes]]:
    """What belongs to each owner, packed for the parts that owners fall in."""
    size = np.fromiter(map(len, payload), np.int64, len(payload))
    out = []
    for part, (rows,) in _dealt(group_of(owner.astype("<i8").view(np.uint64) ^ np.uint64(P >> 1), parts), parts, np.arange(len(owner))):
        out.append((part, np.array([len(rows)], "<u8").tobytes() + owner[rows].astype("<i8").tobytes() + size[rows].astype("<u4").tobytes() + b"".join([payload[i] for i in rows])))
    return out


def from_parts(blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Owners, each once, and all that belongs to them."""
    held: dict[int, list[bytes]] = {}
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u8", 1)[0])
        at = 8 + 12 * n
        for owner, size in zip(np.frombuffer(blob, "<i8", n, 8).tolist(), np.frombuffer(blob, "<u4", n, 8 + 8 * n).tolist(), strict=True):
            held.setdefault(owner, []).append(blob[at : at + size])
            at += size
    return np.array(list(held), np.int64), [b"".join(x) for x in held.values()]


def gathered(parts: DataFrame, owner: str, payload: str) -> DataFrame:
    """(part, packed) to one row for each owner."""

    def run(rows: pa.Table) -> pa.Table:
        owners, held = from_parts(rows.column("packed").to_pylist())
        return pa.table({owner: pa.array(owners), payload: pa.array(held, pa.binary())})

    return parts.groupBy("part").applyInArrow(tidy_group(run), f"{owner} bigint, {payload} binary")


def repeated_anchors(texts: DataFrame, length: int, k: int, groups: int) -> DataFrame:
    """(data binary, key bigint, size bigint) to (key, marks): each content's repeated anchors, as six bytes and one for whether they are hot."""
    low48 = np.uint64((1 << 48) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "size"):
            texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(0)]
            h, _, _, _, text = anchored(texts, length, k)
            # Each text's hashes, each once.
            h = h & low48
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.empty(0, bool)
            h, key = h[once], batch.column(1).to_numpy().view(np.uint64)[text[once]]
            if not len(h):
                continue
            key[key == MARK] = 0
            value, back, count = np.unique(h, return_inverse=True, return_counts=True)
            many = count >= HOT
            many[many] = [len(np.unique(key[back == i])) >= HOT for i in np.flatnonzero(many)] if many.sum() < 64 else True
            sure = many[back]
            salt = np.uint64(hash((int(h[0]), len(h))) % groups)
            rows: dict[int, list[bytes]] = {}
            for g, (a, b) in _dealt(group_of(np.concatenate([h[~sure], value[many]]), groups), groups, np.concatenate([h[~sure], value[many]]), np.concatenate([key[~sure], np.full(int(many.sum()), MARK)])):
                rows[g] = [six(a), b.tobytes(), b"", b""]
            if sure.any():
                rows.setdefault(int(salt), [b"", b"", b"", b""])[2:] = six(h[sure]), key[sure].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *[pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(4)]], ["grp", "hashes", "keys", "sure", "sure_keys"])

    def meet(rows: pa.Table) -> pa.Table:
        h, key, sure, sure_key = (b"".join(rows.column(c).to_pylist()) for c in ("hashes", "keys", "sure", "sure_keys"))
        h, key = from_six(h), np.frombuffer(key, np.uint64)
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        size = np.diff(np.append(edge, len(h)))
        most = np.maximum.reduceat(key, edge) if len(edge) else key
        repeated = np.repeat(most != np.minimum.reduceat(key, edge), size) if len(edge) else np.empty(0, bool)
        hot = np.repeat((most == MARK) | (size >= OFTEN), size)
        mine = key != MARK
        # A marker alone says that other contents hold the anchor; this group's contents with it are hot.
        all_h = np.concatenate([h[mine & repeated], from_six(sure)])
        all_key = np.concatenate([key[mine & repeated], np.frombuffer(sure_key, np.uint64)])
        all_hot = np.concatenate([hot[mine & repeated], np.ones(len(sure) // 6, bool)])
        order = np.argsort(all_key, kind="stable")
        all_h, all_key, all_hot = all_h[order], all_key[order], all_hot[order]
        edge = np.flatnonzero(np.concatenate(([True], all_key[1:] != all_key[:-1]))) if len(all_key) else np.empty(0, np.int64)
        stop = np.append(edge[1:], len(all_key)) if len(edge) else edge
        marks = np.ascontiguousarray((all_h | all_hot.astype(np.uint64) << np.uint64(48)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
        packed = to_parts(all_key[edge].view(np.int64), [marks[a:b].tobytes() for a, b in zip(edge, stop, strict=True)], groups)
        return pa.table({"part": pa.array([x for x, _ in packed], pa.int64()), "packed": pa.array([x for _, x in packed], pa.binary())})

    met = texts.mapInArrow(tidy(send, 2 * SLICE), "grp bigint, hashes binary, keys binary, sure binary, sure_keys binary").groupBy("grp").applyInArrow(tidy_group(meet), "part bigint, packed binary")
    return gathered(met, "key", "marks")


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    n = len(data) + 1
    up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, P, np.uint64), dtype=np.uint64)))
    down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, pow(P, -1, 1 << 64), np.uint64), dtype=np.uint64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return (total[starts + length] - total[starts]) * down[starts]


def pack_rows(doc: np.ndarray, start: np.ndarray, count: np.ndarray, data: bytes) -> bytes:
    import zstandard

    head = np.array([len(doc)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + doc.astype("<i8").tobytes() + start.astype("<u4").tobytes() + count.astype("u1").tobytes() + data)


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at, out = 8, []
    for dtype, width in (("<i8", 8), ("<u4", 4), ("u1", 1)):
        out.append(np.frombuffer(raw, dtype, n, at).astype(np.int64))
        at += width * n
    return (*out, np.frombuffer(raw, np.uint8, -1, at))


def bucket_rows(texts: DataFrame, length: int, k: int, groups: int) -> DataFrame:
    """(data compressed, doc_id, size, marks) to (grp, rows, decided, further).

    Stretches for the buckets; strings decided on the spot (doc_id, start); and further places of a bucket's string in
    its own document (doc_id, start there, first, last).
    """
    low48 = np.uint64((1 << 48) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in slices(batches, "size"):
            unpack = zstandard.ZstdDecompressor().decompress
            texts = [np.frombuffer(unpack(x.as_buffer()), np.uint8) for x in batch.column(batch.schema.get_field_index("data"))]
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            raw = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 7) for x in batch.column(batch.schema.get_field_index("marks"))]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            h, _, start, count, text = anchored(texts, length, k)
            h = h & low48
            # Which anchors are marked, by text and hash. A slice has fewer than 65,536 texts: all have `length` bytes.
            marks = np.concatenate(raw)
            known = from_six(np.ascontiguousarray(marks[:, :6]).tobytes()) | np.repeat(np.arange(len(raw)), [len(x) for x in raw]).astype(np.uint64) << np.uint64(48)
            order = np.argsort(known)
            wanted = h | text.astype(np.uint64) << np.uint64(48)
            at = order[np.minimum(np.searchsorted(known[order], wanted), len(known) - 1)]
            kind = np.where(known[at] == wanted, 1 + marks[at, 6].astype(np.int8), 0)
            mine = kind > 0
            h, start, count, text, kind = h[mine], start[mine], count[mine], text[mine], kind[mine]
            doc, base = ids[text], (np.cumsum(sizes) - sizes)[text]
            data = np.concatenate(texts)
            cold, warm = kind == 1, np.flatnonzero(kind == 2)
            # A hot anchor's strings go one by one.
            of = np.repeat(warm, count[warm])
            step = ragged(np.zeros(len(warm), np.int64), count[warm])
            s = start[of] + step
            value = string_hashes(data, s + base[of], length) if len(of) else np.empty(0, np.uint64)
            order = np.lexsort((s, doc[of], value))
            of, s, value = of[order], s[order], value[order]
            first = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.empty(0, bool)
            leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.empty(0, np.int64)
            same = np.ones(len(s), bool)  # hashes propose, bytes decide
            later = np.flatnonzero(~first)
            for at in range(0, len(later), 100_000):
                x = later[at : at + 100_000]
                i, j = (s[x] + base[of[x]])[:, None] + np.arange(length), (s[leader[x]] + base[of[leader[x]]])[:, None] + np.arange(length)
                same[x] = (data[i] == data[j]).all(axis=1)
            keep = first | ~same
            decided = ~keep & (doc[of] > doc[of[leader]])
            decided_rows = np.stack([doc[of[decided]], s[decided]], axis=1).astype("<i8")
            more = np.flatnonzero(~keep & ~decided)  # further ones of the leader's document, next to each other by leader
            lead, at = leader[more], s[more]
            fresh = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (at[1:] > at[:-1] + 1)))) if len(more) else more
            last = at[np.append(fresh[1:], len(more)) - 1] if len(more) else at
            runs = np.stack([doc[of[lead[fresh]]], s[lead[fresh]], at[fresh], last], axis=1).astype("<i8")
            further = {g: r.tobytes() for g, (r,) in _dealt(group_of(value[lead[fresh]], groups), groups, runs)}
            grp = np.concatenate([group_of(h[cold], groups), group_of(value[keep], groups)])
            at = np.concatenate([(start + base)[cold], (s + base[of])[keep]])
            columns = [np.concatenate(x) for x in ((doc[cold], doc[of[keep]]), (start[cold], s[keep]), (count[cold], np.ones(int(keep.sum()), np.int64)))]
            out = [(g, pack_rows(a, b, c, data[ragged(e, c + length - 1)].tobytes()), b"", further.get(g, b"")) for g, (a, b, c, e) in _dealt(grp, groups, *columns, at)]
            if len(decided_rows):
                out.append((int(decided_rows[0, 0]) % groups, b"", decided_rows.tobytes(), b""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]], ["grp", "rows", "decided", "further"])

    return texts.mapInArrow(tidy(send, 2 * SLICE), "grp bigint, rows binary, decided binary, further binary")


def sorted_by(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and whether each in that order differs from the last. Keys that leave room are sorted with their places in them, which is several times faster."""
    room = max(1, len(key) - 1).bit_length()
    if bits + room <= 64:
        packed = np.sort(key << np.uint64(room) | np.arange(len(key), dtype=np.uint64))
        order, key = (packed & np.uint64((1 << room) - 1)).astype(np.int64), packed >> np.uint64(room)
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)


def dense(key: np.ndarray, bits: int = 64) -> np.ndarray:
    """Ranks from 0, equal ones for equal keys."""
    room = max(1, len(key) - 1).bit_length()
    if bits > 64 - room and 3 * room <= 64 and bits <= 64:  # the upper bits first, then what is left
        key = dense(key >> np.uint64(room), 64 - room) << np.uint64(room) | key & np.uint64((1 << room) - 1)
        bits = 2 * room
    order, new = sorted_by(key, bits)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
    return out


class Sampled:
    """Ranks of the suffixes at the difference cover's positions of a text, by their first `depth` bytes, which are `length` or more."""

    def __init__(self, data: np.ndarray, length: int):
        padded = np.concatenate((data, np.zeros(-len(data) % PERIOD + 2 * length + 4 * PERIOD, np.uint8)))
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
        step, place = len(COVER), np.arange((len(data) // PERIOD + 2) * PERIOD).reshape(-1, PERIOD)
        rank, depth = dense(self.words[place[:, COVER].ravel()].astype(np.uint64)), 8
        while depth < length:  # a sampled suffix is followed, `depth` bytes on, by another
            on = depth // PERIOD * step
            width = len(rank).bit_length()
            rank, depth = dense(rank << np.uint64(width) | np.concatenate((rank[on:], np.zeros(min(on, len(rank)), np.uint64))), 2 * width), 2 * depth
        self.rank = np.zeros(place.size + PERIOD, np.uint64)
        self.rank[place[:, COVER].ravel()] = rank
        self.width = len(rank).bit_length()


def to_cover(r: int, s: int) -> int:
    """How many bytes on both residues lie in the cover."""
    return next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)


def sorted_bucket(text: Sampled, at: np.ndarray) -> np.ndarray:
    """Suffixes in order, to `length` bytes or more: by their first eight, ties by the ranks of sampled suffixes at one distance.

    Suffixes of one residue are sorted at once; any two residues are merged at the distance at which both meet the cover.
    """
    first, residue = dense(text.words[at].astype(np.uint64)) << np.uint64(text.width), at % PERIOD
    bits = text.width + len(at).bit_length()
    classes = []
    for r in range(PERIOD):
        mine = np.flatnonzero(residue == r)
        classes.append(mine[sorted_by(first[mine] | text.rank[at[mine] + to_cover(r, r)], bits)[0]])
    place = np.zeros(len(at), np.int64)
    for r in range(PERIOD):
        place[classes[r]] += np.arange(len(classes[r]))
        for s in range(r):
            x, y, on = classes[r], classes[s], to_cover(r, s)
            a, b = first[x] | text.rank[at[x] + on], first[y] | text.rank[at[y] + on]
            place[x] += np.searchsorted(b, a, "right")
            place[y] += np.searchsorted(a, b, "left")
    return at[sorted_by(place.astype(np.uint64), len(at).bit_length())[0]]


def matched(doc: np.ndarray, count: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and offsets of the strings that a smaller document holds too. Row i has count[i] strings, in count[i] + length - 1 bytes of data."""
    size = count + length - 1
    base = np.cumsum(size) - size
    # Rows of which no string's rolling hash occurs twice have no part in the sorting.
    row, starts = np.repeat(np.arange(len(doc)), count), ragged(base, count)
    order, new = sorted_by(string_hashes(data, starts, length) >> np.uint64(24), 40)
    twin = np.flatnonzero(~new)
    live = np.zeros(len(doc), bool)
    live[row[order[twin]]] = live[row[order[twin - 1]]] = True
    del order, twin, starts, row
    keep = np.flatnonzero(live)
    if not len(keep):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data, doc, count, size = data[ragged(base[keep], size[keep])], doc[keep], count[keep], size[keep]
    base, text = np.cumsum(size) - size, Sampled(data, length)
    row, at = np.repeat(np.arange(len(doc)), count), ragged(base, count)
    owner = np.zeros(len(data), np.int32)
    owner[at] = row
    found = [np.empty(0, np.int64)]
    by = np.argsort(data[at], kind="stable")
    edge = np.searchsorted(data[at][by], np.arange(257))
    for a, b in zip(edge, edge[1:], strict=False):  # one bucket of suffixes, those of one first byte, at a time
        if b - a < 2:
            continue
        suffix = sorted_bucket(text, at[by[a:b]])
        equal = np.ones(len(suffix) - 1, bool)  # neighbours whose common prefix has `length` bytes
        for x in [*range(0, length - 7, 8), length - 8]:
            w = text.words[suffix + x]
            equal &= w[1:] == w[:-1]
        runs = np.flatnonzero(np.concatenate(([True], ~equal)))
        of = doc[owner[suffix]]
        least = np.repeat(np.minimum.reduceat(of, runs), np.diff(np.append(runs, len(suffix))))
        found.append(suffix[of > least])
    hit = np.concatenate(found)
    return keep[owner[hit]], hit - base[owner[hit]]


def runs_by_document(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Removed strings to documents and their runs of starts (first, last), four bytes each."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))) if len(doc) else np.empty(0, np.int64)
    runs = np.stack([start[fresh], start[np.append(fresh[1:], len(doc)) - 1]], axis=1).astype("<u4") if len(doc) else np.empty((0, 2), "<u4")
    owner = doc[fresh]
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else fresh
    return owner[edge], [runs[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(owner)), strict=True)] if len(edge) else []


def removed_runs(rows: DataFrame, length: int, k: int, groups: int) -> DataFrame:
    """doc_id, runs: strings to remove."""

    def resolve(bucket: pa.Table) -> pa.Table:
        docs, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        parts = [unpack_rows(b) for b in bucket.column("rows").to_pylist() if b]
        if parts:
            doc, start, count, data = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            row, on = matched(doc, count, data, length)
            docs.append(doc[row])
            starts.append(start[row] + on)
            further = np.frombuffer(b"".join(bucket.column("further").to_pylist()), "<i8").reshape(-1, 4)
            if len(further):
                pair = np.concatenate([np.stack([docs[1], starts[1]], axis=1), further[:, :2]])
                same = np.unique(pair, axis=0, return_inverse=True)[1].ravel()
                hit = np.isin(same[len(docs[1]) :], same[: len(docs[1])])
                n = further[hit, 3] - further[hit, 2] + 1
                docs.append(np.repeat(further[hit, 0], n))
                starts.append(ragged(further[hit, 2], n))
        decided = np.frombuffer(b"".join(bucket.column("decided").to_pylist()), "<i8").reshape(-1, 2)
        owner, runs = runs_by_document(np.concatenate([*docs, decided[:, 0]]), np.concatenate([*starts, decided[:, 1]]))
        packed = to_parts(owner, runs, groups)
        return pa.table({"part": pa.array([x for x, _ in packed], pa.int64()), "packed": pa.array([x for _, x in packed], pa.binary())})

    return gathered(rows.groupBy("grp").applyInArrow(tidy_group(resolve), "part bigint, packed binary"), "doc_id", "runs")


def spans(runs: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed stretches (start, stop) of one document, from runs (first, last) in any order."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(runs[:, 1]) + length
    fresh = np.concatenate(([True], runs[1:, 0] > stop[:-1]))
    return np.stack([runs[fresh, 0], stop[np.append(np.flatnonzero(fresh)[1:], len(runs)) - 1]], axis=1)


def cut_texts(texts: DataFrame, length: int) -> DataFrame:
    """(data compressed, doc_id, key, size, runs) to the digests of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in slices(batches, "size"):
            out = [], [], []
            for blob, runs in zip(batch.column(0), batch.column(4), strict=True):
                data = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
                gone = spans(np.frombuffer(runs.as_py(), "<u4").reshape(-1, 2).astype(np.int64), length)
                digest, at = hashlib.sha256(), 0
                for start, stop in gone.tolist():
                    digest.update(data[at:start])
                    at = stop
                digest.update(data[at:])
                out[0].append(int((gone[:, 1] - gone[:, 0]).sum()))
                out[1].append(len(gone))
                out[2].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "key", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(tidy(run, 2 * SLICE), "doc_id bigint, key bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def compressed(texts: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """`data` compressed before it is shuffled; with `keep`, a bit table by `bit`, only rows whose bit is set."""
    shared = texts.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "size"):
            if shared is not None:
                bit = batch.column(batch.schema.get_field_index("bit")).to_numpy()
                batch = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            yield batch.set_column(0, "data", pa.array([pack(x.as_buffer()) for x in batch.column(0)], pa.binary()))

    return texts.mapInArrow(tidy(run, 2 * SLICE), texts.schema)


def bit_table(ids: DataFrame, column: str) -> np.ndarray:
    """2^BITS bits, set where an id hashes to: a filter of fixed size that lets no id of `ids` be missed."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITS)) + 1
    found = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in found:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def remove_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`."""
    if not 16 <= length <= 500:
        raise ValueError("length must lie between 16 and 500")
    spark, k = docs.sparkSession, length // 2 - 1
    common.frugal(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), F.col(id_col).cast("bigint").alias("doc_id"))
    texts = texts.select("data", "doc_id", F.xxhash64("data").alias("key"), F.octet_length("data").cast("bigint").alias("size"))
    meta = common.written(texts.select("doc_id", "key", "size", F.unhex(F.sha2("data", 256)).alias("sha")), "contents")
    groups = max(common.partitions(spark), -(-(meta.agg(F.sum("size")).first()[0] or 0) // BUCKET))
    least = meta.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"), F.first("key").alias("key"), F.count("*").alias("copies"))
    long_enough = texts.where((F.col("size") >= length) & F.col("doc_id").isNotNull())
    lists = repeated_anchors(long_enough.select("data", "key", "size"), length, k, groups)
    lists = lists.join(least.select(F.col("key").alias("key"), F.col("least").alias("doc_id")), "key")
    holders = compressed(long_enough).join(lists, ["key", "doc_id"]).select("data", "doc_id", "size", "marks")
    runs = common.written(removed_runs(bucket_rows(holders, length, k, groups), length, k, groups), "runs")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)).alias("bit")
    touched = compressed(long_enough.select("data", "doc_id", "key", "size", bit), bit_table(runs, "doc_id")).drop("bit")
    firsts = least.select(F.col("least").alias("doc_id"), "key")
    cut = cut_texts(touched.join(runs.join(firsts, "doc_id"), ["doc_id", "key"]).select("data", "doc_id", "key", "size", "runs"), length).dropDuplicates(["doc_id", "key"])
    frequent = common.written(least.where(F.col("copies") > F.greatest(F.lit(1000), F.lit(meta.count()) / FREQUENT)).select("sha", "least"), "frequent")
    rare = meta.join(F.broadcast(frequent), "sha", "left_anti").join(least.select("sha", "least"), "sha", "left")  # at most FREQUENT rows are broadcast
    whole = meta.join(F.broadcast(frequent), "sha").unionByName(rare).join(cut, ["doc_id", "key"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("size") >= length), F.lit(False))
    return whole.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
