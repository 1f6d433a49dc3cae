"""Approximate nearest neighbours by cosine: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Fitting uses a bounded sample (`sample_rows`); every vector is indexed. Equal vectors are one entry that keeps
the k + 1 smallest ids, which is all that any answer can hold of them, so a vector shared by a third of all
rows costs one entry and one search. Neighbouring cells share a shard of about `chunk_rows` entries, and a larger cell
is cut over several. Queries are a stated set, in blocks of about `query_rows`: each goes to the shards that hold a cell
it probes, is scored against those cells' residual codes through its table of distances, and the best codes of all
shards are scored exactly on the original vectors, in double precision: the `rerank` best, with all that tie with the
last, and all that lie within `margin` times the code's error of the k-th, as in a clump of vectors that are almost equal.

Probing: the nearest cells until `probe_share` of the cells, and at least `probe_cells`, and `rerank` entries
are reached. Centroids that the codes can't tell apart are one cell, so a dense clump is probed whole or not at all. Model, cell sizes: at most MAX_CELLS centroids and 256 codes a subspace, so what is broadcast is bounded.

Defined results. Vectors that are null, zero, hold null or non-finite components, or differ in length from most of
the sample (of two lengths as frequent, the longer), and rows without an id, take no part. Repeated rows (id and
vector) count once. Ties go to the smaller id. Fewer candidates than k: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import tidy

MAX_CELLS = 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def apart(centres: np.ndarray, least: float) -> np.ndarray:
    """The centres, without those that are nearer than `least` to an earlier one that stays."""
    stay, gone = [], np.zeros(len(centres), bool)
    for i, centre in enumerate(centres):
        if not gone[i]:
            stay.append(i)
            gone |= ((centres - centre) ** 2).sum(1) < least * least
    return centres[stay]


def fit(sample: np.ndarray, rows: int, subspaces: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Centroids of unit vectors, about four times the square root of the rows, and code books of the residuals' subspaces."""
    cells = max(1, min(MAX_CELLS, int(4 * rows**0.5), len(sample) // 4))
    centres = kmeans(sample, cells, 8, seed)
    residual = sample - centres[nearest(sample, centres)]
    dim = sample.shape[1]
    m = max(d for d in range(1, min(subspaces, dim) + 1) if dim % d == 0)
    books = np.stack([_padded(kmeans(np.ascontiguousarray(part), 256, 6, seed)) for part in np.split(residual[:16_384], m, axis=1)])
    near = np.concatenate([b[nearest(np.ascontiguousarray(p), b)] for p, b in zip(np.split(residual, m, axis=1), books, strict=True)], axis=1)
    error = np.sqrt(((residual - near) ** 2).sum(1).mean() / dim)  # of a code, in one direction
    centres = apart(centres, error * dim**0.5)
    return {"centres": centres.astype(np.float32), "books": books.astype(np.float32), "error": float(error)}


def laid_out(model: dict[str, np.ndarray], sizes: np.ndarray, chunk_rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first shard, and over how many it is cut. Cells follow their centroids' main direction, so that neighbours meet."""
    centres = model["centres"].astype(np.float64)
    way = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    order, cut = np.argsort(centres @ way, kind="stable"), np.maximum(1, -(-sizes // chunk_rows))
    room = max(1, min(chunk_rows, -(-int(sizes.sum()) // shards)))
    first, shard, held = np.zeros(len(sizes), np.int64), 0, 0
    for cell in order.tolist():
        if cut[cell] > 1 or held and held + sizes[cell] > room:
            shard, held = shard + (held > 0), 0
        first[cell] = shard
        if cut[cell] > 1:
            shard += int(cut[cell])
        else:
            held += int(sizes[cell])
    return first, cut


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], 256 - len(book), axis=0)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of first .. first + n - 1."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 40_000,
    subspaces: int = 32,
    probe_cells: int = 8,
    probe_share: float = 0.4,
    rerank: int = 160,
    margin: float = 4.0,
    chunk_rows: int = 32_768,
    query_rows: int = 16_384,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found."""
    spark = vectors.sparkSession
    common.frugal(spark)
    clean = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = clean.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    entries = common.written(entries.select(F.get("ids", F.lit(0)).alias("entry"), "ids", "vector"), "entries")
    rows = entries.count()
    sample = entries.select("vector").orderBy(F.xxhash64("entry")).limit(sample_rows).toArrow().column("vector").combine_chunks()
    lengths = Counter(pa.compute.list_value_length(sample).to_pylist())
    dim = max(lengths, key=lambda n: (lengths[n], n), default=0)
    entries = entries.where(F.size("vector") == dim)
    model = fit(_matrix(sample.filter(pa.compute.equal(pa.compute.list_value_length(sample), dim))), rows, subspaces) if rows else {"centres": np.zeros((1, 1), np.float32), "books": np.zeros((1, 256, 1), np.float32), "error": 0.0}
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value["centres"], shared.value["books"]
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = nearest(x, centres)
            parts = np.split(x - centres[cell], len(books), axis=1)
            codes = np.stack([nearest(np.ascontiguousarray(p), b) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary())], ["entry", "cell", "code"])

    index = common.written(entries.select("entry", "vector").mapInArrow(tidy(encode), "entry bigint, cell bigint, code binary"), "index")
    sizes = np.zeros(len(model["centres"]), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MAX_CELLS rows
        sizes[r["cell"]] = r["count"]
    first_shard, cut = laid_out(model, sizes, chunk_rows, common.partitions(spark))
    places = spark.createDataFrame([(c, int(f), int(n)) for c, (f, n) in enumerate(zip(first_shard, cut, strict=True))], "cell bigint, first_shard bigint, cut bigint")  # at most MAX_CELLS rows
    queries = common.written(clean.where("asks").select("vec_id", "vector").distinct().join(entries.select("entry", "vector"), "vector").select("vec_id", "entry"), "queries")
    asked = common.written(queries.select("entry").distinct().join(entries.select("entry", "vector"), "entry"), "asked")
    blocks = max(1, -(-asked.count() // query_rows))
    to_probe = max(probe_cells, int(np.ceil(probe_share * len(sizes))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's nearest cells, as one bit for each cell."""
        centres = shared.value["centres"]
        half = (centres * centres).sum(1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            order = np.argsort(half - x @ centres.T, axis=1, kind="stable")
            reached = np.cumsum(sizes[order], axis=1) >= min(rerank, sizes.sum())
            enough = np.maximum(np.argmax(reached, axis=1) + 1, to_probe)
            bits = np.zeros(order.shape, bool)
            np.put_along_axis(bits, order, np.arange(order.shape[1]) < enough[:, None], axis=1)
            packed = np.packbits(bits, axis=1)
            held = [np.unique(ranges(first_shard[b], cut[b])) for b in bits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in x], pa.binary()), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(held, pa.list_(pa.int64()))], ["query", "unit", "cells", "shards"])

    probes = asked.select("entry", "vector").mapInArrow(tidy(probe), "query bigint, unit binary, cells binary, shards array<bigint>")
    probes = probes.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("bigint")).withColumn("shard", F.explode("shards")).drop("shards")
    shard = (F.col("first_shard") + F.pmod(F.xxhash64("entry"), F.col("cut"))).alias("shard")
    index = index.join(F.broadcast(places), "cell").select("entry", "cell", "code", shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))

    slack = margin * model["error"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best codes of a shard's cells for each query that probes them."""
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        if left.num_rows and right.num_rows:
            centres, books = shared.value["centres"], shared.value["books"]
            m = len(books)
            entry, cell = left.column("entry").to_numpy(), left.column("cell").to_numpy()
            codes = np.ascontiguousarray((np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(-1, m).astype(np.int64) + 256 * np.arange(m)).T)
            here, local = np.unique(cell, return_inverse=True)
            for query, unit, cells in zip(right.column("query").to_pylist(), right.column("unit").to_pylist(), right.column("cells").to_pylist(), strict=True):
                q = np.frombuffer(unit, np.float32)
                probed = np.unpackbits(np.frombuffer(cells, np.uint8))[here].astype(bool)
                at = np.flatnonzero(probed[local])
                tables = np.einsum("mcd,md->mc", books, q.reshape(m, -1)).ravel()
                near = (centres[here] @ q)[local[at]]
                for c in codes:
                    near = near + tables[c[at]]
                if len(near) > rerank:
                    last, kth = np.partition(near, (-rerank, -k - 1))[[-rerank, -k - 1]]
                    keep = near >= min(last, kth - slack)
                    at, near = at[keep], near[keep]
                out[0].append(np.full(len(at), query))
                out[1].append(entry[at])
                out[2].append(near.astype(np.float32))
        return pa.table({"query": np.concatenate(out[0]), "entry": np.concatenate(out[1]), "near": np.concatenate(out[2])})

    scored = index.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInArrow(score, "query bigint, entry bigint, near float")
    best = F.rank().over(Window.partitionBy("query").orderBy(F.desc("near")))  # ties with the last stay
    kth = F.min(F.when(F.col("n") <= k + 1, F.col("near"))).over(Window.partitionBy("query"))
    candidates = scored.withColumn("n", best).withColumn("kth", kth).where((F.col("n") <= rerank) | (F.col("near") >= F.col("kth") - slack)).select("query", "entry").unionByName(asked.selectExpr("entry as query", "entry")).distinct()
    vector_of = lambda name, other: entries.selectExpr(f"entry as {name}", f"vector as {other}")
    exact = candidates.join(vector_of("query", "a"), "query").join(entries.select("entry", "ids", F.col("vector").alias("b")), "entry").select("query", cosine(F.col("a"), F.col("b")).alias("score"), F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = exact.withColumn("n", order).where(F.col("n") <= k + 1).drop("n")
    answers = queries.selectExpr("vec_id as query_id", "entry as query").join(top, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
