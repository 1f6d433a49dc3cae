"""Exact dense retrieval: cosine of query vectors with all candidate vectors, best k of each query.

Candidates stream through Arrow batches; a block of queries is a matrix that every worker holds (its size is
bounded by `block_rows`; more queries make more passes). Each batch hands on k rows a query at most, so what is
shuffled doesn't grow with a batch's size.

Vectors that are null, hold null or non-finite components, or have another length than the queries' take no part.
Queries of several lengths are an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def coded(values: pa.Array, rows: int, columns: int) -> tuple[np.ndarray, dict[str, int]]:
    """A batch's filter values as numbers, -1 for null, and the number of each value: encoded once, whatever the number of filters."""
    found = values.flatten().dictionary_encode()
    codes = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
    return codes.reshape(rows, columns), {v: i for i, v in enumerate(found.dictionary.to_pylist())}


def fitting(codes: np.ndarray, known: dict[str, int], wanted: tuple) -> np.ndarray:
    """The rows whose filter values are among the wanted ones, for each column that wants any."""
    fits = np.ones(len(codes), bool)
    for i, values in enumerate(wanted):
        if values is not None:
            fits &= np.isin(codes[:, i], [known[v] for v in values if v in known])
    return np.flatnonzero(fits)


def allowed(queries: DataFrame, column: str) -> Column:
    """What a query's filter column lets pass, as array<string>; null for everything. A list column allows its members, an empty one everything."""
    c = F.col(column)
    if dict(queries.dtypes)[column].startswith("array"):
        return F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("string")))
    return F.when(c.isNotNull(), F.array(c.cast("string")))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best; ties go to the smaller column."""
    key = -np.round(score, 9)
    if key.shape[1] > k:
        row, col = np.nonzero(key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = (x.ravel() for x in np.indices(key.shape))
    order = np.lexsort((col, key[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "doc_id", vector: str = "embedding", query_key: str = "query_id", groups: str | list[str] | None = None, block_rows: int = 4096) -> DataFrame:
    """query_id, doc_id, score, rank. groups: columns of both tables; a query sees only candidates that each of its columns allows (see `allowed`)."""
    spark = queries.sparkSession
    groups = [groups] if isinstance(groups, str) else groups or []
    kinds = {query_key: dict(queries.dtypes)[query_key], key: dict(vectors.dtypes)[key]}
    fields = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double"
    asked = queries.where(usable(F.col(vector))).select(F.col(query_key).alias("q"), F.col(vector).alias("v"), F.array(*[allowed(queries, c) for c in groups]).cast("array<array<string>>").alias("g"))
    n, least, dim = asked.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != dim:
        raise ValueError(f"query vectors of {least} to {dim} components")
    if not n or k <= 0:
        return spark.createDataFrame([], f"{fields}, rank int")
    blocks, parts = -(-n // block_rows), []
    candidates = vectors.where(usable(F.col(vector)) & (F.size(vector) == dim)).select(F.col(key).alias("c"), F.col(vector).alias("v"), F.array(*[F.col(c).cast("string") for c in groups]).cast("array<string>").alias("g"))
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow()
        if not held.num_rows:
            continue
        ids, filters = held.column("q").combine_chunks(), defaultdict(list)
        for at, g in enumerate(held.column("g").to_pylist()):
            filters[tuple(None if x is None else tuple(x) for x in g)].append(at)
        shared = spark.sparkContext.broadcast((ids, _unit(held.column("v").combine_chunks(), dim), {f: np.array(rows) for f, rows in filters.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, filters = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = pc.sort_indices(batch.column(0)).to_numpy()  # so that columns follow the ids
                unit = _unit(batch.column(1), dim)[order]
                codes, known = coded(batch.column(2), batch.num_rows, len(groups))
                codes = codes[order]
                q, c, s = [], [], []
                for wanted, rows in filters.items():  # one pass for each distinct filter
                    at = fitting(codes, known, wanted)
                    if not len(at):
                        continue
                    score = np.round(matrix[rows] @ unit[at].T, 12)
                    row, col = _best(score, k)
                    q.append(rows[row])
                    c.append(order[at[col]])
                    s.append(score[row, col])
                if q:
                    q, c, s = (np.concatenate(x) for x in (q, c, s))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(c)), pa.array(s)], [query_key, key, "score"])

        parts.append(candidates.mapInArrow(run, fields))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    return found.withColumn("rank", order).where(F.col("rank") <= k)
