"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed in blocks of `BLOCK` bytes, once with each dictionary; blocks keep a long text from
teaching the compressor what the dictionary lacks. The normalised difference of the two compressed sizes, with
the two sizes per byte that it is made of, becomes a probability by logistic regression on labelled rows that
built no dictionary.

Fitting uses a bounded sample: up to `sample_rows` labelled rows of each class, with their whole texts; by the ids'
hashes half of the rows build the dictionaries and half calibrate. Scoring takes every byte of every document.
Nothing but the text enters a score.

Defined results. Null or empty text: the score of no bytes at all, which is the calibrated constant. Without
labelled rows of both classes every score is the share of label 1 among those there are, or 0.5. Repeated rows
and null ids are scored like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, tidy
from .labelled import logistic, sample

BLOCK, LEVEL, DICTIONARY = 1024, 3, 65_536


def blocks_of(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


def build(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its last bytes serve as they are
        return b"".join(samples)[-DICTIONARY:]


def features(dictionaries: list[bytes]) -> Callable[[str], tuple[float, float, float]]:
    """A function of a text: the normalised difference of sizes, and size per byte with each dictionary (good, bad)."""
    import zstandard

    made = []
    for data in dictionaries:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress)
    good, bad = made

    def run(text: str) -> tuple[float, float, float]:
        parts = blocks_of(text)
        if not parts:
            return 0.0, 0.0, 0.0
        size, g, b = sum(map(len, parts)), sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
        return (b - g) / max(g, b), g / size, b / size

    return run


class QualityModel:
    """Dictionaries and calibration weights; a few hundred kilobytes whatever the corpus."""

    def __init__(self, dictionaries: list[bytes], weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights


def fit(docs: DataFrame, labels: DataFrame, *, learn_from: Column, label: str = "quality", sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    rows, share = sample(docs, labels, label=label, learn_from=learn_from, rows={0: sample_rows, 1: sample_rows}, id_col=id_col, text_col=text_col)
    if set(share) != {0, 1}:
        constant = {frozenset(): 0.0, frozenset({0}): -40.0, frozenset({1}): 40.0}[frozenset(share)]
        return QualityModel([], np.array([0.0, 0.0, 0.0, constant]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(label, b) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in blocks_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["label", "block"])

    pieces = rows.where("part = 0").select("label", "text").mapInArrow(tidy(cut), "label int, block binary").orderBy("label", F.xxhash64("block"), "block").toArrow()
    by = {c: pieces.filter(pa.compute.equal(pieces.column("label"), c)).column("block").to_pylist() for c in (1, 0)}
    dictionaries = [build(by[1] or [b" "]), build(by[0] or [b" "])]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = features(dictionaries)
        for batch in batches:
            x = [run(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([v[i] for v in x], pa.float64()) for i in range(3)]], ["label", "d", "g", "b"])

    held = rows.where("part = 1").select("label", "text").mapInArrow(tidy(measure), "label int, d double, g double, b double").orderBy("label", "d", "g", "b").toArrow().to_pandas()
    if held["label"].nunique() < 2:
        return QualityModel(dictionaries, np.array([4.0, 0.0, 0.0, 0.0]))
    weight = held["label"].map(share).to_numpy(np.float64)
    return QualityModel(dictionaries, logistic(held[["d", "g", "b"]].to_numpy(), held["label"].to_numpy(np.float64), weight, ridge=1e-6))


def scored(docs: DataFrame, model: QualityModel, *, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """`docs` with a further column, the probability of label 1."""
    frugal(docs.sparkSession)
    dictionaries, weights = model.dictionaries, model.weights
    keep = docs.columns
    named, at = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")), keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features(dictionaries) if dictionaries else lambda text: (0.0, 0.0, 0.0)
        for batch in batches:
            x = np.array([of(t or "") for t in pa.compute.struct_field(batch.column(0), [at]).to_pylist()], dtype=np.float64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:3] + weights[3], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["row", "score"])

    schema = T.StructType([named.schema["row"], T.StructField("score", T.DoubleType())])
    done = named.mapInArrow(tidy(run), schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("score").alias(into))
