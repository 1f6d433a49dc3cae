"""Tokens of whole Arrow batches: those of `text.tokens`, cut from the bytes of the texts without a Python string or a row for each."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import WORD_BREAK


def word_characters(spark: SparkSession) -> np.ndarray:
    """Whether each code point is a word character by WORD_BREAK: asked of Spark once, so that batches and expressions agree."""
    return _word_characters(spark.sparkContext.applicationId)


@lru_cache(1)
def _word_characters(application: str) -> np.ndarray:
    points = SparkSession.active().range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF))  # no surrogates
    points = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    word = np.zeros(0x110000, bool)
    word[points.where((F.length("c") == 1) & ~F.col("c").rlike(WORD_BREAK)).select("id").toArrow().column(0).to_numpy()] = True
    return word


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the array's bytes, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def cut(texts: pa.Array, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts without nulls, in order, and the number of each text's. word: `word_characters`."""
    ends = offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = np.concatenate([word[:128], np.ones(128, bool)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for i in (1, 2, 3):
        more = size > i
        point[more] = point[more] << 6 | data[lead[more] + i] & 0x3F
    breaks = ~word[point]
    for i in range(4):
        inside[lead[breaks & (size > i)] + i] = False
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads, tails = ends[:-1][ends[:-1] < len(data)], ends[1:][ends[1:] > 0] - 1  # tokens end with their text
    begins[heads], stops[tails] = inside[heads], inside[tails]
    begins = np.flatnonzero(begins)
    at = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) - begins + 1)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(at), pa.py_buffer(data[inside])), np.diff(np.searchsorted(begins, ends))
