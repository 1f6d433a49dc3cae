"""Which of many patterns stand in a text, anywhere, without word bounds: one automaton, one pass over each text.

A task builds the automaton once and reads its texts in Arrow batches: Spark's expressions would look for one pattern after the
other. The patterns are a Python list that travels with the task, so it has to be short against a worker's memory; the texts
are not bounded.

Defined results. A pattern counts once a text, whatever its number of places; overlapping and nested ones all count. Null and
empty texts hold none; null and empty patterns stand nowhere. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


def found_in(texts: DataFrame, patterns: Sequence[str], *, key: str, text: str = "text", into: str = "pattern") -> DataFrame:
    """key, `into`: a row for each pattern that a text holds."""
    wanted = sorted({p for p in patterns if p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        seek = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, p in enumerate(wanted):
            seek.add_word(p, n)
        seek.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, t in enumerate(batch.column(1)):
                held = sorted({n for _, n in seek.iter(t.as_py() or "")}) if wanted else []
                rows += [row] * len(held)
                hits += [wanted[n] for n in held]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], [key, into])

    asked = texts.select(F.col(key), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(run, StructType([asked.schema[key], StructField(into, StringType())]))
