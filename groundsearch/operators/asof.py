"""As-of and segment joins: each row with the last (or next) row of another table, by key and position.

Both tables' distinct positions are dealt by range of (key, position), so a key with a third of all rows is spread over as
many buckets as its positions need. The last value runs on inside a bucket; what a bucket hands to the next ones of its key is
one row, found by a window over a key's buckets. Rows of one position meet their match by an equi-join, which Spark splits.

A null key or position matches nothing. Of several right rows at one position the one with the greatest values counts. Every left row
comes back once, with nulls where nothing matches. Columns of the left keep their names, and so do those taken from the right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def asof_join(left: DataFrame, right: DataFrame, *, on: str, left_at: str, right_at: str, take: dict[str, str], forward: bool = False, strict: bool = False, buckets: int | None = None) -> DataFrame:
    """`left` with columns of its match in `right`: take says what they are called, and what in `right`.

    The match is the last row at or before the left row's position; forward: the first at or after it. strict: not at it.
    """
    if clash := set(take) & set(left.columns):
        raise ValueError(f"columns that the left table has already: {', '.join(sorted(clash))}")
    buckets = buckets or max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(on).alias("k")
    held = right.select(key, F.col(right_at).alias("at"), F.struct(*[F.col(c).alias(name) for name, c in take.items()]).alias("v"))
    asked = left.select(key, F.col(left_at).alias("at"), F.lit(None).cast(held.schema["v"].dataType).alias("v"))
    points = asked.unionByName(held).where("k is not null and at is not null").groupBy("k", "at").agg(F.max("v").alias("v"))
    dealt = written(points.repartitionByRange(buckets, "k", "at").withColumn("bucket", F.spark_partition_id()), "points")
    order = F.desc if forward else F.asc
    last = F.last("v", ignorenulls=True)
    ends = dealt.where("v is not null").groupBy("k", "bucket").agg((F.min_by if forward else F.max_by)("v", "at").alias("v"))
    every = dealt.select("k", "bucket").distinct().join(ends, ["k", "bucket"], "left")
    carried = every.select("k", "bucket", last.over(Window.partitionBy("k").orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = last.over(Window.partitionBy("k", "bucket").orderBy(order("at")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    matched = dealt.select("k", "at", "bucket", inside.alias("inside")).join(carried, ["k", "bucket"]).select("k", "at", F.coalesce("inside", "carried").alias("v"))
    l, m = left.alias("l"), matched.alias("m")
    found = l.join(m, (F.col(f"l.`{on}`") == F.col("m.k")) & (F.col(f"l.`{left_at}`") == F.col("m.at")), "left")
    return found.select("l.*", *[F.col("m.v").getField(name).alias(name) for name in take])


def segments(heads: DataFrame, *, on: str, at: str, stop: str = "stop", buckets: int | None = None) -> DataFrame:
    """Rows that begin a segment, with `stop`: the position of the next one of the key, or null."""
    return asof_join(heads, heads, on=on, left_at=at, right_at=at, take={stop: at}, forward=True, strict=True, buckets=buckets)


def within(rows: DataFrame, heads: DataFrame, *, on: str, at: str, head_at: str, take: dict[str, str], stop_at: str | None = None, buckets: int | None = None) -> DataFrame:
    """Range join: rows with the segment that holds their position, from its head (in) to its stop (out, if heads have a column of stops); rows of no segment are left out."""
    ends = {"_stop": stop_at} if stop_at else {}
    found = asof_join(rows, heads, on=on, left_at=at, right_at=head_at, take={"_start": head_at, **ends, **take}, buckets=buckets).where("_start is not null")
    return (found.where(F.col("_stop").isNull() | (F.col(at) < F.col("_stop"))) if stop_at else found).drop("_start", "_stop")
