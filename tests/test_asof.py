"""As-of and segment joins against brute force, over few and many buckets, with a hot key, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from groundsearch.operators import asof
from groundsearch.sources.scratch import written


def tables(spark):
    random.seed(5)
    left = [(random.choice("aaaabc"), random.randrange(400), i) for i in range(300)] + [(None, 5, 900), ("a", None, 901), ("z", 3, 902), ("a", 7, 903), ("a", 7, 903)]
    right = [(random.choice("aaaab"), random.randrange(400), random.choice(["x", "y", None])) for _ in range(80)] + [(None, 1, "no"), ("b", None, "no"), ("a", 7, "p"), ("a", 7, "q")]
    return left, right, spark.createDataFrame(left, "k string, t int, id int").withColumn("at", F.lit(1)), spark.createDataFrame(right, "k string, s int, name string")


@pytest.mark.parametrize("buckets", [1, 7, 60])
@pytest.mark.parametrize(("forward", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_against_brute_force(spark, buckets, forward, strict):
    left, right, a, b = tables(spark)
    got = asof.asof_join(a, b, on="k", left_at="t", right_at="s", take={"page": "s", "title": "name"}, forward=forward, strict=strict, buckets=buckets)
    assert got.columns == ["k", "t", "id", "at", "page", "title"]

    def match(k, t):
        fits = [(s, n) for key, s, n in right if k is not None and None not in (t, s) and key == k and (s > t if forward else s < t) | (s == t and not strict)]
        best = (min if forward else max)((s for s, _ in fits), default=None)
        return max(((s, n) for s, n in fits if s == best), key=lambda x: (x[1] is not None, x[1] or ""), default=(None, None))

    assert sorted(((r.k, r.t, r.id, r.page, r.title) for r in got.collect()), key=str) == sorted(((k, t, i, *match(k, t)) for k, t, i in left), key=str)


def test_a_hot_key_is_spread_over_buckets(spark):
    """Half the rows of one key: no bucket holds much more than its share."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").alias("t"))
    heads = rows.where("t % 100 = 0")
    got = asof.asof_join(rows, heads, on="k", left_at="t", right_at="t", take={"page": "t"}, buckets=8)
    assert all(r.page == r.t - r.t % 100 for r in got.where("k = 'hot'").collect())
    sizes = [r["count"] for r in written(rows.repartitionByRange(8, "k", "t").withColumn("bucket", F.spark_partition_id()), "points").groupBy("bucket").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * 4000 / 8


def test_segments_and_what_lies_within(spark):
    heads = spark.createDataFrame([("d", 10), ("d", 20), ("d", 50), ("e", 5)], "k string, start int")
    cut = asof.segments(heads, on="k", at="start", buckets=3)
    assert {(r.k, r.start, r.stop) for r in cut.collect()} == {("d", 10, 20), ("d", 20, 50), ("d", 50, None), ("e", 5, None)}
    limited = cut.withColumn("stop", F.when(F.col("start") == 20, 30).otherwise(F.col("stop")))
    rows = spark.createDataFrame([("d", t) for t in (5, 10, 19, 20, 29, 30, 49, 50, 999)] + [("e", 4), ("f", 1)], "k string, t int")
    got = asof.within(rows, limited, on="k", at="t", head_at="start", stop_at="stop", take={"segment": "start"}, buckets=3)
    assert {(r.k, r.t, r.segment) for r in got.collect()} == {("d", 10, 10), ("d", 19, 10), ("d", 20, 20), ("d", 29, 20), ("d", 50, 50), ("d", 999, 50)}


def test_empty_tables_and_clashes(spark):
    _, _, a, b = tables(spark)
    options = {"on": "k", "left_at": "t", "right_at": "s", "take": {"title": "name"}}
    assert asof.asof_join(a.where("false"), b, **options).count() == 0
    assert asof.asof_join(a, b.where("false"), **options).where("title is null").count() == a.count()
    with pytest.raises(ValueError, match="already: id"):
        asof.asof_join(a, b, on="k", left_at="t", right_at="s", take={"id": "name"})
