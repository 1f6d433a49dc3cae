"""BM25, dense search, fusion, fallback and routing."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundsearch.config import Settings
from groundsearch.operators import bm25, dense, fusion, routing
from groundsearch.plans import retrieval


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id string, rank int")


def test_settings_hashes():
    assert (Settings().index_hash, Settings().config_hash) == ("522cd1e225fba7b5", "05d482f586746260")
    assert Settings(final_k=3).index_hash == Settings().index_hash


def test_rrf(spark):
    d = ranked(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "b", 1)])
    b = ranked(spark, [(1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "a", 1), (3, "z", 1)])
    got = fusion.fuse(d, b).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got] == ["b", "c", "a", "d", "a", "b", "z"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_fallback_appends_in_order_and_keeps_the_first(spark):
    first = fusion.fuse(ranked(spark, [(1, "x", 1), (2, "a", 1), (2, "b", 2), (2, "c", 3), (2, "d", 4)]), ranked(spark, []))
    second = fusion.fuse(ranked(spark, [(1, "y", 1), (1, "x", 2), (2, "q", 1)]), ranked(spark, []))
    got = fusion.with_fallback(first, second, spark.createDataFrame([(1,), (2,)], "query_id int")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.used_fallback) for r in got] == [(1, "x", True), (1, "y", True), *[(2, c, False) for c in "abcd"]]


def test_bm25_against_plain_python(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the dog sat on the cat", "a bird", "the the the", ""])]
    queries = [(1, "cat the the"), (2, "zebra"), (3, "Bird!")]
    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    length = sum(map(len, words.values())) / len(docs)
    want = {}
    for q, text in queries:
        for i, ws in words.items():
            s = sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / length)) for w in re.findall(r"\w+", text.lower()))
            if any(w in ws for w in re.findall(r"\w+", text.lower())):
                want[q, i] = s
    got = bm25.scores(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, query string")).collect()
    assert {(r.query_id, r.doc_id): pytest.approx(r.score) for r in got} == want
    assert not bm25.ranked(spark.createDataFrame([(1, 1, 0.0)], "query_id int, doc_id int, score double"), 5).collect()


def test_dense_ties_and_groups(spark):
    v = spark.createDataFrame([(i, x, g) for i, x, g in [(3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (1, [0.0, 1.0], 2), (4, [1.0, 1.0], 2)]], "doc_id long, embedding array<float>, g int")
    q = spark.createDataFrame([(9, [1.0, 0.0], 1), (8, [1.0, 0.0], 2)], "query_id long, embedding array<float>, g int")
    got = dense.top_k(v, q, 2, groups="g").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(8, 4), (8, 1), (9, 2), (9, 3)]
    assert dense.top_k(v, q, 3, block_rows=1).count() == 6
    assert dense.top_k(v, q.where("false"), 3).count() == 0
    either = spark.createDataFrame([(7, [1.0, 0.0], ["1", "2"]), (6, [1.0, 0.0], []), (5, [1.0, 0.0], None), (4, [1.0, 0.0], ["3"])], "query_id long, embedding array<float>, g array<string>")
    got = dense.top_k(v, either, 3, groups="g").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(i, c) for i in (5, 6, 7) for c in (2, 3, 4)]


def test_dense_leaves_out_vectors_it_cannot_compare(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 5.0]), (3, [2.0, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, None), (8, [])]
    v = spark.createDataFrame(v, "doc_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    got = dense.top_k(v, q, 9).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 3)) for r in got] == [(1, 1.0), (3, 0.894)]
    with pytest.raises(ValueError, match="2 to 3 components"):
        dense.top_k(v, q.unionByName(spark.createDataFrame([(3, [1.0] * 3)], q.schema)), 2)


def test_dense_ties_beyond_k_in_one_batch(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3 == 0)]) for i in range(50, 0, -1)], "doc_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.doc_id for r in dense.top_k(v, q, 4).orderBy("rank").collect()] == [1, 2, 4, 5]


def test_only_a_filter_can_fall_back(spark):
    chunks = spark.createDataFrame([(f"c{i}", "eye exam" if i < 6 else "flu shot" if i < 8 else f"note {i}", "C1" if i < 2 else "C2", None) for i in range(20)], "doc_id string, text string, measure_id string, embedding array<float>")
    asked = [(1, "exam", ["C1"]), (2, "exam", None), (3, "shot", []), (4, "exam", ["C1", "C2"])]
    asked = spark.createDataFrame(asked, "query_id int, query string, measure_id array<string>").withColumn("embedding", F.lit(None).cast("array<float>"))
    got = retrieval.retrieve(chunks, asked, measure="measure_id").collect()
    of = lambda q: [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
    assert {r.query_id for r in got if r.used_fallback} == {1}
    assert of(1) == of(2) == of(4) == [f"c{i}" for i in range(6)] and of(3) == ["c6", "c7"]
    added = lambda found: found.unionByName(found.limit(1).withColumn("doc_id", F.lit("new")))
    assert "new" not in {r.doc_id for r in retrieval.retrieve(chunks, asked, rerank=added).collect()}


def test_routes(spark):
    entries = spark.createDataFrame([(2030, "C99", "Colorectal Cancer Screening"), (2031, "C14", "Controlling Blood Pressure")], "plan_year int, measure_id string, measure_name string")
    table = routing.alias_table(entries)
    assert {(r.alias, r.plan_year): r.measure_ids for r in table.collect()}["col", 2030] == ["C99"]
    q = spark.createDataFrame([(1, "CBP and c12 rules"), (2, "the protocol"), (3, "blood pressures"), (4, "cold")], "query_id int, query string")
    got = {r.query_id: r.measure_ids for r in routing.route(q, table).collect()}
    assert got == {1: ["C12", "C14"], 2: [], 3: ["C14"], 4: []}


def test_years(spark):
    cases = [("in 2026", 2026), ("2025 or 2026", None), ("what changed", None), ("changed in 2026", 2026), ("in 2019", 2027), ("x", 2027)]
    df = spark.createDataFrame(cases, "t string, want int")
    got = df.select("want", routing.inferred_year(F.col("t"), F.array(F.lit(2025), F.lit(2026)), F.lit(2027)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    chunks = spark.createDataFrame([(2025,)] * 99 + [(2026,)] * 5 + [(2030,)], "plan_year int")
    assert routing.default_year(chunks).first().default_year == 2025
