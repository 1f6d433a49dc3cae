"""Text expressions against values worked out by hand."""

from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import parsing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_normalized_block(spark):
    def run(s):
        return one(spark, T.normalized_block(F.col("t")), t=s)

    assert run("the 2025- 2026 plan period") == "the 2025-2026 plan period"
    assert run("Patient - level data") == "Patient-level data"
    assert run("wrapped\n   line\n\n and   more") == "wrapped line and more"
    assert run("Items:\n  •   one\n  • two\n  - three") == "Items:\n• one\n• two\n- three"
    assert run("a\x00PAGE:3\x00b") == "a b"


def test_token_estimate(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="one two three") == 3
    assert one(spark, T.token_estimate(F.col("t")), t="x" * 400) == 100


def test_tokens_are_unicode_words(spark):
    assert one(spark, T.tokens(F.col("t")), t="Éa-b, C2 _d") == ["éa", "b", "c2", "_d"]


def test_snippet(spark):
    long = " ".join(f"w{i}" for i in range(60))
    cut = one(spark, T.snippet(F.col("t"), F.col("c")), t=long, c=False)
    assert cut.endswith(" …") and len(cut.split()) == 41
    assert one(spark, T.snippet(F.col("t"), F.col("c")), t=long, c=True) == long


def test_fields_keep_order_and_need_the_line_start(spark):
    block = "lead\nMetric: a\n Exclusions : none here, Metric: no\n  Data  Time   Frame: 2026\nMetric Notes: n\n"
    got = one(spark, parsing.fields(F.col("t")), t=block)
    assert [g.label for g in got] == ["Body", "Metric", "Exclusions", "Data Time Frame", "Metric Notes"]
    assert got[2].text == "none here, Metric: no\n"
    assert [g.label for g in one(spark, parsing.fields(F.col("t")), t="no labels")] == ["Body"]
    assert [g.label for g in one(spark, parsing.fields(F.col("t")), t="Metric: x")] == ["Metric"]


def test_measure_sections(spark):
    text = (
        "\x00PAGE:1\x00\nIntro words\nMeasure: C01 - Breast Cancer ..... 9\nMeasure: C02 - A long name\nthat wraps ........ 10\n"
        "\x00PAGE:2\x00\nbody\n  Measure: C01 - Breast Cancer Screening\n Label for Stars: BCS\nMetric: share\nof women\n"
        "\x00PAGE:3\x00\nMeasure: D02: Statin Use\nMetric: other\nWeird: x\n"
    )
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = parsing.measure_sections(docs).orderBy("measure_id", "s_pos").collect()
    assert [(r.measure_id, r.page, r.kind, r.heading, r.text) for r in rows] == [
        ("C01", 2, "description", "Label for Stars", "BCS"),
        ("C01", 2, "description", "Metric", "share of women"),
        ("D02", 3, "description", "Metric", "other Weird: x"),
    ]
    assert rows[0].measure_name == "Breast Cancer Screening"
    assert [r.text for r in parsing.introductions(docs).collect()] == ["Intro words"]
    pages = parsing.page_sections(docs).orderBy("page").collect()
    assert [p.heading for p in pages] == ["Page 1", "Page 2", "Page 3"]
