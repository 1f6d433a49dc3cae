"""Many patterns in one pass, against looking for each; names that are chosen beside a question."""

import random

from groundsearch.operators import patterns, routing


def test_each_pattern_that_stands_in_a_text(spark):
    pick = random.Random(5)
    words = ["".join(pick.choice("abé ") for _ in range(pick.randint(1, 4))) for _ in range(60)]
    texts = ["".join(pick.choice("abé ") for _ in range(pick.randint(0, 30))) for _ in range(200)] + ["", None, "ab" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    got = sorted(map(tuple, patterns.found_in(df, [*words, words[0], "", None], key="id", text="t").collect()))
    assert got == sorted((n, w) for n, t in enumerate(texts) for w in set(words) if w in (t or ""))
    assert patterns.found_in(df, [], key="id", text="t").count() == 0 and patterns.found_in(df.limit(0), words, key="id", text="t").count() == 0


def test_repeated_rows_and_keys_of_any_kind(spark):
    df = spark.sql("select named_struct('q', 1, 'year', cast(null as int)) as k, 'a flu shot' as text, 2 as pattern from range(2)")
    assert [(r.k.q, r.k.year, r.name) for r in patterns.found_in(df, ["flu shot", "shot", "fluff"], key="k", into="name").collect()] == [(1, None, "flu shot"), (1, None, "shot")] * 2


def test_chosen_measures_route(spark):
    chunks = spark.createDataFrame([(2025, "C11", "Eye Exam"), (2026, "C14", "Eye Exam"), (2026, "D02", "Statin"), (2026, None, "General"), (2026, "C09", None)], "plan_year int, measure_id string, measure_name string")
    names = routing.measure_index(chunks)
    assert {r.measure_name: r.measure_ids for r in names.collect()} == {"Eye Exam": ["C11", "C14"], "Statin": ["D02"]}
    asked = spark.createDataFrame([(1, "who counts"), (2, "who"), (3, "x"), (4, None)], "query_id int, query string")
    chosen = spark.createDataFrame([(1, "Statin"), (1, "Eye Exam"), (1, "Statin"), (2, "none"), (4, "Statin")], "query_id int, measure_name string")
    got = routing.augmented(asked, chosen, names)
    assert {r.query_id: r.query for r in got.collect()} == {1: "who counts C11 C14 D02", 2: "who", 3: "x", 4: "D02"}
    routed = routing.route(got, routing.alias_table(routing.entries(chunks)))
    assert {r.query_id: r.measure_ids for r in routed.collect()} == {1: ["C11", "C14", "D02"], 2: [], 3: [], 4: ["D02"]}
