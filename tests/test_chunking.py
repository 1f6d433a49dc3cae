"""Chunking by hand-worked pieces and by what must hold; the query `chunk_greedy` has the same in SQL."""

import re

from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import chunking


def pieces(spark, text, most=480, overlap=64):
    return spark.createDataFrame([(text,)], "t string").select(chunking.split_text(F.col("t"), most, overlap).alias("c")).first().c


def estimated(spark, texts):
    return [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.token_estimate(F.col("t")).alias("n")).orderBy("i").collect()]


def test_pieces_by_hand(spark):
    assert pieces(spark, "short enough") == ["short enough"]
    assert pieces(spark, "") == [""]
    assert pieces(spark, " " * 2000) == []
    # Four tokens a sentence, ten at most: two to a window, and one of them is carried over when four may be.
    five = "a1 b1 c1 . a2 b2 c2; a3 b3 c3. a4 b4 c4. a5 b5 c5."
    assert estimated(spark, ["a2 b2 c2;", "a1 b1 c1 ."]) == [3, 5]
    assert pieces(spark, five, 10, 0) == ["a1 b1 c1 . a2 b2 c2;", "a3 b3 c3. a4 b4 c4. a5 b5 c5."]
    assert pieces(spark, five, 10, 3) == ["a1 b1 c1 . a2 b2 c2;", "a2 b2 c2; a3 b3 c3. a4 b4 c4.", "a4 b4 c4. a5 b5 c5."]
    # Bullets part without a full stop; a hyphen inside a line doesn't.
    assert pieces(spark, "one two three four\n• five six seven - eight\n- nine ten eleven twelve", 8, 0) == ["one two three four", "• five six seven - eight", "- nine ten eleven twelve"]


def test_long_words_are_left_to_the_character_bound(spark):
    text = " ".join(["w" * 7] * 350)  # 350 words, 2,799 characters: an estimate of 699, but not too many words
    assert pieces(spark, text) == [text[:1920].strip(), text[1920:].strip()]
    spaced = "a  b " + "x" * 1990
    assert pieces(spark, spaced)[0] == spaced[:1920]  # as it stands, with both spaces


def test_one_word_of_many_characters(spark):
    assert [len(p) for p in pieces(spark, "x" * 9000)] == [1920, 1920, 1920, 1920, 1320]


def test_too_many_words_without_a_stop(spark):
    text = " ".join(f"{i:04d}" for i in range(2000))
    got = pieces(spark, text)
    assert all(len(p.split()) <= 369 for p in got)
    assert {w for p in got for w in p.split()} == set(text.split())
    assert [p.split()[0] for p in got] == [f"{320 * i:04d}" for i in range(len(got))]


def test_windows_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for most, overlap in ((480, 64), (50, 10)):
        rows = docs.select("text", chunking.split_text(F.col("text"), most, overlap).alias("c"), T.token_estimate(F.col("text")).alias("n"))
        rows = rows.select("*", F.transform("c", T.token_estimate).alias("each"), F.transform("c", F.length).alias("size")).collect()
        assert any(len(r.c) > 3 for r in rows)
        for r in rows:
            if r.n <= most:
                assert r.c == [r.text]
                continue
            assert set("".join(r.c).replace(" ", "").replace("\n", "")) <= set(r.text)
            assert max(r.size) <= 4 * (most + overlap) and max(r.each) <= 1.35 * (most + overlap)
            assert r.text.split()[0].startswith(r.c[0].split()[0])
            assert r.text.split()[-1].endswith(r.c[-1].split()[-1])


def test_word_windows(spark):
    df = spark.createDataFrame([(" ".join(f"G{i:04d}" for i in range(2000)),)], ["t"])
    windows = df.select(chunking.word_windows(F.col("t"), 480, 64).alias("w")).first().w
    assert max(len(w.split()) for w in windows) == 369 and windows[1].startswith("G0320 ")


def test_documents(spark):
    long = " ".join(f"Sentence {i} of the exclusions is here." for i in range(120))
    section = lambda kind, text, page: (kind, "Metric", text, page)
    doc = ("fake-tn-2026", "Fake 2026 Technical Notes", "p", "u", 2026, "t", "redistributable", "2026-01-01",
           [("C01", "Breast Cancer Screening", [section("description", "same text", 7), section("description", "same text", 7), section("exclusions", long, 7)]), ("C02", "Other", [section("description", "same text", 7)])],
           [("general", "Introduction", "Hello", 1)])
    from groundsearch.schemas import NORMALIZED_DOC

    got = chunking.chunk_documents(spark.createDataFrame([doc], NORMALIZED_DOC)).collect()
    assert all(re.fullmatch(r"[a-z0-9-]+:[A-Za-z0-9-]+:[a-z]+:[0-9a-f]{16}", r.chunk_id) for r in got)
    assert len({r.chunk_id for r in got}) == len(got)
    assert sum(r.text == "same text" for r in got) == 2  # one for each measure
    headers = {r.header for r in got}
    assert "[Fake 2026 Technical Notes | C01 Breast Cancer Screening | Metric | 2026]" in headers
    assert "[Fake 2026 Technical Notes | General | Introduction | 2026]" in headers


def test_chunk_id_hashes_a_null_measure_as_none(spark):
    import hashlib

    got = spark.createDataFrame([("d", None, "general", "t")], "d string, m string, s string, t string").select(T.chunk_id(F.col("d"), F.col("m"), F.col("s"), F.col("t")).alias("x")).first().x
    assert got == "d:doc:general:" + hashlib.sha256(b"d|None|general|t").hexdigest()[:16]
