"""The pipeline's stages on the smallest tables, each against what it must do."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("overlaps", F.lit(1)).withColumn("quality_score", F.lit("x"))
    columns, kept = docs.columns, {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf).cache()
        assert after.columns == columns
        assert after.join(now.select("doc_id"), "doc_id", "left_anti").count() == 0
        kept[name] = (now.count(), after.count())
        now = after
    assert kept["line dedup"][0] == kept["line dedup"][1]
    assert all(a > b > 0.5 * a for n, (a, b) in kept.items() if n != "line dedup")
    bench = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in now.collect() if any(b in r.text.lower() for b in bench)]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_large_group_of_copies_leaves_its_text(spark):
    body = [f"line {n} of a text that was copied often" for n in range(8)]
    once, rows = "\n".join(body), []
    for i in range(300):
        own = f"nav\n{' '.join(f'w{i}x{k}' for k in range(12))}"
        rows.append((i, once if i % 3 == 0 else own, "en", "a", 0))
    for i in range(300, 330):  # near copies, in a small source
        rows.append((i, "\n".join(body[:4] + body[5:] if i % 2 else body[:7]).replace("text that was copied", "page of another kind seen"), "en", "b", 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    after = corpus_pipeline.drop_lines(spark, docs, "").cache()
    text = {r.doc_id: r.text for r in after.collect()}
    assert text[0] == once and "nav" not in text[1] and all(text[i] for i in range(330))
    left = {r.text for r in corpus_pipeline.drop_near_copies(spark, after, "").collect()}
    assert once in left and any("another kind" in t for t in left)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row int, piece string, link bigint, n int"
LONG = " ".join(f"w{i}" for i in range(60_000))
SOME = "a plain sentence about the harbour and the boats that lie there in winter when nobody sails"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, LONG, "en", "a"), (5, SOME, "en", "b"), (6, SOME, "en", "b"),
    (6, SOME, "en", "b"), (None, "a text without an id, of some ten words or so", "en", None), (7, "one", None, "b"), (8, "one", None, "c"), (9, LONG + " more", "en", "c"),
]


def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1, "mine", 3, 4) for r in ODD], SCHEMA)


def key(r):
    return str(r.doc_id), r.text or "", r.text is None


def test_stages_on_odd_rows(spark):
    """Nulls, no text, very long texts, ties, repeated rows and columns with operators' names, stage by stage."""
    sf, df = "/root/testdata/sf0.001", odd(spark)
    good = corpus_pipeline.keep_good(spark, df, sf)
    kept = [key(r) for r in good.collect()]
    assert good.columns == df.columns and {text for _, text, _ in kept} <= {r[1] or "" for r in ODD}
    assert sum(k[1] == SOME for k in kept) in (0, 3) and sum(k[1] == "one" for k in kept) in (0, 2)
    cut = corpus_pipeline.drop_lines(spark, df, sf)
    assert cut.columns == df.columns and sorted(key(r) for r in cut.collect()) == sorted(key(r) for r in df.collect())
    alone = corpus_pipeline.drop_near_copies(spark, df, sf)
    left = [key(r) for r in alone.collect()]
    assert alone.columns == df.columns and len(left) == len(set(left))
    assert sorted((i, t[:6]) for i, t, _ in left if len(t) > 20) == [("4", "w0 w1 "), ("5", "a plai"), ("None", "a text")]
    assert [i for i, t, _ in left if not t.split()] == ["1"]
    clean = corpus_pipeline.drop_leaks(spark, df, sf)
    assert clean.columns == df.columns and sorted(key(r) for r in clean.collect()) == sorted(key(r) for r in df.collect())
    pieces = corpus_pipeline.pack_windows(spark, df, sf).collect()
    short = sorted((p.doc_id, p.length) for p in pieces if p.doc_id in (1, 2))
    assert short == [(1, 1), (2, 1)] and sum(p.length for p in pieces if p.doc_id == 4) > 60_000
    assert len([p for p in pieces if p.doc_id == 6 and p.start == 0]) == 2 and max(p.offset + p.length for p in pieces) <= 2048


def test_stages_on_an_empty_table(spark):
    none = odd(spark).where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, none, "/root/testdata/sf0.001")
        assert after.columns == none.columns and after.count() == 0
    assert corpus_pipeline.pack_windows(spark, none, "/root/testdata/sf0.001").count() == 0
