"""Postings on disk and retrieval that scores once."""

import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundsearch.config import Settings
from groundsearch.functions.text import WORD_BREAK, tokens
from groundsearch.functions.token_batches import cut, word_characters
from groundsearch.operators import bm25, dense
from groundsearch.plans import index, retrieval

DOCS = [(1, "The cat sat; the CAT sat"), (2, ""), (3, None), (4, "dog"), (5, "l'été à Zürich_2 été"), (6, "x " * 30_000 + "y"), (7, " \n\t!")]


def test_term_counts(spark):
    got = {r.doc_id: (r.length, {t.token: t.f for t in r.terms}) for r in bm25.postings(spark.createDataFrame(DOCS, "doc_id int, text string")).collect()}
    assert got == {1: (6, {"the": 2, "cat": 2, "sat": 2}), 2: (0, {}), 3: (0, {}), 4: (1, {"dog": 1}), 5: (5, {"l": 1, "été": 2, "à": 1, "zürich_2": 1}), 6: (30_001, {"x": 30_000, "y": 1}), 7: (0, {})}
    assert WORD_BREAK


def test_postings_are_read_by_another_session(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    asked = spark.createDataFrame([(1, "cat dog dog"), (2, "été"), (3, "none of it")], "query_id int, query string")
    want = {(r.query_id, r.doc_id): r.score for r in bm25.scores(docs, asked).collect()}
    path = str(tmp_path / "lexicon")
    bm25.write(docs, path, buckets=3)
    for session in (spark, spark.newSession()):
        held = bm25.read(session, path)
        assert held.summary.first().n == len(DOCS)
        assert {(r.query_id, r.doc_id): r.score for r in bm25.scores(held, session.createDataFrame(asked.collect(), asked.schema)).collect()} == pytest.approx(want)
    assert {(1, 1), (1, 4), (2, 5)} == set(want)


def test_scores_of_a_document_are_summed_without_a_shuffle(spark, tmp_path):
    held = bm25.write(spark.createDataFrame(DOCS, "doc_id int, text string"), str(tmp_path / "lexicon"), buckets=3)
    asked = spark.createDataFrame([(1, "cat dog")], "query_id int, query string")
    plan = bm25.scores(held, asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Bucketed: true" in plan


def test_rebuilt_postings_replace_the_old(spark, tmp_path):
    path = str(tmp_path / "lexicon")
    bm25.write(spark.createDataFrame(DOCS, "doc_id int, text string"), path, buckets=3)
    held = bm25.write(spark.createDataFrame([(9, "cat")], "doc_id int, text string"), path, buckets=2)
    assert [r.doc_id for r in held.postings.collect()] == [9] and held.summary.first().n == 1
    empty = bm25.write(spark.createDataFrame([], "doc_id int, text string"), path, buckets=2)
    assert not bm25.scores(empty, spark.createDataFrame([(1, "cat")], "query_id int, query string")).collect()


def test_more_questions_than_are_broadcast(spark, monkeypatch):
    docs, asked = spark.createDataFrame(DOCS, "doc_id int, text string"), spark.createDataFrame([(1, "cat dog"), (2, "x y")], "query_id int, query string")
    want = sorted(bm25.scores(docs, asked).collect())
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    assert sorted(bm25.scores(docs, asked).collect()) == want


def test_best_is_the_ranking_of_all_pairs_under_each_list(spark, monkeypatch):
    texts = [(i % 50, " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(60)]  # ids 0 to 9 stand twice
    docs = spark.createDataFrame([*texts, (50, None), (51, "w1 w1 w1 only")], "doc_id int, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w1 w1", q % 3 if q % 4 else None) for q in range(9)] + [(9, "none of it", 1), (10, None, 1)], "query_id int, query string, part int")
    held = docs.select("doc_id", (F.col("doc_id") % 3).alias("part")).distinct()
    index = bm25.lexicon(docs)
    pairs = bm25.scores(index, asked).join(asked.select("query_id", F.col("part").alias("want")), "query_id").join(held, "doc_id")
    plain = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    free, fits = plain(bm25.ranked(pairs, 3)), plain(bm25.ranked(pairs.where("want is null or want = part"), 3))
    assert free != fits and len(free) == 27
    for rows, cells, batch in ((4096, bm25.CELLS, 10_000), (4, 5, 7)):  # more passes, groups of questions, slices and batches
        monkeypatch.setattr(bm25, "CELLS", cells)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = bm25.best(index, asked, 3, lists=[[], ["part"]], held=held, block_rows=rows).cache()
            assert plain(found.where("list = 0")) == free and plain(found.where("list = 1")) == fits
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain(bm25.top_k(index, asked, 3, keep=held.where("part = 0").select("doc_id"))) == plain(bm25.ranked(pairs.where("part = 0"), 3))
    assert not bm25.best(index, asked, 0).collect() and not bm25.best(index, asked.where("query_id = 9"), 3).collect()


def test_ranking_makes_no_row_for_each_pair(spark):
    plan = bm25.top_k(spark.createDataFrame(DOCS, "doc_id int, text string"), spark.createDataFrame([(1, "cat dog")], "query_id int, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_tokens_of_batches_are_those_of_the_expression(spark):
    """Every code point inside, before and after a word and alone; texts that end in a word or are empty; slices."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = [" ".join(f"a{c}b {c} a{c} {c}b" for c in points[i : i + 4096]) for i in range(0, 0x30000, 4096)] + ["".join(points[i : i + 65536]) for i in range(0x30000, len(points), 65536)]
    texts += ["", " ", "a", "b", "", "é", "É a", "\0", "ΑΣ Σ İ_1", "x\n", "–", ""]
    made = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = made.repartition(2).select("i", F.lower("text").alias("text"), tokens(F.col("text")).alias("tokens")).toArrow().sort_by("i").combine_chunks()
    for rows in (found, found.slice(len(texts) - 11), found.slice(5, 9)):
        got, lengths = cut(rows["text"].combine_chunks(), word_characters(spark))
        want = rows["tokens"].combine_chunks()
        assert got.to_pylist() == want.flatten().to_pylist() and lengths.tolist() == want.value_lengths().to_pylist()


def test_narrowed_postings_give_the_ranking_of_whole_ones(spark, monkeypatch):
    texts = [(i % 50, " ".join(f"w{(i * j) % 23}" for j in range(i % 9)), f"m{i % 50 % 3}") for i in range(60)]  # ids 0 to 9 stand twice
    docs = spark.createDataFrame([*texts, (50, None, None), (51, "w1 w1 W1 only é", "m1"), (52, "", "m0")], "doc_id int, text string, part string").repartition(5)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w1 w1 É", f"m{q % 3}" if q % 4 else None) for q in range(9)] + [(9, "none of it", "m1"), (10, None, None)], "query_id int, query string, part string")
    rows = lambda df: sorted((r["list"], r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    whole = bm25.lexicon(docs)
    want = rows(bm25.best(whole, asked, 3, lists=[[], ["part"]], held=docs.select("doc_id", "part").distinct()))
    for size in (1, bm25.TEXT_BYTES):  # a piece for each text, and all in one
        monkeypatch.setattr(bm25, "TEXT_BYTES", size)
        made = bm25.narrowed(docs, asked)
        assert made.summary.first() == whole.summary.first()
        assert {r.token: (r.df, round(r.idf, 9)) for r in made.terms.collect()} == {r.token: (r.df, round(r.idf, 9)) for r in whole.terms.collect()}
        assert {t for r in made.postings.collect() for t in r.codes} == set(range(len(made.vocabulary))) - {made.vocabulary.to_pylist().index(t) for t in ("none", "of", "it")}
    assert rows(bm25.best(docs, asked, 3, lists=[[], ["part"]])) == want
    monkeypatch.setattr(bm25, "TASK_ROWS", 1)
    assert rows(bm25.best(docs, asked, 3, lists=[[], ["part"]], block_rows=4)) == want
    monkeypatch.setattr(bm25, "VOCABULARY", 3)  # more tokens than workers hold: whole postings
    assert bm25.narrowed(docs, asked) is None and rows(bm25.best(docs.dropDuplicates(["doc_id"]), asked, 3, lists=[[], ["part"]]))


def test_ranking_shuffles_no_text(spark, monkeypatch):
    """Texts that are ranked once are read once, neither dealt by key nor joined to vectors, and postings of other tokens are not written."""
    plans, written = [], bm25.scratch.written
    monkeypatch.setattr(bm25.scratch, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), written(df, name))[1])
    chunks, asked = corpus_and_questions(spark)
    found = retrieval.ranked_lists(chunks, asked, Settings(), [["measure_id", "plan_year"]], texts=chunks.drop("embedding"))
    plan = dict(plans)["narrowed"]
    assert "Exchange" not in plan and "Join" not in plan and found.where("leg = 'bm25'").count()


def test_tokens_seen_are_summed_in_the_task(spark, monkeypatch):
    """One row for a task's tokens, whatever its number of batches; a row for each batch where its tokens are as many as are held; the same sums."""
    made, written = {}, bm25.scratch.written
    monkeypatch.setattr(bm25.scratch, "written", lambda df, name: made.setdefault(name, written(df, name)))
    docs = spark.createDataFrame([(i, f"common w{i % 3} only{i}") for i in range(40)], "doc_id int, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "common")], "query_id int, query string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for size, rows in ((bm25.SEEN_BYTES, 1), (1, 10)):
            monkeypatch.setattr(bm25, "SEEN_BYTES", size)
            made.clear()
            found = bm25.narrowed(docs, asked)
            assert made["narrowed"].where("seen is not null").count() == rows and made["narrowed"].where("length is not null").count() == 40
            assert {r.token: r.df for r in found.terms.collect()} == {"common": 40, "w0": 14, "w1": 13, "w2": 13, **{f"only{i}": 1 for i in range(40)}}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tokens_are_summed_into_rows_of_a_bounded_size(monkeypatch):
    pieces = [(pa.array(["a", "b"]), np.array([2, 1])), (pa.array(["c", "b", "é"]), np.array([1, 4, 1])), (pa.array([], pa.string()), np.array([], int))]
    for size in (1, 3, 4, 100):
        monkeypatch.setattr(bm25, "SEEN_TOKENS", size)
        rows = bm25._summed(pieces)
        assert len(rows) == -(-4 // size) and sorted((x["token"], x["n"]) for r in rows.to_pylist() for x in r) == [("a", 2), ("b", 5), ("c", 1), ("é", 1)]
    assert bm25._summed(pieces[2:]).to_pylist() == [[]]


def test_products_are_those_of_the_whole_matrix(monkeypatch):
    """Tokens that many questions ask for, few, and none; groups of questions; documents without tokens."""
    rng, tokens, n = np.random.default_rng(1), 30, 12
    whole = np.where(rng.random((tokens, n)) < np.linspace(0, 0.9, tokens)[:, None], rng.random((tokens, n)), 0)
    whole[:, 5] = 0  # a question of no known token
    q, t = np.nonzero(whole.T)
    asked = pa.table({"q": q, "t": t, "w": whole[t, q]})
    docs = np.where(rng.random((20, tokens)) < 0.3, rng.random((20, tokens)), 0)
    docs[7] = 0
    row, code = np.nonzero(docs)
    for common in (1, bm25.COMMON, 99):  # all in the matrix, some, none
        for cells in (1, bm25.CELLS):
            monkeypatch.setattr(bm25, "COMMON", common)
            monkeypatch.setattr(bm25, "CELLS", cells)
            groups = bm25._matrices(tokens, asked, n)
            got = np.hstack([bm25._products(20, row, code, docs[row, code], g) for g in groups])
            assert len(groups) == (n if cells == 1 else 1) and np.allclose(got, docs @ whole, rtol=0, atol=1e-12)
    monkeypatch.setattr(bm25, "COMMON", 4)
    assert bm25._matrices(tokens, asked, n)[0][2].shape[0] < len(set(t))


def test_terms_of_the_corpus_are_not_dealt_for_a_few_questions(spark, monkeypatch):
    plans, written = {}, bm25.scratch.written
    monkeypatch.setattr(bm25.scratch, "written", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    chunks, asked = corpus_and_questions(spark)
    assert bm25.best(chunks, asked, 3).count()
    assert "BroadcastHashJoin" in plans["asked"] and "hashpartitioning" not in plans["asked"] and "SortMergeJoin" not in plans["asked"]


def normalised(spark, texts):
    section = "struct<kind:string,heading:string,text:string,page:int>"
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, t string")
    general = F.array(F.struct(F.lit("general").alias("kind"), F.lit("h").alias("heading"), F.col("t").alias("text"), F.lit(1).alias("page")))
    return rows.select("doc_id", F.lit("T").alias("title"), F.lit("p").alias("publisher"), F.lit("u").alias("source_url"), F.lit(2026).alias("plan_year"), F.lit("t").alias("doc_type"), F.lit("redistributable").alias("license_posture"), F.lit("x").alias("retrieval_date"),
        F.expr(f"cast(array() as array<struct<measure_id:string,measure_name:string,sections:array<{section}>>>)").alias("measures"), general.cast(f"array<{section}>").alias("general_sections"))


def test_stale_postings_are_found(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(normalised(spark, ["eye exam", "flu shot", "blood pressure"]), path)
    assert index.verify(spark, path)["chunk_count"] == 3
    found = bm25.scores(index.lexicon(spark, path), spark.createDataFrame([(1, "flu")], "query_id int, query string")).collect()
    chunk = index.chunks(spark, path).where("text = 'flu shot'").first().chunk_id
    assert [r.doc_id for r in found] == [chunk]
    bm25.write(spark.createDataFrame([("c", "other")], "chunk_id string, text string"), f"{index.current(spark, path)}/lexicon", key="chunk_id")
    with pytest.raises(index.StaleIndexError, match="postings of 1 chunks"):
        index.verify(spark, path)
    shutil.rmtree(f"{index.current(spark, path)}/lexicon/summary")
    with pytest.raises(index.StaleIndexError, match="can't be read"):
        index.verify(spark, path)


def test_only_what_is_new_is_embedded(spark, tmp_path):
    path, asked = str(tmp_path / "index"), []

    def embed(texts):
        asked.append(sorted(r.text.split("\n")[1] for r in texts.collect()))
        return texts.select("chunk_id", F.array(F.length("text").cast("float")).alias("embedding"))

    index.build(normalised(spark, ["eye exam", "flu shot"]), path)  # without vectors
    one = index.build(normalised(spark, ["eye exam", "flu shot", "blood pressure"]), path, embed=embed)
    assert one["statuses"] == {"added": 1, "changed": 0, "kept": 2, "removed": 0} and asked.pop() == ["blood pressure", "eye exam", "flu shot"]
    retitled = normalised(spark, ["eye exam", "flu jab", "blood pressure"]).withColumn("title", F.when(F.col("doc_id") == "d2", "U").otherwise(F.col("title")))
    two = index.build(retitled, path, embed=embed)
    assert two["statuses"] == {"added": 1, "changed": 1, "kept": 1, "removed": 1} and asked.pop() == ["blood pressure", "flu jab"]
    whole = str(tmp_path / "whole")
    index.build(retitled, whole, embed=embed)
    for of in (index.chunks, index.vectors, lambda s, p: index.lexicon(s, p).terms, lambda s, p: index.lexicon(s, p).postings):
        assert sorted(map(str, of(spark, path).collect())) == sorted(map(str, of(spark, whole).collect()))
    assert index.build(normalised(spark, []), path, embed=embed)["statuses"]["removed"] == 3


def test_a_build_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "index")

    def dies(texts):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        index.build(normalised(spark, ["a b"]), path, embed=dies)
    with pytest.raises(index.StaleIndexError, match="no index stamp"):
        index.verify(spark, path)
    first = index.build(normalised(spark, ["eye exam", "flu shot"]), path)
    reader = index.chunks(spark, path)
    with pytest.raises(RuntimeError):
        index.build(normalised(spark, ["flu shot", "other"]), path, embed=dies)
    assert index.verify(spark, path) == first and index.chunks(spark, path).count() == 2
    index.build(normalised(spark, ["other"]), path)
    assert reader.count() == 2 and index.chunks(spark, path).count() == 1  # who began before goes on
    index.build(normalised(spark, ["more"]), path)
    assert len(list((tmp_path / "index" / "versions").iterdir())) == 2


def test_a_broken_stamp_shows_no_content(spark, tmp_path):
    path = tmp_path / "index"
    index.build(normalised(spark, ["eye exam"]), str(path))
    for text in ('{"secret": 1', '["secret"]', '{"embedding_model": "secret"}', ""):
        (path / "stamp.json").write_text(text)
        (path / ".stamp.json.crc").unlink(missing_ok=True)
        with pytest.raises(index.StaleIndexError) as e:
            index.verify(spark, str(path))
        assert "secret" not in str(e.value) and "can't be read" in str(e.value)


def test_differences(spark):
    held = spark.createDataFrame([("a", "x", None), ("b", "x", "y"), ("c", "x", "y"), ("d", None, "-")], "chunk_id string, text string, header string")
    new = spark.createDataFrame([("a", "x", None), ("b", "x", "z"), ("d", "-", None), ("e", "", "")], held.schema)
    assert dict(index.differences(held, new).collect()) == {"a": "kept", "b": "changed", "c": "removed", "d": "changed", "e": "added"}


def corpus_and_questions(spark):
    chunks = spark.createDataFrame([(i, f"common w{i % 7} v{i % 3}", f"m{i % 4}", 2025 + i % 2, [float(i % 5), float(i % 11), 1.0] if i % 6 else None) for i in range(200)], "doc_id int, text string, measure_id string, plan_year int, embedding array<float>")
    asked = [(1, "common w1", ["m1"], 2025, [1.0, 0.0, 0.0]), (2, "w2 v1", None, 2026, None), (3, "common", ["m0", "m3"], None, [0.0, 1.0, 0.0]), (4, "w3", ["none"], 2025, [1.0, 1.0, 0.0]), (5, "nothing", [], None, [0.0, 0.0, 1.0])]
    return chunks, spark.createDataFrame(asked, "query_id int, query string, measure_id array<string>, plan_year int, embedding array<float>")


def test_lists_of_one_scoring_are_those_of_a_scoring_each(spark):
    """Several filters at once, against each list made alone from all pairs."""
    chunks, asked = corpus_and_questions(spark)
    lists = [["measure_id", "plan_year"], ["plan_year"], []]
    found = retrieval.ranked_lists(chunks, asked, Settings(), lists)
    all_words = bm25.scores(chunks.select("doc_id", "text"), asked.select("query_id", "query"))
    all_vectors = dense.top_k(chunks.select("doc_id", "embedding"), asked.select("query_id", "embedding"), 1000).select("query_id", "doc_id", "score")
    want_of, held_of = {r.query_id: r for r in asked.collect()}, {r.doc_id: r for r in chunks.collect()}
    for n, group in enumerate(lists):
        for leg, pairs in (("dense", all_vectors), ("bm25", all_words)):
            by = {}
            for r in pairs.collect():
                q, c = want_of[r.query_id], held_of[r.doc_id]
                if ("measure_id" not in group or not q.measure_id or c.measure_id in q.measure_id) and ("plan_year" not in group or q.plan_year in (None, c.plan_year)):
                    by.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
            want = {(q, d, k + 1) for q, rows in by.items() for k, (_, d) in enumerate(sorted(rows)[:20])}
            assert {(r.query_id, r.doc_id, r["rank"]) for r in retrieval.list_of(found, n, leg).collect()} == want


def test_arms_are_those_of_single_calls(spark):
    chunks, asked = corpus_and_questions(spark)
    both = retrieval.arms(chunks, asked, measure="measure_id", year="plan_year", lexical=(True, False))
    for found, lexical in zip(both, (True, False), strict=True):
        alone = retrieval.retrieve(chunks, asked, measure="measure_id", year="plan_year", lexical=lexical)
        assert sorted(found.collect(), key=str) == sorted(alone.collect(), key=str)
    assert both[1].where("not used_fallback and bm25_rank is not null").count() == 0 < both[0].where("bm25_rank is not null").count()


def test_dense_filters_of_many_values(spark):
    """Each question its own list; values that no candidate has, and null values, match nothing."""
    v = spark.createDataFrame([(i, [1.0, i / 100], None if i % 10 == 0 else f"g{i % 10}") for i in range(100)], "doc_id long, embedding array<float>, g string")
    q = spark.createDataFrame([(i, [1.0, 0.0], [f"g{i % 10}", f"g{i}"]) for i in range(1, 40)], "query_id long, embedding array<float>, g array<string>")
    got = dense.top_k(v, q, 3, groups="g").collect()
    for i in range(1, 40):
        want = sorted(d for d in range(100) if d % 10 and (d % 10 == i % 10 or d % 10 == i))[:3]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want
