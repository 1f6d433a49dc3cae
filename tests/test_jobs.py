"""The jobs over growing input, reruns, lost checkpoints and odd rows; their command lines."""

import logging
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundsearch.operators import bm25, containment
from jobs import common, evaluate_retrieval, refresh_passages

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def halves(spark, tmp_path):
    """Two files of the same table, the second with copies of texts of the first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000)
    parts = docs.where("doc_id < 100"), docs.where("doc_id >= 100").unionByName(again)
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    return docs, again


def arrive(tmp_path, n):
    (tmp_path / "docs").mkdir(exist_ok=True)
    for f in (tmp_path / f"part{n}").glob("*.parquet"):
        shutil.copy(f, tmp_path / "docs" / f"{n}-{f.name}")


def test_passages_of_growing_documents(spark, tmp_path, caplog):
    docs, again = halves(spark, tmp_path)
    place = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]
    caplog.set_level(logging.INFO, "groundsearch.jobs")
    arrive(tmp_path, 0)
    (one,) = refresh_passages.run(spark, *place)
    before = rows(refresh_passages.store(spark, place[1]))
    assert (one["batch"], one["documents_read"], one["passages_written"]) == (0, 100, len(before))
    assert refresh_passages.run(spark, *place) == [] and rows(refresh_passages.store(spark, place[1])) == before
    arrive(tmp_path, 1)
    (two,) = refresh_passages.run(spark, *place)
    after = refresh_passages.store(spark, place[1])
    assert (two["batch"], two["documents_read"]) == (1, docs.count() - 100 + 20)
    assert rows(after.where("batch = 0")) == before and after.where("doc_id >= 10000").count() == 0
    assert f"read {two['documents_read']} documents, wrote {two['passages_written']} passages" in caplog.text
    # as many passages, of the same ids and texts, as all documents at once have
    whole = refresh_passages.passages(docs.unionByName(again), refresh_passages.DEFAULTS)
    assert rows(after.select("chunk_id", "text", "header")) == rows(whole.select("chunk_id", "text", "header"))
    assert after.count() == after.select("chunk_id").distinct().count()
    assert {p.name for p in Path(place[1]).glob("batch=*/lang=*")} >= {"lang=en", "lang=de"}


def test_a_batch_that_failed_after_writing_is_repeated(spark, tmp_path):
    halves(spark, tmp_path)
    place = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]
    for n in (0, 1):
        arrive(tmp_path, n)
        refresh_passages.run(spark, *place)
    want = rows(refresh_passages.store(spark, place[1]))
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):  # as if the driver had died before the commit
        f.unlink()
    (again,) = refresh_passages.run(spark, *place)
    assert again["batch"] == 1 and rows(refresh_passages.store(spark, place[1])) == want


def test_a_lost_checkpoint_adds_nothing(spark, tmp_path):
    halves(spark, tmp_path)
    place = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]
    for n in (0, 1):
        arrive(tmp_path, n)
        refresh_passages.run(spark, *place)
    want = rows(refresh_passages.store(spark, place[1]).drop("batch"))
    refresh_passages.run(spark, place[0], place[1], str(tmp_path / "new"))
    assert rows(refresh_passages.store(spark, place[1]).drop("batch")) == want


def test_batches_of_few_files_give_the_same_passages(spark, tmp_path):
    halves(spark, tmp_path)
    arrive(tmp_path, 0)
    arrive(tmp_path, 1)
    place = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]
    assert len(refresh_passages.run(spark, *place, {"max_files": 1})) == 2
    refresh_passages.run(spark, place[0], str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))
    ids = [rows(refresh_passages.store(spark, str(tmp_path / x)).select("chunk_id", "text")) for x in ("out", "out2")]
    assert ids[0] == ids[1]


def test_passages_of_odd_documents(spark, tmp_path):
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "same", "en", "s"), (3, "same", "en", "s"), (4, "same", "de", "s"), (5, "same", None, None), (6, "x " * 20_000, "en", "s"), (None, "no id", "en", "s"), (7, "no id", "en", "s"), (8, " \n", "en", "s")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string").withColumn("batch", F.lit(7)).withColumn("chunk_id", F.lit("mine"))
    df.write.parquet(str(tmp_path / "docs"))
    refresh_passages.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = refresh_passages.store(spark, str(tmp_path / "out"))
    assert rows(got.where("text in ('same', 'no id')").select("doc_id", "text", "source", "lang", "batch")) == sorted([(3, "same", "s", "en", 0), (5, "same", "", None, 0), (None, "no id", "s", "en", 0)], key=str)
    long = got.where("doc_id = 6")
    assert long.agg(F.max("tokens")).first()[0] <= 480 and long.count() == long.select("text").distinct().count() > 0 == got.where("doc_id in (1, 2)").count()
    df.where("false").write.parquet(str(tmp_path / "none"))
    refresh_passages.run(spark, str(tmp_path / "none"), str(tmp_path / "out0"), str(tmp_path / "c0"))
    assert refresh_passages.store(spark, str(tmp_path / "out0")).count() == 0


def test_settings():
    assert common.settings({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="unknown settings: c"):
        common.settings({"a": 1}, {"c": 3})


TEXTS = [(1, "The cat sat on the mat. A dog ran."), (2, "cat sat on the matter"), (3, "THE CAT SAT ON THE MAT"), (4, None), (5, ""), (6, "a b c"), (7, "x" * 50_000 + " cat sat on y"), (1_000, "sat on the mat"), (8, "été à la mer, été")]
PASSAGES = [(1, "cat sat on the mat"), (2, "at sat on th"), (3, "dog"), (4, "b"), (5, None), (6, ""), (7, "no such words here"), (8, "cat nowhere mat"), (9, "té à la me"), (10, ". A dog r"), (11, "  "), (1, "cat sat on the mat")]


def test_containment_against_all_pairs(spark, monkeypatch):
    docs, asked = spark.createDataFrame(TEXTS, "doc_id bigint, text string"), spark.createDataFrame(PASSAGES, "item_id bigint, text string")
    want = sorted((i, d) for i, p in set(PASSAGES) for d, t in TEXTS if p and t and p in t)
    lexicon = bm25.lexicon(docs)
    assert sorted(set(map(tuple, containment.holding(asked, docs, lexicon).collect()))) == want
    monkeypatch.setattr(containment, "BLOCK", 1)
    assert sorted(set(map(tuple, containment.holding(asked, docs, lexicon).collect()))) == want
    assert containment.candidates(asked.where("item_id in (7, 8)"), lexicon).count() == 0  # a word that no text holds, or only together with no other


def test_containment_on_real_texts(spark):
    docs, asked = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((r.item_id, d) for r in asked.collect() for d, t in texts if r.text in t)
    lexicon = bm25.lexicon(docs)
    assert rows(containment.holding(asked, docs, lexicon)) == sorted(want, key=str) and len(want) > 20
    pairs = containment.candidates(asked, lexicon).count()
    assert len(want) <= pairs < asked.count() * docs.count() / 20


def test_report_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "en"), (2, "delta epsilon zeta eta", "de"), (3, "alpha beta gamma theta", None), (4, None, "en"), (5, "noise", "en")], "doc_id bigint, text string, lang string").withColumn("rank", F.lit(0))
    items = spark.createDataFrame([(10, "alpha beta gamma"), (11, "delta epsilon zeta"), (12, "nowhere"), (13, None)], "item_id bigint, text string").withColumn("query", F.lit("mine"))
    docs.write.parquet(str(tmp_path / "d"))
    items.write.parquet(str(tmp_path / "b"))
    place = [str(tmp_path / x) for x in ("d", "b", "out")]
    assert evaluate_retrieval.run(spark, *place) == []
    got = evaluate_retrieval.read(spark, place[2])
    by = {(r.scope, r.name, r.metric): r.value for r in got.collect()}
    assert [by["item", str(i), "documents"] for i in (10, 11, 12, 13)] == [2, 1, 0, 0] and by["item", "10", "recall@8"] == by["item", "11", "mrr"] == 1
    assert ("item", "12", "mrr") not in by and by["overall", "", "mrr"] == by["category", "en", "mrr"] == by["category", "de", "hit@1"] == 1
    before = rows(got)
    assert evaluate_retrieval.run(spark, *place) == [] and rows(evaluate_retrieval.read(spark, place[2])) == before
    assert evaluate_retrieval.run(spark, *place, {"baseline": {"mrr": 1.5, "recall@8": 0.5}}) == ["mrr"]
    docs.where("false").write.parquet(str(tmp_path / "d0"))
    assert evaluate_retrieval.run(spark, str(tmp_path / "d0"), *place[1:]) == ["mrr", "recall@8"]


def command(job, *args):
    return subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *args], cwd="/tmp", capture_output=True, text=True, timeout=240)


def test_command_lines(tmp_path):
    out = ["--out", str(tmp_path / "p"), "--checkpoint", str(tmp_path / "c")]
    done = command("refresh_passages", "--documents", f"{SF}/documents.parquet", *out, "--config", str(ROOT / "jobs" / "refresh_passages.json"))
    assert done.returncode == 0 and "read 200 documents, wrote" in done.stderr, done.stderr[-2000:]
    high = tmp_path / "high.json"
    high.write_text('{"baseline": {"mrr": 2.0}}')
    done = command("evaluate_retrieval", "--documents", f"{SF}/documents.parquet", "--benchmark", f"{SF}/benchmark.parquet", "--out", str(tmp_path / "r"), "--config", str(high), "--gate")
    assert done.returncode == 1 and "below the baseline: mrr" in done.stderr, done.stderr[-2000:]


def test_only_rarest_tokens_of_postings_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "a cat sat on it"), (2, "the cat sat down"), (3, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(7, "cat sat on"), (8, "a cat sat"), (9, "no such word")], "item_id int, text string")
    lexicon = bm25.lexicon(docs)
    plan = containment.candidates(passages, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, containment.holding(passages, docs, lexicon).collect())) == [(7, 1), (8, 1)]
