"""Citations, outcomes, metrics, the ratchet, the judge, the index and the sources."""

import json

import pytest
from pyspark.sql import functions as F

from groundsearch.operators import answering, evaluation
from groundsearch.plans import index
from groundsearch.sources import corpus


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_markers(spark):
    t = F.col("t")
    assert one(spark, answering.markers(t), "74% [1][2]. See page 5 [10].") == [1, 2, 10]
    assert one(spark, answering.invalid_markers(t, F.lit(3)), "[9] [7] [9] [0] [1]") == [0, 7, 9]
    assert one(spark, answering.cited(t, F.lit(3)), "B [2]. A [1]. B again [2]. C [3].") == [2, 1, 3]
    assert one(spark, answering.citations_valid(t, F.lit(3)), "none") is False
    assert "[7], [9]" in one(spark, answering.correction_hint(t, F.lit(3)), "x [9][7]")


def test_outcomes(spark):
    rows = [
        (0, 0.9, True, "a [1]", None, "refused_low_confidence"),
        (3, 0.1, True, "a [1]", None, "refused_low_confidence"),
        (3, None, False, None, None, "retrieval_only"),
        (3, 0.9, True, "a [1]", None, "answered"),
        (3, 0.9, True, answering.REFUSAL, None, "refused_by_model"),
        (3, 0.9, True, "a [9]", "b [1]", "answered"),
        (3, 0.9, True, "a", answering.REFUSAL, "refused_by_model"),
        (3, 0.9, True, "a", "b [4]", "refused_citation_invalid"),
    ]
    df = spark.createDataFrame(rows, "n int, s double, m boolean, f string, g string, want string")
    got = df.select("want", answering.outcome(F.col("n"), F.col("s"), F.col("m"), F.col("f"), F.col("g")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_title(spark):
    assert one(spark, answering.title(F.col("t"), F.lit("d")), "[Notes | C01 x | Metric | 2026]") == "Notes"
    assert one(spark, answering.title(F.col("t"), F.lit("d")), "[]") == "d"


def metrics(spark):
    items = spark.createDataFrame([("i", "eligibility", "test", False, None), ("t", "refusal_x", "test", True, True)], "item_id string, category string, split string, is_refusal boolean, refused boolean")
    ranked = spark.createDataFrame([("i", c, n) for n, c in enumerate(["miss", "g1", "other"], 1)], "item_id string, chunk_id string, rank int")
    return evaluation.item_metrics(items, ranked, spark.createDataFrame([("i", "g1"), ("i", "g2")], "item_id string, chunk_id string"))


def test_metrics_and_report(spark):
    got = {(r.item_id, r.metric): r.value for r in metrics(spark).collect()}
    assert got == {("i", "hit@1"): 0, ("i", "mrr"): 0.5, ("i", "precision@8"): 0.125, ("i", "recall@5"): 0.5, ("i", "recall@8"): 0.5, ("t", "refused"): 1}
    report = evaluation.report(metrics(spark))
    rows = {(r.scope, r.name, r.metric) for r in report.collect()}
    assert ("category", "refusal_x", "refused") in rows and ("overall", "", "refused") not in rows
    assert evaluation.published(report)["mrr"] == 0.5
    assert evaluation.refusal_accuracy(metrics(spark)).first()[0] == 1.0
    with pytest.raises(ValueError):
        evaluation.item_metrics(None, None, None, ks=(0,))


def test_an_answerable_item_without_gold_is_an_error(spark):
    items = spark.createDataFrame([("a", False), ("b", False), ("trap", True)], "item_id string, is_refusal boolean")
    gold = spark.createDataFrame([("a", "c")], "item_id string, chunk_id string")
    with pytest.raises(evaluation.DatasetError, match=r"\['b'\]"):
        evaluation.require_gold(items, gold)
    evaluation.require_gold(items.where("item_id <> 'b'"), gold)


def test_ratchet():
    assert evaluation.regressions({"mrr": 0.80}, {"mrr": 0.85})
    assert not evaluation.regressions({"mrr": 0.84}, {"mrr": 0.85})
    assert not evaluation.regressions({"mrr": 0.83}, {"mrr": 0.85})
    assert evaluation.regressions({}, {"recall@8": 0.85}) == ["recall@8: missing from report (baseline 0.8500)"]
    assert not evaluation.regressions({}, {"hit@1": 1.0})


def test_ratchet_gates_the_test_split(spark):
    rows = [("overall", "", "mrr", 0.9), ("split", "test", "mrr", 0.5), ("split", "dev", "mrr", 1.0)]
    report, base = spark.createDataFrame(rows, "scope string, name string, metric string, value double"), spark.createDataFrame([("mrr", 0.9), ("hit@1", 1.0)], "metric string, baseline double")
    assert [(r.metric, r.value, r.regressed) for r in evaluation.ratchet(report, base).collect()] == [("mrr", 0.5, True)]
    assert [r.regressed for r in evaluation.ratchet(report.where("name <> 'test'"), base).collect()] == [False]


def test_violations_and_labels(spark):
    from groundsearch.schemas import GOLD_ITEM

    gold = [("d", "Breast", "coding")]
    items = [("a", "q", "coding", "test", gold, "r"), ("a", "q", "coding", "test", gold, " "), ("b", "q", "refusal_x", "dev", gold, None), ("c", "q", "coding", "dev", [], "r")]
    got = sorted((r.item_id, r.problem) for r in evaluation.violations(spark.createDataFrame(items, GOLD_ITEM)).collect())
    assert [g[0] for g in got] == ["a", "a", "b", "c"]
    labels = spark.createDataFrame([("1", "a", "d", "coding", "BREAST"), ("2", "a", "d", "coding", None), ("3", "a", "d", "coding", "none such")], "label_id string, item_id string, doc_id string, section string, measure_name_contains string")
    chunks = spark.createDataFrame([("x", "d", "coding", "Breast Cancer"), ("y", "d", "coding", None), ("z", "e", "coding", "Breast")], "chunk_id string, doc_id string, section string, measure_name string")
    matches = evaluation.label_matches(labels, chunks)
    assert sorted((r.label_id, r.chunk_id) for r in matches.collect()) == [("1", "x"), ("2", "y")]
    assert [r.label_id for r in evaluation.unresolved(labels, matches).collect()] == ["3"]


def test_judge(spark):
    claim = lambda v, **k: {"claim": "c", "verdict": v, **k}
    good = json.dumps({"claims": [claim("supported", citation_valid=True), claim("supported", citation_valid=False), claim("unsupported"), claim("contradicted")], "notes": "n"})
    for text in (good, f"Sure:\n{good}\nbye", f"```json\n{good}\n```", "{not json} but: " + good):
        df = spark.createDataFrame([(text,)], "t string").select(*evaluation.verdict_counts(evaluation.judged(F.col("t"))))
        assert tuple(df.first()) == (4, 2, 1, 1, 0.5, 0.5)
    none = spark.createDataFrame([("no json",), ('{"verdicts": []}',)], "t string").select(*evaluation.verdict_counts(evaluation.judged(F.col("t")))).collect()
    assert all(r.claims_total is None for r in none)
    empty = spark.createDataFrame([('{"claims": []}',)], "t string").select(*evaluation.verdict_counts(evaluation.judged(F.col("t")))).first()
    assert empty.claims_total == 0 and empty.faithfulness is None
    asked = one(spark, evaluation.judge_input(F.lit("Which?"), F.lit("A [1]."), F.array(F.lit("p one"), F.lit("p two"))), "")
    assert "[2] p two" in asked and asked.index("PASSAGES:") < asked.index("QUESTION:") < asked.index("ANSWER:")


def test_report_files(tmp_path):
    artifact = {"metrics": {"overall": {"mrr": 0.5}, "dense_only_overall": {"mrr": 0.25}}, "config_hash": "abc"}
    readme = tmp_path / "R.md"
    readme.write_text(f"top\n{evaluation.BEGIN}\nold\n{evaluation.END}\nend\n")
    once = evaluation.sync_region(readme, artifact)
    assert "| mrr | 0.500 | 0.250 |" in once and "old" not in once and evaluation.sync_region(readme, artifact) == once
    with pytest.raises(ValueError):
        evaluation.write_artifact(tmp_path / "a.json", {"x": float("nan")})
    readme.write_text("none")
    with pytest.raises(evaluation.DatasetError):
        evaluation.sync_region(readme, artifact)


def test_index(spark, tmp_path):
    from groundsearch.config import Settings
    from groundsearch.schemas import NORMALIZED_DOC

    doc = ("d", "T", "p", "u", 2026, "t", "redistributable", "x", [], [("general", "I", "Hello", 1)])
    path = str(tmp_path / "index")
    with pytest.raises(index.StaleIndexError):
        index.verify(spark, path)
    index.build(spark.createDataFrame([doc], NORMALIZED_DOC), path)
    assert index.verify(spark, path)["chunk_count"] == 1
    with pytest.raises(index.StaleIndexError, match="was built with"):
        index.verify(spark, path, Settings(chunk_max_tokens=10))
    (tmp_path / "index" / "stamp.json").write_text("secret {")
    with pytest.raises(index.StaleIndexError) as e:
        index.verify(spark, path)
    assert "secret" not in str(e.value)


def test_sources(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.pdf").write_bytes(b"one")
    import hashlib

    row = ("a", "T", "p", "http://x/y.pdf?q=1", hashlib.sha256(b"one").hexdigest(), "2026-01-01", 2026, "t", "redistributable", "commit_normalized", "generic_pdf")
    manifest = spark.createDataFrame([row], corpus.MANIFEST)
    corpus.check_manifest(manifest)
    assert corpus.verify_raw(corpus.read_raw(spark, str(raw)), manifest).count() == 1
    (raw / "a.pdf").write_bytes(b"two")
    with pytest.raises(corpus.IntegrityError):
        corpus.verify_raw(corpus.read_raw(spark, str(raw)), manifest)
    with pytest.raises(corpus.CorpusError):
        corpus.check_manifest(spark.createDataFrame([(*row[:8], "public_web_cite_only", *row[9:])], corpus.MANIFEST))
    with pytest.raises(KeyError):
        corpus.by_id(manifest, "b")
    lines = tmp_path / "gold.jsonl"
    lines.write_text('{"item_id": "a", "question": "q"}\n\n{bad\n')
    with pytest.raises(corpus.CorpusError, match="3"):
        corpus.load_gold(spark, str(lines))
    lines.write_text('{"chunk_id": "c", "text": "old"}\n\n{"chunk_id": "c", "text": "new"}\n')
    assert [r.text for r in corpus.read_chunk_lines(spark, str(lines)).collect()] == ["new"]
