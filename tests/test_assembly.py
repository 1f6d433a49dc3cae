"""Extracted texts to nested documents and on to chunks; sections nested and laid flat again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from groundsearch.__main__ import main
from groundsearch.operators import assembly, chunking, parsing
from groundsearch.plans import index
from groundsearch.schemas import NORMALIZED_DOC
from groundsearch.sources import corpus

NOTES = (
    "\x00PAGE:1\x00\nWords that lead in\nMeasure: C01 - Breast Cancer ..... 9\nMeasure: D02 - Statin ..... 10\n"
    "\x00PAGE:2\x00\nMeasure: C01 - Breast Cancer Screening\n Label for Stars: BCS\nMetric: share\nof women\nMeasure:  C09 –  see page ..... 4\nmore\n"
    "\x00PAGE:3\x00\nMeasure: D02: Statin Use\nMetric: other ␞ one ␟ of ␛1\nExclusions: \nWeird: x\n"
)
ROW = {"title": "T", "publisher": "p", "source_url": "http://x/y.pdf", "sha256": "0", "retrieval_date": "2026-01-01", "plan_year": 2026, "doc_type": "t", "license_posture": "redistributable", "commit_policy": "commit_normalized"}


def manifest_rows(spark, *docs):
    names = [f.split()[0] for f in corpus.MANIFEST.split(", ")]
    return spark.createDataFrame([tuple({**ROW, "doc_id": doc_id, "parser_id": parser}.get(n) for n in names) for doc_id, parser in docs], corpus.MANIFEST)


def with_texts(spark, *docs):
    texts = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id string, text string")
    return manifest_rows(spark, *[(d, p) for d, p, _ in docs]).join(texts, "doc_id")


def test_parsed(spark):
    docs = with_texts(spark, ("n", "technical_notes", NOTES), ("p", "generic_pdf", NOTES), ("e", "generic_pdf", ""), ("z", "technical_notes", None), ("t", "technical_notes", "no measure here"))
    got = {r.doc_id: r for r in assembly.parsed(docs).collect()}
    assert set(got) == {"n", "p", "e", "z", "t"} and all(got[d].measures == [] == got[d].general_sections for d in "ezt")
    one, two = got["n"].measures
    assert (one.measure_id, one.measure_name) == ("C01", "Breast Cancer Screening") and (two.measure_id, two.measure_name) == ("D02", "Statin Use")
    # A heading with a dot leader is no end of its measure, and stays as it stands.
    assert [tuple(s) for s in one.sections] == [("description", "Label for Stars", "BCS", 2), ("description", "Metric", "share of women Measure: C09 – see page ..... 4 more", 2)]
    assert [tuple(s) for s in two.sections] == [("description", "Metric", "other ␞ one ␟ of ␛1", 3), ("exclusions", "Exclusions", "Weird: x", 3)]
    assert [tuple(s) for s in got["n"].general_sections] == [("general", "Introduction", "Words that lead in", 1)]
    assert [(s.heading, s.page) for s in got["p"].general_sections] == [("Page 1", 1), ("Page 2", 2), ("Page 3", 3)]
    with pytest.raises(corpus.CorpusError, match="'h'"):
        assembly.parsed(with_texts(spark, ("h", "ncqa_summary_html", "x")))


def test_introductions(spark):
    texts = {"first": "Measure: C01 - A\nMetric: x\n", "other": "lead\nMeasure: D03 - B ..... 2\nmore\nMeasure: C04 - B\nMetric: y\n", "none": "lead\nMeasure: D03 - B ..... 2\n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id: r.text for r in parsing.introductions(df).collect()} == {"other": "lead Measure: D03-B ..... 2 more"}  # the spaces of a hyphen go, as in any block


def test_the_order_is_that_of_positions(spark):
    rows = [(d, None if m < 0 else f"C{m:02d}", None if m < 0 else "N", max(m, 0), s, "general", f"h{m}.{s}", "text", s) for d in ("a", "b") for m in (-1, 0, 1, 11) for s in (0, 2, 10)]
    schema = "doc_id string, measure_id string, measure_name string, m_pos int, s_pos int, kind string, heading string, text string, page int"
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("a", 5)], "doc_id string, measures int")
    random.Random(3).shuffle(rows)
    several = []
    for n in (1, 3, 8):
        got = assembly.nested(spark.createDataFrame([*rows, ("x", "C1", "N", 0, 0, "k", "h", "lost", 1), ("c", "C1", "N", 0, 0, "k", "h", "", 1)], schema).repartition(n), docs).collect()
        several.append(sorted((str(r.doc_id), json.dumps(r.asDict(recursive=True))) for r in got))
    assert several[0] == several[1] == several[2] and [d for d, _ in several[0]] == ["None", "a", "a", "b", "c"]
    a = json.loads(several[0][1][1])
    assert [s["heading"] for s in a["general_sections"]] == ["h-1.0", "h-1.2", "h-1.10"]
    assert [[s["heading"] for s in m["sections"]] for m in a["measures"]] == [[f"h{m}.{s}" for s in (0, 2, 10)] for m in (0, 1, 11)]
    empty = assembly.nested(spark.createDataFrame([], schema), docs)
    assert all(r.measures == r.general_sections == [] for r in empty.collect()) and assembly.nested(spark.createDataFrame(rows, schema), docs.limit(0)).count() == 0


def test_flat_and_nested_are_inverse(spark, tmp_path):
    docs = assembly.parsed(with_texts(spark, *[(f"d{i}", ("technical_notes", "generic_pdf")[i % 2], NOTES.replace("Statin", f"Name {i}") * (1 + i % 3)) for i in range(12)]))
    manifest = manifest_rows(spark, *[(f"d{i}", "generic_pdf") for i in range(12)])
    whole = sorted(map(str, docs.collect()))
    sections = chunking.sections_of(docs).drop("title", "plan_year", "license_posture", "source_url")
    assert sorted(map(str, assembly.nested(sections, docs).select(*docs.columns).collect())) == whole
    # Written one document a file, none is lost in reading.
    path = str(tmp_path / "docs")
    corpus.write_normalized(docs.coalesce(2), manifest, path)
    again = corpus.load_normalized(spark, path)
    assert sorted(map(str, again.collect())) == whole and again.schema == spark.createDataFrame([], NORMALIZED_DOC).schema
    ids = lambda d: sorted(r.chunk_id for r in chunking.chunk_documents(d).collect())
    assert ids(docs) == ids(again) and len(ids(docs)) > 24
    corpus.write_normalized(docs, manifest.where("doc_id <> 'd3'").unionByName(manifest.where("doc_id = 'd3'").withColumn("commit_policy", F.lit("fetch_only"))), path)
    assert corpus.load_normalized(spark, path).count() == 11


def test_build_from_texts(spark, tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    texts, source, path = tmp_path / "texts", str(tmp_path / "source"), str(tmp_path / "index")
    texts.mkdir()
    rows = [{**ROW, "doc_id": d, "parser_id": p} for d, p in (("n", "technical_notes"), ("p", "generic_pdf"))]
    rows.append({**ROW, "doc_id": "web", "parser_id": "ncqa_summary_html", "license_posture": "public_web_cite_only", "commit_policy": "fetch_only"})
    manifest = tmp_path / "manifest.yaml"
    manifest.write_text(yaml.safe_dump({"documents": rows}))
    corpus_args = ["build", "--source", source, "--index", path, "--texts", str(texts), "--manifest", str(manifest)]
    (texts / "n.txt").write_text(NOTES)
    with pytest.raises(corpus.CorpusError, match="'p'"):
        main(corpus_args)
    (texts / "p.txt").write_text(NOTES)
    assert main(corpus_args) == 0
    first = json.loads(capsys.readouterr().out)
    assert first["chunk_count"] == index.chunks(spark, path).count() == 8
    (texts / "n.txt").write_text(NOTES.replace("of women", "of men"))
    assert main(corpus_args) == 0  # the source is there, and stays
    assert json.loads(capsys.readouterr().out)["statuses"]["kept"] == 8
    assert main([*corpus_args, "--renormalize"]) == 0
    assert json.loads(capsys.readouterr().out)["statuses"] == {"added": 1, "changed": 0, "kept": 7, "removed": 1}
    with pytest.raises(SystemExit):
        main(["build", "--source", source, "--index", path, "--renormalize"])


def test_texts_are_cut_once_for_measures_and_introductions(spark):
    docs = spark.createDataFrame([("n", "technical_notes", "Intro.\n\0PAGE:2\0\nMeasure: C01 - One\nMetric: a\nTitle: b\n")], "doc_id string, parser_id string, text string")
    whole = assembly.parsed(docs.select("*", *[F.lit(None).cast("int" if c == "plan_year" else "string").alias(c) for c in assembly.FIELDS if c not in docs.columns]))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count(r"([CD]\d{2})") == 1  # the expression that cuts texts at headings
    row = whole.first()
    assert [(m.measure_id, [s.text for s in m.sections]) for m in row.measures] == [("C01", ["a", "b"])] and [s.text for s in row.general_sections] == ["Intro."]
