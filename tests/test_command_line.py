"""The command line, end to end on a small corpus."""

import json

from pyspark.sql import functions as F

from groundsearch.__main__ import main
from groundsearch.config import Settings
from groundsearch.plans import index


def by_letter(texts):
    """A made-up model: texts that speak of vaccines lie one way, all others another."""
    flu = F.lower("text").contains("vaccin") | F.lower("text").contains("jab")
    return texts.select("query_id", F.array(flu.cast("float"), (~flu).cast("float")).alias("embedding"))


def test_vectors_change_the_order_and_names_route(spark, tmp_path, capsys):
    section = lambda text: {"kind": "description", "heading": "Metric", "text": text, "page": 1}
    docs = tmp_path / "docs"
    docs.mkdir()
    names = ["Annual Flu Vaccine", "Eye Exam for Members"]
    measures = [{"measure_id": f"C1{n}", "measure_name": name, "sections": [section(f"{name} of members, part {i}") for i in range(5)]} for n, name in enumerate(names)]
    (docs / "d.json").write_text(json.dumps({"doc_id": "d", "title": "Notes", "publisher": "p", "source_url": "u", "plan_year": 2026, "doc_type": "t", "license_posture": "redistributable", "retrieval_date": "x", "measures": measures, "general_sections": []}))
    path = str(tmp_path / "index")

    def first_line(question, embed):
        assert main(["ask", question, "--index", path], embed) == 0
        return [line for line in capsys.readouterr().out.splitlines() if line.startswith("    ")]

    assert main(["build", "--source", str(docs), "--index", path], by_letter) == 0
    capsys.readouterr()
    assert first_line("a jab", None) == [] and "Flu Vaccine" in first_line("a jab", by_letter)[0]
    routed = first_line("retinal exam of members", by_letter)
    assert len(routed) == 5 and all("Eye Exam" in line for line in routed)
    # With vectors, eval has the dense arm beside, and says whether the gate refuses the traps.
    gold, out = tmp_path / "gold.jsonl", tmp_path / "a.json"
    item = {"item_id": "a", "question": "retinal exam", "category": "scope", "split": "test", "gold": [{"doc_id": "d", "measure_name_contains": "eye", "section": "description"}], "reference_answer": "r"}
    trap = {"item_id": "b", "question": "of members", "category": "refusal_scope", "split": "test", "gold": [], "reference_answer": None}
    gold.write_text(json.dumps(item) + "\n" + json.dumps(trap) + "\n")
    assert main(["eval", "--retrieval", "--dataset", str(gold), "--index", path, "--out", str(out)], by_letter) == 0
    assert "Dense-only" in capsys.readouterr().out
    metrics = json.loads(out.read_text())["metrics"]
    assert metrics["overall"]["recall@5"] == metrics["dense_only_overall"]["recall@5"] == 1.0 and metrics["per_category"]["refusal_scope"]["refused"] == 0.0
    assert main(["build", "--source", str(docs), "--index", path]) == 0
    assert index.vectors(spark, path).count() == 0


def test_prefix_stands_before_questions_once(spark):
    seen = spark.createDataFrame([(1, "x"), (2, Settings().query_prefix + "x")], "query_id int, query string")
    texts = index.embed_questions(seen, lambda t: t.select("query_id", F.array("text").alias("embedding"))).collect()
    assert {r.embedding[0] for r in texts} == {Settings().query_prefix + "x"}


def test_build_ask_eval(spark, tmp_path, capsys):
    section = lambda kind, text: {"kind": kind, "heading": "Metric", "text": text, "page": 1}
    docs = tmp_path / "docs"
    docs.mkdir()
    for year in (2025, 2026):
        measures = [{"measure_id": f"C{n}", "measure_name": name, "sections": [section("description", f"{name} counts {word} members of {year}")]} for n, name, word in ((10, "Eye Exam", "retinal"), (11, "Flu Vaccine", "vaccinated"))]
        (docs / f"d{year}.json").write_text(json.dumps({"doc_id": f"d{year}", "title": f"Notes {year}", "publisher": "p", "source_url": "u", "plan_year": year, "doc_type": "t", "license_posture": "redistributable", "retrieval_date": "x", "measures": measures, "general_sections": [section("general", "Introduction of the notes")]}))
    path = str(tmp_path / "index")
    assert main(["ask", "q", "--index", path]) == 1
    assert main(["build", "--source", str(docs), "--index", path]) == 0
    assert main(["ask", "retinal members in 2025", "--index", path]) == 0
    said = capsys.readouterr().out
    assert "[1] Notes 2025 (2025)" in said and "Notes 2026" not in said
    gold = tmp_path / "gold.jsonl"
    item = {"item_id": "a", "question": "who is vaccinated", "category": "eligibility", "split": "test", "gold": [{"doc_id": "d2026", "measure_name_contains": "flu", "section": "description"}], "reference_answer": "r"}
    gold.write_text(json.dumps(item) + "\n\n" + json.dumps({**item, "item_id": "b", "category": "refusal_scope", "gold": [], "reference_answer": None}) + "\n")
    out = tmp_path / "a.json"
    assert main(["eval", "--dataset", str(gold), "--index", path]) == 2
    assert main(["eval", "--retrieval", "--dataset", str(tmp_path / "none"), "--index", path]) == 1
    assert main(["eval", "--retrieval", "--dataset", str(gold), "--index", path, "--out", str(out)]) == 0
    assert json.loads(out.read_text())["metrics"]["overall"]["mrr"] == 1.0
    base = tmp_path / "base.json"
    base.write_text('{"mrr": 1.0, "recall@8": 1.0}')
    assert main(["eval", "--retrieval", "--dataset", str(gold), "--index", path, "--gate", "--baseline", str(base)]) == 0
    base.write_text('{"mrr": 1.5}')
    assert main(["eval", "--retrieval", "--dataset", str(gold), "--index", path, "--gate", "--baseline", str(base)]) == 1
