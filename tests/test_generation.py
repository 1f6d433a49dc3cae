"""The generate seam: which questions reach the model, how often, and what is shown of its replies."""

import json

import pytest
from pyspark.sql import functions as F

from groundsearch.__main__ import main
from groundsearch.operators.answering import REFUSAL, Messages, answers

#: first reply, reply after a correction, chunks, similarity, kind, times asked
CASES = {
    "good": ("Women are eligible [1]. Exclusions apply [2].", None, 2, 0.9, "answered", 1),
    "unknown mark": ("Made up [9].", "Grounded [1].", 2, 0.9, "answered", 2),
    "no mark": ("No citations.", "Now cited [1].", 1, None, "answered", 2),
    "wrong twice": ("Wrong [9].", "Still wrong [9].", 2, 0.9, "refused_citation_invalid", 2),
    "refusal": (REFUSAL, None, 1, 0.9, "refused_by_model", 1),
    "refusal at last": ("Wrong [0].", f"Sorry. {REFUSAL}", 1, 0.9, "refused_by_model", 2),
    "low": ("never asked", None, 1, 0.05, "refused_low_confidence", 0),
    "nothing found": ("never asked", None, 0, None, "refused_low_confidence", 0),
    "no count": ("never asked", None, None, 0.9, "refused_low_confidence", 0),
    "silent": (None, None, 2, 0.9, "refused_citation_invalid", 2),
    "silent first": (None, "Late [2].", 2, 0.9, "answered", 2),
}


def asked(spark):
    rows = [(k, f"question {k}", f"context {k}", n, s) for k, (_, _, n, s, _, _) in CASES.items()]
    return spark.createDataFrame(rows, "query_id string, question string, context string, chunks int, similarity double")


@pytest.fixture
def scripted(spark, tmp_path):
    """A model that notes on disk what it was asked, so that a second computation would show."""
    replies = {k: v[:2] for k, v in CASES.items()}
    log = tmp_path / "calls"
    log.mkdir()

    def generate(rows):
        kind = rows.schema["query_id"].dataType.simpleString()

        def run(frames):
            import uuid

            import pandas as pd

            for f in frames:
                for r in f.itertuples():
                    (log / uuid.uuid4().hex).write_text(json.dumps([r.query_id, r.question, r.context, None if pd.isna(r.correction) else r.correction]))
                out = pd.DataFrame({"query_id": f.query_id, "reply": [replies[q][0 if pd.isna(c) else 1] for q, c in zip(f.query_id, f.correction, strict=True)]})
                yield out[out.reply.notna()]

        return rows.mapInPandas(run, f"query_id {kind}, reply string")

    return generate, lambda: [json.loads(f.read_text()) for f in log.iterdir()]


def test_outcomes_and_calls(spark, scripted):
    generate, calls = scripted
    got = answers(asked(spark), generate)
    for _ in range(2):  # however often the result is read
        rows = {r.query_id: r for r in got.collect()}
        assert {k: r.kind for k, r in rows.items()} == {k: v[4] for k, v in CASES.items()}
    made = calls()
    assert {k: sum(c[0] == k for c in made) for k in CASES} == {k: v[5] for k, v in CASES.items()}
    assert all(c[1:3] == [f"question {c[0]}", f"context {c[0]}"] for c in made)
    hints = {c[0]: c[3] for c in made if c[3]}
    assert set(hints) == {k for k, v in CASES.items() if v[5] == 2}
    assert "[9]" in hints["unknown mark"] and "no citation markers" in hints["no mark"] and "[1] to [2]" in hints["wrong twice"]
    assert rows["good"].text == f"{CASES['good'][0]}\n\n{Messages().disclaimer}" and rows["unknown mark"].reply == "Grounded [1]."
    assert rows["wrong twice"].reply is None and "[9]" not in rows["wrong twice"].text and rows["refusal at last"].text.startswith(REFUSAL)
    assert all(r.text.endswith(Messages().disclaimer) for r in rows.values())


def test_without_a_model(spark):
    got = {r.query_id: (r.kind, r.reply) for r in answers(asked(spark)).collect()}
    assert got == {k: ("refused_low_confidence" if v[4] == "refused_low_confidence" else "retrieval_only", None) for k, v in CASES.items()}


def test_no_question(spark, scripted):
    assert answers(asked(spark).where("false"), scripted[0]).count() == 0 and scripted[1]() == []


def test_ask_shows_the_cited_passages(spark, tmp_path, capsys):
    docs, path = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    section = lambda text: {"kind": "general", "heading": "H", "text": text, "page": 1}
    (docs / "d.json").write_text(json.dumps({"doc_id": "d", "title": "Notes", "publisher": "p", "source_url": "u", "plan_year": 2026, "doc_type": "t", "license_posture": "redistributable", "retrieval_date": "x", "measures": [], "general_sections": [section(t) for t in ("flu shot one", "flu shot two", "eye exam", "blood pressure", "statin use", "fall risk", "care plan")]}))
    assert main(["build", "--source", str(docs), "--index", path]) == 0
    capsys.readouterr()
    replies = lambda text: lambda rows: rows.select("query_id", F.when(F.contains("context", F.lit("[2] ")), text).alias("reply"))
    assert main(["ask", "flu shot", "--index", path], generate=replies("Second, then first [2][1].")) == 0
    said = capsys.readouterr().out
    assert said.startswith("Second, then first") and [line[:3] for line in said.splitlines() if line.startswith("[")] == ["[2]", "[1]"]
    assert main(["ask", "flu shot", "--index", path], generate=replies("Bad [7].")) == 0
    said = capsys.readouterr().out
    assert "[7]" not in said and Messages().citation_invalid in said
    assert main(["ask", "flu shot", "--index", path, "--retrieval-only"], generate=replies("never")) == 0
    assert Messages().retrieval_only in capsys.readouterr().out
    assert main(["ask", "unheard", "--index", path], generate=replies("never")) == 0
    assert REFUSAL in capsys.readouterr().out
