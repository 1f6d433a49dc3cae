"""JSON lines by file and line number: blocks of a file, duplicates, and lines set aside."""

import json

import pytest

from groundsearch.operators import evaluation
from groundsearch.sources import corpus


@pytest.fixture(params=[None, "200b"])
def blocks(spark, request):
    """Whole files, and files read in blocks of a few lines."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    if request.param:
        spark.conf.set(keys[0], request.param)
        spark.conf.set(keys[1], "1b")
    yield request.param
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_line_numbers(spark, tmp_path, blocks):
    texts = {"a.jsonl": ["x" * (i % 37) for i in range(300)], "b.jsonl": ["", "one", "", "", "two"], "c.jsonl": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    df = corpus.numbered_lines(spark, str(tmp_path))
    assert (df.rdd.getNumPartitions() if not blocks else spark.read.text(str(tmp_path)).rdd.getNumPartitions()) >= (10 if blocks else 1)
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in df.collect())
    assert got == [(name, i + 1, x) for name, lines in sorted(texts.items()) for i, x in enumerate(lines)]


def test_the_last_duplicate_wins_by_file_and_line(spark, tmp_path, blocks):
    for n in (2, 1):
        (tmp_path / f"part{n}.jsonl").write_text("".join(json.dumps({"chunk_id": f"c{i % 7}", "text": f"file {n} line {i + 1}", "page": i}) + "\n" for i in range(60)))
    got = {r.chunk_id: (r.text, r.page) for r in corpus.read_chunk_lines(spark, str(tmp_path)).collect()}
    assert got == {f"c{i % 7}": (f"file 2 line {i + 1}", i) for i in range(53, 60)}


BAD = ['{"chunk_id": "secret", ', '["secret"]', '"secret"', '{"text": "secret"}', '{"chunk_id": "c", "page": "secret"}', "secret", '{"chunk_id": null, "text": "secret"}']


def test_corrupt_lines_are_named_without_their_content(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    for n, bad in enumerate(BAD):
        path.write_text('{"chunk_id": "a", "text": "fine"}\n\n' + bad + "\n")
        with pytest.raises(corpus.CorpusError, match="c.jsonl line 3") as e:
            corpus.read_chunk_lines(spark, str(path))
        assert "secret" not in str(e.value), n


def test_corrupt_lines_are_set_aside(spark, tmp_path):
    path, aside = tmp_path / "c.jsonl", str(tmp_path / "aside")
    path.write_text("".join(f"{x}\n" for x in ['{"chunk_id": "a", "text": "fine"}', *BAD, "", '{"chunk_id": "b"}']))
    assert sorted((r.chunk_id, r.text) for r in corpus.read_chunk_lines(spark, str(path), quarantine=aside).collect()) == [("a", "fine"), ("b", None)]
    bad = spark.read.parquet(aside).orderBy("line").collect()
    assert [(r.line, r.reason) for r in bad] == [(i + 2, "no chunk_id" if i in (3, 6) else "not readable") for i in range(len(BAD))]
    assert all("secret" not in str(r) for r in bad)


def test_gold_and_empty_files(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text("\n\n")
    assert corpus.load_gold(spark, str(path)).count() == 0
    path.write_text('{"item_id": "a", "question": "q", "gold": [{"doc_id": "d", "section": "s"}], "extra": 1}\n\n{"question": "q"}\n{"item_id": "b", "gold": {}}\n')
    with pytest.raises(corpus.CorpusError, match="line 3: no item_id; gold.jsonl line 4: not readable"):
        corpus.load_gold(spark, str(path))


def test_the_last_artifact_by_name(tmp_path):
    with pytest.raises(evaluation.DatasetError):
        evaluation.latest_artifact(tmp_path)
    for name in ("2026-02.json", "2026-01.json"):
        (tmp_path / name).write_text("{}")
    assert evaluation.latest_artifact(tmp_path).name == "2026-02.json"
