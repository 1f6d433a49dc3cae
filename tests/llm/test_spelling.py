"""Spelling variants against brute force, and the cases that its docstring names."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from groundsearch.llm import spelling
from groundsearch.llm.queries import OP11_SQL, op11_spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one insertion, deletion or replacement makes b of a, tried one by one."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected(counts, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    found, form = defaultdict(set), {}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            found[w] |= {v for v in by_length[size] if near(w, v)}
        best = min(found[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(found[w]), words.get(form.get(w))))
    return out


def test_brute_force_on_real_texts(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", r.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    assert {tuple(r) for r in op11_spelling(spark, SF).collect()} == expected(counts)


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = op11_spelling(spark, SF)
    order = ", ".join(df.columns)
    assert {tuple(r) for r in df.collect()} == set(con.sql(OP11_SQL).select(order).fetchall())


def made(spark, counts, extra=()):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())] + list(extra)
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("whole", [64, 7, 1])
def test_repeated_letters_long_words_and_chains(spark, monkeypatch, whole):
    """Words of every length go by digests too, if WHOLE says so; the results are the same."""
    monkeypatch.setattr(spelling, "WHOLE", whole)
    long = "lorem" * 40
    counts = {
        "aaaaaaa": 5, "aaaaaa": 30, "aaaaab": 6, "aabaaa": 7, "abcdef": 700, "abcdeg": 100, "abcdehg": 12, "abcdeh": 12, "bacdef": 5, "fabcde": 9, "abcde\u00e9": 5, "\u00e0bcdef": 5, "abcdefabcdef": 5, "abcdefabcdeg": 5,
        long: 50, long[:77] + long[78:]: 5, long[:100] + "x" + long[101:]: 6, "z" + long: 7, long + "zz": 5, "q" * 64: 5, "q" * 65: 40, "q" * 63 + "p": 5, "solitary": 5, "rarely": 4, "short": 9,
    }
    got = spelling.variants(made(spark, counts), damage=None)
    assert {tuple(r) for r in got.collect()} == expected(counts)
    assert got.where("word = 'abcdehg'").first().root == "abcdef"  # by way of abcdeg


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n1234"), (4, "Straße " * 5), (None, "Naïveté " * 5), (5, "\u00c0LPHAX " * 5), (5, "\u00c0LPHAX " * 5), (6, "x" * 30_000 + (" " + "x" * 30_000) * 4), (7, "o'clocks " * 3), (8, "\U0001f600clocks" * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    got = {r.word: r for r in spelling.variants(df, damage=None).collect()}
    assert {w[:9]: r.n for w, r in got.items()} == {"straße": 5, "naïveté": 5, "\u00c0lphax": 10, "xxxxxxxxx": 5, "clocks": 5}
    assert all(r.root == w and r.form is None and r.form_n is None and r.n_near == 0 for w, r in got.items())
    assert spelling.variants(df.where("false")).count() == 0
    # a lost letter: the same run of one document is the same word each time, and a null id hashes as the empty string
    word = "naïveté"
    h = zlib.crc32(f":{word}".encode())
    hit = spelling.vocabulary(df.where("doc_id is null"), damage=h).first().word
    assert hit == word[: h % 7] + word[h % 7 + 1 :] and spelling.vocabulary(df.where("doc_id is null"), damage=h + 1).first().word == word


def test_ties_go_to_the_smaller_word(spark):
    got = {r.word: r.form for r in spelling.variants(made(spark, {"centre": 5, "center": 40, "centru": 40, "\u00e9entre": 40}), damage=None).collect()}
    assert got["centre"] == "centru" and got["center"] is None
    got = {r.word: r.form for r in spelling.variants(made(spark, {"abcdef": 5, "abcdeg": 25, "\u00e9bcdef": 25, "zbcdef": 24}), damage=None).collect()}
    assert got["abcdef"] == "abcdeg"
