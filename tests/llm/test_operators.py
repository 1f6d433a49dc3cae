"""The operators on small tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundsearch.llm import ann, chat, components, decontam, lines, lm, packing, quality, similar, simhash, suffixes, toxicity
from groundsearch.llm.common import crc_mod
from groundsearch.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def real(spark, n=10**9):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where(F.col("doc_id") < n)


ODD = [(901, None), (902, ""), (903, " \n\t "), (904, "one"), (905, "two words"), (906, "x" * 70_000), (907, "Ünïcode " * 3000), (908, "one"), (None, "no id"), (904, "one")]


# 1


def test_lines(spark):
    rows = [(i, "h", f"nav\nbody {i}\n\n foot") for i in range(10)] + [(10, "h", None), (11, None, "nav\nnav"), (12, "g", "nav"), (13, "h", "nav"), (13, "h", "nav")]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("kept", F.lit(1)).withColumn("site", F.lit(2)).withColumn("lines", F.lit(3))
    got = lines.drop_boilerplate(df, max_ratio=0.5, min_pages=3)
    assert got.columns == [*df.columns, "line_stats"]
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[0, "h"].text == "body 0\n" and by[0, "h"].line_stats == (4, 2)
    assert by[10, "h"].text is None and by[11, None].text == "nav\nnav" and by[12, "g"].text == "nav" and by[13, "h"].text == ""
    assert got.count() == len(rows)
    assert lines.drop_boilerplate(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        lines.drop_boilerplate(df, max_ratio=1.5)


def test_lines_white_space_long_texts_and_clashes(spark):
    rows = [(i, "h", "\tnav\r\nbody %d" % i) for i in range(4)] + [(i, "h", f" nav\x0b\n{'long ' * 100_000}{i}") for i in range(4, 8)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("line_stats", F.lit("mine"))
    got = lines.drop_boilerplate(df, max_ratio=0.6)
    assert got.columns == ["doc_id", "source", "text", "line_stats", "_line_stats"]
    assert all(r._line_stats == (2, 1) and "nav" not in r.text for r in got.collect())


def test_small_hosts_lose_what_two_pages_share(spark):
    page = lambda i, host, own: (i, f"http://{host}/x", f"<p>shared of {host}</p><p>{own}</p>")
    df = spark.createDataFrame([page(1, "two", "a"), page(2, "two", "b"), page(3, "one", "c"), page(4, "four", "d"), page(5, "four", "e"), page(6, "four", "f"), page(7, "four", "d")], "page_id int, url string, html string")
    got = {r.page_id: r.text.split() for r in lines.dedup_pages(df).collect()}
    assert got == {1: ["a"], 2: ["b"], 3: ["shared", "of", "one", "c"], 4: [], 5: ["e"], 6: ["f"], 7: []}


def test_html_lines(spark):
    html = "<p>a <b>bold</b> x</p><script>var a='<p>';</script><!-- no --><div>c</div>"
    got = spark.createDataFrame([(html,)], ["h"]).select(F.regexp_replace(lines.html_lines(F.col("h")), "\n+", "|").alias("x")).first().x
    assert got == "|a bold x|c|"


# 2


@pytest.mark.parametrize("rows", [5, 700])
def test_ann(spark, rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(rows, 16)).astype(np.float32)
    base[rows // 2 :: 3] = base[1]  # a hot vector
    data = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    data += [(10_000, None), (10_001, [0.0] * 16), (10_002, [float("nan")] * 16), (10_003, [None] * 16), (None, data[0][1]), data[3], (50_000, [float("inf")] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit(1))
    got = defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    x = base.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, rows, 10):
        near = np.round(x @ x[q], 12)
        near[q] = -9
        want = np.lexsort((np.arange(rows), -near))[: min(5, rows - 1)]
        assert sorted(got[q]) == list(range(1, len(want) + 1))
        hits += len(set(want.tolist()) & {v for v, _ in got[q].values()})
        total += len(want)
        assert all(abs(near[v] - s) < 1e-9 for v, s in got[q].values())
    assert set(got) == set(range(0, rows, 10)) and hits >= 0.9 * total
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def recall(spark, ids, x, **more):
    """Share of the five nearest, by brute force, that the operator finds for ids divisible by 50."""
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5, **more).collect():
        found[r.query_id].add(r.vec_id)
    unit = x.astype(np.float64)  # norms too: in single precision they blur a clump's order
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[at]
        near[at] = -9
        best = np.argpartition(-near, 5)[:5]
        hits, total = hits + len(found[ids[at]] & set(ids[best].tolist())), total + 5
    return hits / total


def test_ann_recall_where_not_all_cells_are_probed(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    assert recall(spark, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)) >= 0.9
    rng = np.random.default_rng(3)
    assert recall(spark, np.arange(10_240), rng.normal(size=(10_240, 64)).astype(np.float32), chunk_rows=1000, query_rows=100) >= 0.9


def test_ann_in_a_dense_clump(spark):
    """Half of the vectors differ by a thousandth, less than codes tell apart: the clump is one cell."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    x[:2500] = x[0] * (1 + 1e-3 * rng.normal(size=(2500, 16)))
    assert recall(spark, np.arange(5000), x) >= 0.9


def test_centres_that_stay_are_apart():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    kept = ann.apart(x, 0.5)
    between = np.sqrt(((kept[:, None] - kept[None]) ** 2).sum(2)) + 9 * np.eye(len(kept))
    assert between.min() >= 0.5 and np.sqrt(((x[:, None] - kept[None]) ** 2).sum(2)).min(1).max() < 0.5
    assert len(ann.apart(np.zeros((5, 2)), 0.1)) == 1 and len(ann.apart(x, 0.0)) == 300


def test_ann_vectors_of_another_length(spark):
    x = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60)] + [(1000, [1.0] * 5), (1050, [])]
    got = ann.search(spark.createDataFrame(x, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and len(got) == 10


# 3


def test_tree_probabilities_sum_to_one():
    keys, _ = lm.windows([b"the cat sat on the mat", b"the dog"], 3)
    strings, counts = lm.counted(lm.ordered(keys, 3))
    tree = lm.Tree.whole(strings, counts, 3)
    for context in (b"the", b"zzz", b" th", b"\xff\xff\xff"):
        c = int.from_bytes(context[::-1], "big") << 8
        p = 2 ** tree.log2(np.array([c | x for x in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1)
    assert 2 ** tree.log2(np.array([int.from_bytes(b" eh"[::1], "big") << 8 | ord("t")], np.uint64))[0] < 1


def test_tree_is_context_tree_weighting():
    """One binary context: the mixture's weights, by the definition."""
    text = b"abababababab"
    keys, _ = lm.windows([text], 1)
    strings, counts = lm.counted(lm.ordered(keys, 1))
    tree = lm.Tree.whole(strings, counts, 1)

    def kt(zeros, ones):
        p, n = 1.0, [0, 0]
        for bit in [0] * zeros + [1] * ones:
            p *= (n[bit] + 0.5) / (sum(n) + 1)
            n[bit] += 1
        return p

    follow = defaultdict(Counter)
    for a, b in zip(b"\xff" + text, text + b"\xff"):
        follow[a][b >> 7] += 1
    own = kt(sum(c[0] for c in follow.values()), sum(c[1] for c in follow.values()))
    children = math.prod(kt(c[0], c[1]) for c in follow.values())
    assert float(tree.weights[0][0][1][0]) == pytest.approx(own / (own + children), rel=1e-5)


def plain_weighting(train, depth):
    """log2 of a text's probability after `train`, by the definition: a dict of counts, and one recursion for the weights."""
    counts = defaultdict(lambda: [0, 0])
    deeper = defaultdict(set)

    def steps(text):
        padded = b"\xff" * depth + text + b"\xff"
        for at in range(depth, len(padded)):
            for bit in range(8):
                past = padded[at - depth : at][::-1]  # newest first
                yield past, format(padded[at], "08b")[:bit], padded[at] >> (7 - bit) & 1

    for text in train:
        for past, bits, bit in steps(text):
            for d in range(depth + 1):
                counts[past[:d], bits][bit] += 1
                if d:
                    deeper[past[: d - 1], bits].add(past[:d])
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    weighted, own_share = {}, {}
    for (context, bits), (z, o) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = kt(z, o)
        if len(context) == depth:
            weighted[context, bits] = own
        else:
            below = sum(weighted[c, bits] for c in deeper[context, bits])
            both = np.logaddexp(own, below)
            own_share[context, bits], weighted[context, bits] = math.exp(own - both), both - math.log(2)

    def probability(past, bits, bit):
        p = None
        for d in range(depth, -1, -1):
            if (past[:d], bits) in counts:
                z, o = counts[past[:d], bits]
                own = ((o if bit else z) + 0.5) / (z + o + 1)
                w = own_share[past[:d], bits] if p is not None else 1
                p = own if p is None else w * own + (1 - w) * p
        return 0.5 if p is None else p

    return lambda text: sum(math.log2(probability(*step)) for step in steps(text))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_are_those_of_plain_context_tree_weighting(spark, depth):
    texts = real(spark).limit(12).select("text").collect()
    rows = [(i, (r.text or "")[:400]) for i, r in enumerate(texts)] + [(20, None), (21, "zz \u00e9\u4e2d unseen"), (22, "  The\tEND "), (23, "")]
    normal = lambda t: b" ".join((t or "").encode().lower().split())
    want = plain_weighting([normal(t) for i, t in rows if i % 3], depth)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slice_rows in (3_000_000, 150):  # several slices, some of one newest byte's contexts
        for r in lm.score(df, held_out=F.col("doc_id") % 3 == 0, depth=depth, slice_rows=slice_rows).collect():
            text = normal(dict(rows)[r.doc_id])
            assert r.score == pytest.approx(want(text) * math.log10(2), rel=1e-6), (r.doc_id, slice_rows)
            assert r.bits_per_byte == pytest.approx(-want(text) / (len(text) + 1), rel=1e-6)


def test_language_model(spark):
    df = real(spark).unionByName(docs(spark, ODD)).withColumn("n", F.lit(1)).withColumn("rare", F.lit(1))
    args = {"held_out": crc_mod("doc_id", 10) == 0}
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    train = Counter()
    for i, words in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update([*words, 0])
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(w) + 1, sum(train[x] > 0 for x in [*w, 0]), round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, 0]), 4)) for i, w in rows)
    for more in ({}, {"hot_words": 10}, {"hot_words": 10, "slice_rows": 3000, "depth": 2}):
        found = lm.score(df, **args, **more).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
        assert all(r.train_tokens == n and r.score < 0 for r in found)
    two = [{(r.doc_id, r.n_tokens): round(r.score, 6) for r in lm.score(df, **args, depth=2, **m).collect()} for m in ({}, {"slice_rows": 2000})]
    assert two[0] == two[1]
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [(r.base_score, r.score) for r in lm.score(more, **args).where("held_out").collect()]
    assert sum(s for _, s in held) > sum(b for b, _ in held)
    assert lm.score(df.where("false"), **args).count() == 0
    assert lm.score(docs(spark, [(None, "a b")]), held_out=F.lit(True)).first().base_score is None


# 4 and 5


def test_quality_and_toxicity(spark):
    all_docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for module, label, mod, out in ((quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)):
        model = module.fit(all_docs, labels, learn_from=crc_mod("doc_id", mod) != out)
        held = labels.where(crc_mod("doc_id", mod) == out).join(all_docs, "doc_id")
        rows = module.scored(held, model, into="p").select("p", label).collect()
        right = sum((r.p >= 0.3) == (r[label] == 1) for r in rows) / len(rows)
        assert right > 0.94 and all(0 <= r.p <= 1 for r in rows)
        odd = docs(spark, ODD).withColumn("row", F.lit("x")).withColumn("score", F.lit("y"))
        got = module.scored(odd, model, into="p")
        assert got.columns == ["doc_id", "text", "row", "score", "p"] and got.count() == len(ODD) and got.where("p is null").count() == 0
        assert module.scored(odd.where("false"), model).count() == 0
        bare = module.fit(all_docs.limit(20), labels.where("false"), learn_from=F.lit(True))
        assert module.scored(odd, bare).count() == len(ODD)


def test_label_model_sums_by_definition(spark):
    """Rounds over the written patterns against plain loops over single documents, and what they learn."""
    rng = np.random.default_rng(2)
    n, hidden = 6, rng.random(800) < 0.3
    rates = np.array([[0.02, 0.05, 0.01, 0.03, 0.02, 0.9], [0.6, 0.5, 0.4, 0.0, 0.3, 0.05]])
    votes = (rng.random((800, n)) < rates[hidden.astype(int)]).astype(float)
    votes[:, 3] = votes[:, 0] * (rng.random(800) < 0.95)  # repeats voter 0
    lists = [[int(j) for j in np.flatnonzero(v)] for v in votes]
    table = spark.createDataFrame([(v,) for v in lists], "votes array<int>").groupBy("votes").count()
    model = toxicity.LabelModel(n, 0.2)
    for turn in range(6):
        got = toxicity.total(table, n, lambda v, c: model.sums(v, c).ravel()).reshape(2, n + 1, n + 1)
        want = np.zeros((2, n + 1, n + 1))
        for v in lists:
            z = math.log(model.prior / (1 - model.prior))
            for j in v:
                z += model.alone[j] + (model.more[j] if model.parent[j] in v else 0)
            p = 1 / (1 + math.exp(-z))
            for c, share in enumerate((1 - p, p)):
                for i in [*v, n]:
                    for j in [*v, n]:
                        want[c, i, j] += share
        assert np.allclose(got, want)
        model.update(got, tree=turn >= 2)
    assert model.parent[3] == 0 or model.parent[0] == 3  # the correlation is found
    assert model.alone[1] > 1 and ((model.posterior(votes) > 0.5) == hidden).mean() > 0.85
    gain = np.array([[0, 5, 1, 9], [5, 0, 4, 9], [1, 4, 0, 9], [9, 9, 9, 0]], float)
    assert toxicity.spanning_tree(gain).tolist() == [-1, 0, 1, -1]


def test_quality_features_by_definition():
    import zstandard

    dictionaries = [b"good words about bridges and rivers " * 30, b"BUY NOW click here free!!! " * 30]
    text = "good words about rivers " * 90 + "é"
    data = text.encode()
    plain = [[len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(data[i : i + 1024])) for i in range(0, len(data), 1024)] for d in dictionaries]
    g, b = map(sum, plain)
    assert quality.features(dictionaries)(text) == ((b - g) / max(g, b), g / len(data), b / len(data)) and g < b
    assert quality.features(dictionaries)("") == (0, 0, 0)
    assert b"".join(quality.blocks_of(text)) == data and quality.blocks_of("") == []


def test_every_beginning_that_passes_is_a_voter(spark):
    """Three hundred rare insults, each in ten toxic rows of 3,000: none is cut off."""
    bad = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in "npqrst"]
    rows = [(0, 1, f"{w} x{i}") for w in bad for i in range(10)] + [(0, 0, f"calm y{i}") for i in range(9000)]
    found = toxicity.find_beginnings(spark.createDataFrame(rows, "part int, label int, text string"))
    assert set(found) == set(bad) and len(bad) == 300
    assert toxicity.find_beginnings(spark.createDataFrame(rows[:5], "part int, label int, text string")) == []


def test_tail():
    assert toxicity.tail(2, 2, 0.5) == pytest.approx(0.25) and toxicity.tail(0, 3, 0.2) == pytest.approx(1)


# 6


def plain_tiles(doc, item, n):
    """Greedy string tiling by its definition: all pairs of places, again and again."""
    marked_doc, marked_item, tiles = set(), set(), []
    while True:
        runs = {}
        for t in range(len(doc)):
            for p in range(len(item)):
                k = 0
                while t + k < len(doc) and p + k < len(item) and doc[t + k] == item[p + k] != 0 and t + k not in marked_doc and p + k not in marked_item:
                    k += 1
                if k >= n:
                    runs[t, p] = k
        if not runs:
            return sorted(tiles, key=lambda x: x[1])
        most = max(runs.values())
        for t, p in sorted(x for x, k in runs.items() if k == most):
            here = {*range(t, t + most)}, {*range(p, p + most)}
            if not here[0] & marked_doc and not here[1] & marked_item:
                marked_doc |= here[0]
                marked_item |= here[1]
                tiles.append((t, p, most))


def test_tiling_takes_the_longest_first():
    rng = np.random.default_rng(4)
    assert decontam.tile(np.array([1, 2, 3, 9, 1, 2, 3, 4, 5, 6]), np.array([1, 2, 3, 4, 5, 6]), 3) == [(4, 0, 6)]
    for _ in range(150):
        doc, item = rng.integers(0, 4, rng.integers(0, 40)), rng.integers(1, 4, rng.integers(1, 15))
        assert decontam.tile(doc, item, 3) == plain_tiles(doc.tolist(), item.tolist(), 3)


def test_tiling_of_a_passage_repeated_in_a_long_text():
    item = np.arange(1, 101)
    assert decontam.tile(np.tile(np.r_[item, 0], 2000), item, 4) == [(0, 0, 100)]


def test_decontamination_query_ties(spark, tmp_path):
    from groundsearch.llm import queries

    half = "one two three four five six seven eight"
    docs(spark, [(1, half), (2, "nothing here"), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(9, half), (4, half), (5, half + " nine ten")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in queries.op6_decontamination(spark, str(tmp_path)).collect()]
    assert got == [(1, True, 4, 1.0, [4, 5, 9])]


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "x theta iota kappa zz Eta, ALPHA beta-gamma delta epsilon zeta eta"
    rows = [(1, f"lead {item} tail"), (2, moved), (3, "alpha beta gamma delta only"), (4, None), (5, ""), (6, f"{item} " * 500), (6, f"{item} " * 500), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item), (7, item), (10, item)], "item_id bigint, text string")
    df = docs(spark, rows).withColumn("overlaps", F.lit("mine")).withColumn("row", F.lit(0))
    for size in (10**6, 40):
        got = [(r.doc_id, [o.item_id for o in r.found], [round(o.coverage, 2) for o in r.found]) for r in decontam.with_overlaps(df, bench, into="found", block_bytes=size).collect()]
        assert sorted(got, key=str) == sorted([(1, [7, 10], [1, 1]), (2, [7, 10], [0.7, 0.7]), (3, [], []), (4, [], []), (5, [], []), (6, [7, 10], [1, 1]), (6, [7, 10], [1, 1]), (None, [7, 10], [1, 1])], key=str)
    assert decontam.with_overlaps(df, bench.where("false"), into="found").where("size(found) > 0").count() == 0
    assert decontam.with_overlaps(df.where("false"), bench, into="found").count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    """Items of fewer tokens than a seed match whole; characters are tokens where words aren't spaced."""
    bench = spark.createDataFrame([(1, "Quick fox"), (2, "zebra"), (3, "今日は良い天気ですね"), (4, "..."), (5, "กินข้าว")], "item_id bigint, text string")
    rows = [(1, "a quick, FOX ran"), (2, "fox quick"), (3, "Zebra!"), (4, "zebras"), (5, "昨日と違い今日は良い天気ですねと言った"), (6, "今日は雨"), (7, "ฉันกินข้าวแล้ว"), (8, "quick brown fox ... zeb ra"), (9, None), (10, "fox")]
    for size in (10**6, 8):
        got = {r.doc_id: [(o.item_id, o.coverage) for o in r.found] for r in decontam.with_overlaps(docs(spark, rows), bench, into="found", block_bytes=size).collect()}
        assert {d: f for d, f in got.items() if f} == {1: [(1, 1.0)], 3: [(2, 1.0)], 5: [(3, 1.0)], 7: [(5, 1.0)]} and len(got) == 10


def test_overlaps_are_plain_tilings_of_every_item():
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5, n))
    items = [(i, word(rng.integers(0, 9))) for i in range(40)]
    known = decontam.Items(items, 3)
    for _ in range(40):
        text = word(rng.integers(0, 30))
        want = []
        for i, item in items:
            d, b = decontam.tokens(text), decontam.tokens(item)
            ids = {w: n for n, w in enumerate(dict.fromkeys(b), 1)}
            tiles = plain_tiles([ids.get(w, 0) for w in d], [ids[w] for w in b], min(3, len(b))) if b else []
            if b and sum(t[2] for t in tiles) / len(b) >= 0.5:
                want.append((i, sum(t[2] for t in tiles) / len(b)))
        assert [(o["item_id"], o["coverage"]) for o in known.overlaps(text, 0.5)] == want


# 7


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for lengths in ([64], [1] * 5, [60, 40, 30, 30, 30, 4, 4], rng.integers(1, 65, 500).tolist()):
        assigned, sequences = packing.plan(dict(Counter(lengths)), 64)
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):  # plain best fit decreasing
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(64 - n)
        used = defaultdict(list)
        for length, rank, n, first, per, offset in assigned:
            for i in range(n):
                used[first + i // per].append((offset + i % per * length, length))
        assert sequences == len(rooms) == len(used)
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64
        assert sorted(64 - sum(n for _, n in p) for p in used.values()) == sorted(rooms)


def test_packing(spark):
    from tokenizers import Tokenizer

    df = real(spark).unionByName(docs(spark, ODD)).withColumn("length", F.lit("x"))
    tokenizer = Tokenizer.from_file(tokenizer_file())
    got = packing.pack(df, tokenizer=tokenizer_file(), window=256).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [p for p in pieces[r.doc_id] if p.doc_tokens == len(ids)]
        copies = sum(p.start == 0 for p in mine)
        assert sum(p.length for p in mine) == copies * len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == np.cumsum([0, *[n for _, n in sorted(w)]])[:-1].tolist() and sum(n for _, n in w) <= 256
    assert packing.pack(df.where("false"), tokenizer=tokenizer_file()).count() == 0


def test_word_tokenizer_agrees_on_odd_characters():
    import random

    tokenizer = packing.WordTokenizer(tokenizer_file())
    random.seed(3)
    parts = [*"abcXYZéÉßÄñ'’sStTrRdDmM .,!?_-|0129²½ªº\t\n\r\x0b\x0c\x1c\x85\xa0İǅȺΣσς中文<|>&$́​", "<|endoftext|>", "don't", "'S", "I'LL", " _a_ "]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        want = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokenizer.encode([text])[0], "<u4").tolist() == want, repr(text)


# 8


def brute_repeats(rows, length):
    owners, out = defaultdict(lambda: math.inf), Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for at in range(len(b) - length + 1):
            if i is not None:
                owners[b[at : at + length]] = min(owners[b[at : at + length]], i)
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            if i is not None and owners[b[at : at + length]] < i:
                gone[at : at + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_order():
    rng = np.random.default_rng(1)
    for length in (16, 50, 70):
        data = rng.integers(0, 2, 900).astype(np.uint8)
        data[300:600] = data[:300]
        at = np.flatnonzero(data[: 900 - length] == 1)
        got = suffixes.sorted_bucket(suffixes.Sampled(data, length), at)
        strings = [data[i : i + length].tobytes() for i in got]
        assert strings == sorted(strings) and sorted(got) == at.tolist()
    assert all((r + suffixes.to_cover(r, s)) % 8 in suffixes.COVER for r in range(8) for s in range(8))


@pytest.mark.parametrize("hot", [48, 2])
def test_suffixes(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "OFTEN", 20 * hot)
    passage = "A passage of words that many texts share, and that is longer than fifty bytes. "
    odd = [(i, t) for i, t in ODD if t is None or i != 906] + [(906, "x" * 70_000), (910, "x" * 3000)]
    rows = [tuple(r) for r in real(spark, 80).collect()] + odd + [(1000 + i, f"{i} before {passage * (1 + i % 3)} after {i}") for i in range(60)]
    rows += [(2000, "ab" * 100), (2001, "ba" * 100), (2002, passage[:50]), (2003, passage[:49]), (2003, passage[:49])]
    df = docs(spark, rows).withColumn("key", F.lit(1)).withColumn("size", F.lit(1))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, length=50).collect())
    assert got == brute_repeats(rows, 50)
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_suffixes_repeat_in_a_slices_first_document(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    passage = "A passage of words that many texts share, and that is longer than fifty bytes. "
    rows = [(i, f"{i} {passage}{i} between {passage * 2}{i} {'-' * 120} {i} {'=' * 70}{i}{'-' * 60}") for i in range(40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several slices
    try:
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, rows), length=50).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute_repeats(rows, 50)


# 9


def test_chats(spark):
    rows = [(1, 0, "user", "a<|end|>\\l [INST]"), (1, 1, "user", None), (1, 2, "assistant", "</s>\\b\n"), (1, 3, "assistant", "x"), (1, 2, "assistant", "</s>\\b\n"), (2, None, None, "n"), (None, 0, "assistant", ""), (3, 1, "b", "2"), (3, 0, "us\ner", "1")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("blocks", F.lit(1)).withColumn("t", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t if t is not None else -1, r or "unknown", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_chats(df.where("false")).count() == 0


def test_chats_of_many_turns_and_long_texts(spark):
    turns = [(1, n, ("user", "assistant", "assistant")[n % 3], f"turn {n} é<|and|>") for n in range(20_000)] + [(2, 0, "assistant", "𝄞x" * 300_000)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for r in chat.digests(chat.format_chats(rows)).collect():
        mine = [t for t in turns if t[0] == r.conv_id]
        said = "".join(t[3] for t in mine if t[2] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(mine), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in mine).encode()).hexdigest()


# 10


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_print(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    df = real(spark).unionByName(docs(spark, ODD)).withColumn("fingerprint", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = {i: plain_print(t, 3) for i, t in rows if i is not None}
    ids = sorted(prints)
    want = brute_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.near_duplicates(df).select("*", simhash.hexadecimal().alias("hex")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.hex, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    kept = simhash.one_of_each(df, simhash.near_duplicates(df)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in kept) == 1
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_dense_anchors():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)], np.uint64)
    fps = np.unique(np.concatenate([centre ^ flips, rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    for t in (1, 2, 3):
        a, b = simhash._links_of_many(fps, t)
        near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= t]
        assert brute_components(range(len(fps)), near) == brute_components(range(len(fps)), zip(a.tolist(), b.tolist()))
        row, anchor = simhash.anchors(fps, t, simhash.code(simhash.RADIUS + t))
        held = defaultdict(set)
        for r, x in zip(row.tolist(), anchor.tolist()):
            held[r].add(x)
        assert all(held[i] & held[j] for i, j in near)


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar(spark):
    import random

    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    rows = []
    for group in range(12):
        base = [word() for _ in range(random.randint(60, 400))]
        for n in range(5):
            copy = list(base)
            for _ in range(n):
                copy[random.randrange(len(copy))] = word()
            rows.append((10 * group + n, " ".join(copy)))
    rows += ODD
    df = docs(spark, rows).withColumn("content", F.lit(1))
    sets = {i: plain_shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    want = brute_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in similar.similar_documents(df).collect()}
    assert got.pop(None) is None and got == want
    assert similar.similar_documents(df.where("false")).count() == 0


def linked_alike(spark, rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    return got, brute_components(sorted(sets), alike)


def test_similar_in_dense_groups(spark):
    import random

    random.seed(3)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(200)], []
    for n in range(15):  # the same words in other orders: no bit apart, but only their own edited copies are similar
        random.shuffle(base)
        copy = list(base)
        copy[random.randrange(200)] = word()
        rows += [(n, " ".join(base)), (100 + n, " ".join(copy))]
    got, want = linked_alike(spark, rows)
    assert len(set(want.values())) == 15 and got == want


def test_similar_with_a_block_added_or_replaced(spark):
    import random

    random.seed(5)
    words = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    text = lambda n: random.choices(words, k=n)
    rows = []
    for group in range(60):
        n = random.randint(60, 400)
        base = text(n)
        rows += [(3 * group, " ".join(base)), (3 * group + 1, " ".join(base + text(n * 22 // 100))), (3 * group + 2, " ".join(text(n // 10) + base[n // 10 :]))]
    got, want = linked_alike(spark, rows)
    assert len(set(want.values())) <= 60 and got == want


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (5, 5), (300, 100)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
