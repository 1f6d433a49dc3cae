"""Queries over the driver's tables: documents stand for chunks, benchmark items for questions, embeddings for vectors.

A document's section, plan year and measure are made from its id, language and source; the vector of a question or
a document is the one whose vec_id is its id. `oracle.SQL` holds the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import answering, asof, assembly, bm25, chunking, dense, evaluation, fusion, parsing, routing
from ..schemas import SECTION_KINDS
from ..sources import corpus
from . import index, retrieval

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings()
BASELINE = {"recall@8": 0.05, "mrr": 0.9, "hit@1": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _big(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the oracle has them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their vectors."""
    d = table(spark, sf_dir, "documents")
    section = F.element_at(F.array(*map(F.lit, SECTION_KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select("doc_id", "text", "lang", "source", section.alias("section"), (2025 + F.col("doc_id") % 3).cast("int").alias("plan_year"), F.concat_ws("-", "lang", "source").alias("measure_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    i = F.col("item_id")
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (i % 4 + 1).cast("int"))
    b = b.select(i.alias("query_id"), F.col("text").alias("query"), (2025 + i % 3).cast("int").alias("plan_year"), F.concat(lang, F.lit("-src"), (i % 20).cast("string")).alias("measure_id"))
    return b.join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def rounded(df: DataFrame) -> DataFrame:
    """Six digits; ten first, so that sums of another order fall on the same side of a half."""
    return _big(df.select(*[F.round(F.round(c, 10), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def tokenize_stats(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return _big(texts(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct")))


def bm25_df_idf(spark, sf_dir):
    return rounded(bm25.lexicon(texts(spark, sf_dir)).terms)


def bm25_topk(spark, sf_dir):
    found = bm25.top_k(texts(spark, sf_dir), questions(spark, sf_dir).select("query_id", "query"), SETTINGS.final_k)
    return rounded(found.select("query_id", "doc_id", "rank", "score"))


def bm25_topk_filtered(spark, sf_dir):
    c = chunks(spark, sf_dir)
    keep = c.where("lang = 'en' and plan_year = 2026").select("doc_id")
    return rounded(bm25.top_k(c.select("doc_id", "text"), questions(spark, sf_dir).select("query_id", "query"), SETTINGS.final_k, keep=keep).select("query_id", "doc_id", "rank", "score"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def dense_topk(spark, sf_dir):
    return rounded(dense.top_k(_vectors(spark, sf_dir), questions(spark, sf_dir).where("embedding is not null"), SETTINGS.final_k))


def dense_topk_filtered(spark, sf_dir):
    q = questions(spark, sf_dir).where("embedding is not null").withColumn("label", F.col("query_id") % 10)
    return rounded(dense.top_k(_vectors(spark, sf_dir), q, SETTINGS.final_k, groups="label"))


def best_similarity_gate(spark, sf_dir):
    return rounded(retrieval.best_similarity(chunks(spark, sf_dir), questions(spark, sf_dir), floor=0.97))


def rrf_fuse(spark, sf_dir):
    d, b = retrieval.legs(chunks(spark, sf_dir), questions(spark, sf_dir), SETTINGS, texts=passages(spark, sf_dir))
    return rounded(fusion.fuse(d, b, SETTINGS.rrf_k))


def hybrid_topk(spark, sf_dir):
    p = passages(spark, sf_dir)
    found = retrieval.retrieve(chunks(spark, sf_dir), questions(spark, sf_dir), SETTINGS, year="plan_year", texts=p)
    return rounded(retrieval.hydrate(found, p, "section", "source").select("query_id", "doc_id", "rank", "score", "dense_rank", "bm25_rank", "section", "source"))


def _fallback(spark, sf_dir, lexical):
    found = retrieval.retrieve(chunks(spark, sf_dir), questions(spark, sf_dir), SETTINGS, measure="measure_id", year="plan_year", lexical=lexical, texts=passages(spark, sf_dir))
    return rounded(found.select("query_id", "doc_id", "rank", "score", "used_fallback"))


def hybrid_fallback(spark, sf_dir):
    return _fallback(spark, sf_dir, True)


def dense_only_arm(spark, sf_dir):
    return _fallback(spark, sf_dir, False)


def routed_topk(spark, sf_dir):
    """Questions filter by a list of measures, or none, and by a year, or none; no embedding for some."""
    q, i = questions(spark, sf_dir), F.col("query_id")
    other = F.concat(F.lit("en-src"), (i % 7).cast("string"))
    measures = F.when(i % 3 == 0, F.array("measure_id", other)).when(i % 3 == 1, F.array("measure_id"))
    q = q.select("query_id", "query", F.when(i % 4 > 0, F.col("plan_year")).alias("plan_year"), measures.alias("measure_id"), F.when(i % 5 > 0, F.col("embedding")).alias("embedding"))
    found = retrieval.retrieve(chunks(spark, sf_dir), q, SETTINGS, measure="measure_id", year="plan_year", texts=passages(spark, sf_dir))
    return rounded(found.select("query_id", "doc_id", "rank", "score", "used_fallback"))


def default_year(spark, sf_dir):
    return _big(routing.default_year(chunks(spark, sf_dir)))


MENTIONS = (" in 2026", " in 2025 and 2027", " what changed in 2026", " before 2019", " compared with the previous year", "")


def year_inference(spark, sf_dir):
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    said = F.concat("query", F.element_at(F.array(*map(F.lit, MENTIONS)), (F.col("query_id") % 6 + 1).cast("int")))
    known = c.agg(F.sort_array(F.collect_set("plan_year")).alias("years")).crossJoin(routing.default_year(c))
    asked = q.select("query_id", said.alias("query")).crossJoin(F.broadcast(known))  # one row
    return _big(asked.select("query_id", routing.inferred_year(F.col("query"), F.col("years"), F.col("default_year")).alias("plan_year")))


def _measured(spark, sf_dir):
    """Documents as chunks of measures: names from fixed parts and the source, ids and years from the document's id; every ninth has no measure."""
    i = F.col("doc_id")
    parts = F.array(*[F.lit(name.title()) for name in routing.ALIASES])
    name = F.concat_ws(" of ", F.element_at(parts, (i % len(routing.ALIASES) + 1).cast("int")), "source")
    measure = F.concat(F.when(i % 2 == 0, "C").otherwise("D"), (10 + i * 7 % 83).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (2025 + i % 3).cast("int").alias("plan_year"))
    return d.select("plan_year", F.when(i % 9 > 0, measure).alias("measure_id"), name.alias("measure_name"))


def alias_table(spark, sf_dir):
    made = routing.alias_table(routing.entries(_measured(spark, sf_dir)))
    return _big(made.select("alias", "plan_year", F.array_join("measure_ids", ",").alias("measure_ids")))


def measure_index(spark, sf_dir):
    return routing.measure_index(_measured(spark, sf_dir)).select("measure_name", F.array_join("measure_ids", ",").alias("measure_ids"))


def augmented_query(spark, sf_dir):
    """Two of the names are chosen for each question, and a third that no chunk has."""
    q, i = questions(spark, sf_dir).select("query_id", "query"), F.col("query_id")
    parts = F.array(*[F.lit(name.title()) for name in routing.ALIASES])
    name = lambda n: F.concat(F.element_at(parts, (n % len(routing.ALIASES) + 1).cast("int")), F.lit(" of src"), (n % 20).cast("string"))
    chosen = q.where(i % 4 > 0).select("query_id", F.explode(F.array(name(i), name(i + 23), F.lit("nothing"))).alias("measure_name"))
    return routing.augmented(q, chosen, routing.measure_index(_measured(spark, sf_dir)))


WORDS = (" statin", " the fall risk", " c14 and D21", " protocol", " HbA1c", " breast cancer d10", "")


def _routed(spark, sf_dir):
    said = F.concat("query", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("query_id") % 7 + 1).cast("int")))
    return questions(spark, sf_dir).select("query_id", said.alias("query"))


def alias_route(spark, sf_dir):
    found = routing.route(_routed(spark, sf_dir), routing.alias_table(routing.entries(_measured(spark, sf_dir))))
    return found.select("query_id", F.array_join("measure_ids", ",").alias("measure_ids"))


def literal_id_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("query_id", F.array_join(routing.literal_ids(F.col("query")), ",").alias("measure_ids"))


def token_estimate(spark, sf_dir):
    return _big(texts(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))


def word_windows(spark, sf_dir):
    windows = chunking.word_windows(F.col("text"), 480, 64)
    return _big(texts(spark, sf_dir).select("doc_id", F.posexplode(windows).alias("pos", "w")).select("doc_id", "pos", F.length("w").alias("n_chars"), F.md5(F.col("w").cast("binary")).alias("digest")))


def chunk_greedy(spark, sf_dir):
    pieces = texts(spark, sf_dir).select("doc_id", F.posexplode(chunking.split_text(F.col("text"))).alias("pos", "piece"))
    return _big(pieces.select("doc_id", "pos", F.length("piece").alias("n_chars"), T.token_estimate(F.col("piece")).alias("tokens"), F.md5(F.col("piece").cast("binary")).alias("digest")))


def _with_ids(spark, sf_dir):
    c = chunks(spark, sf_dir)
    measure = F.when(F.col("lang") == "en", F.lit(None).cast("string")).otherwise(F.col("lang"))
    return c.select("doc_id", "text", T.chunk_id(F.col("source"), measure, F.col("section"), F.col("text")).alias("chunk_id"))


def chunk_ids(spark, sf_dir):
    return _with_ids(spark, sf_dir).select("doc_id", "chunk_id")


def chunk_dedup(spark, sf_dir):
    return chunking.keep_first(_with_ids(spark, sf_dir).select("chunk_id", "doc_id"), "chunk_id", "doc_id")


def chunk_headers(spark, sf_dir):
    c = chunks(spark, sf_dir)
    measure = F.when(F.col("lang") == "en", F.lit(None).cast("string")).otherwise(F.col("lang"))
    return c.select("doc_id", chunking.header(F.col("source"), measure, F.col("measure_id"), F.initcap("section"), F.col("plan_year")).alias("header"))


def normalize_block(spark, sf_dir):
    raw = F.concat(F.lit("Patient - level  "), F.replace("text", F.lit(". "), F.lit(".\n  • ")), F.lit("\n\n - 2025- 2026"))
    out = T.normalized_block(raw)
    return _big(texts(spark, sf_dir).select("doc_id", F.length(out).alias("n_chars"), F.md5(out.cast("binary")).alias("digest")))


def _blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = F.concat(F.lit("Lead of "), "source", F.lit("\n  Metric: "), "text", F.lit("\n Data  Time Frame : "), "lang", F.lit("\nMetric Notes: of "), F.col("n_chars").cast("string"), F.lit("\nNot a label: x\n"), F.col("source"), F.lit(": NQF: no"))
    return d.select("doc_id", made.alias("block"))


def field_split(spark, sf_dir):
    f = _blocks(spark, sf_dir).select("doc_id", F.posexplode(parsing.fields(F.col("block"))).alias("pos", "f"))
    return _big(f.select("doc_id", "pos", F.col("f.label").alias("label"), parsing.section_kind(F.col("f.label")).alias("kind"), F.md5(F.col("f.text").cast("binary")).alias("digest")))


def _notes(spark, sf_dir):
    """Extracted texts with a list of contents, an introduction, two measures and page marks; every fourth is a plain document of pages."""
    i, flat = F.col("doc_id"), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    number = lambda least, n: (least + i % n).cast("string")
    text = F.concat(
        F.lit("\0PAGE:1\0\nNotes of "), "source", F.lit("\nMeasure: C01 - Listed ..... 9\n\0PAGE:2\0\nMeasure: C"), number(10, 80), F.lit(" - Name of "), "source", F.lit("\nMetric: "), flat,
        F.lit("\nExclusions: none of "), "lang", F.lit("\n\0PAGE:3\0\nMeasure: D"), number(10, 70), F.lit(": Part  of "), "lang", F.lit("\n  Data  Time Frame : "), number(2025, 3), F.lit("\n"),
    )
    none = F.lit(None).cast("string")
    rest = [none.alias(c) for c in ("publisher", "source_url", "doc_type", "retrieval_date")]
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("doc_id"), F.col("source").alias("title"), (2025 + i % 3).cast("int").alias("plan_year"), F.lit("redistributable").alias("license_posture"),
        F.when(i % 4 == 3, "generic_pdf").otherwise("technical_notes").alias("parser_id"), text.alias("text"), *rest,
    )


def nested_documents(spark, sf_dir):
    """Texts parsed, nested and laid flat again: every section with its place in its document."""
    flat = chunking.sections_of(assembly.parsed(_notes(spark, sf_dir)))
    general = F.col("measure_id").isNull()
    return _big(flat.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(~general, F.col("m_pos")).alias("m_pos"), "s_pos", "measure_id", "measure_name", "kind", "heading", "page", F.md5(F.col("text").cast("binary")).alias("digest")))


def section_kinds(spark, sf_dir):
    return _big(field_split(spark, sf_dir).groupBy("kind", "label").agg(F.count("*").alias("n")))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def segment_bounds(spark, sf_dir):
    """A user's turn begins a segment that runs to the next one."""
    heads = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", F.col("turn").alias("start"))
    return asof.segments(heads, on="conv_id", at="start")


def page_asof(spark, sf_dir):
    """Each turn with the last user turn before or at it."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "role")
    return asof.asof_join(turns.drop("role"), turns.where("role = 'user'"), on="conv_id", left_at="turn", right_at="turn", take={"page": "turn"})


def segment_rows(spark, sf_dir):
    """How many turns, and of which length, stand in each user's segment before its assistant's answer is two turns old."""
    turns = _turns(spark, sf_dir)
    heads = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 3).alias("limit"))
    held = asof.within(turns.select("conv_id", "turn", F.length("text").alias("n_chars")), heads, on="conv_id", at="turn", head_at="start", stop_at="limit", take={"until": "limit"})
    return _big(held.groupBy("conv_id", "until").agg(F.count("*").alias("turns"), F.sum("n_chars").alias("n_chars")))


def index_differences(spark, sf_dir):
    """Two versions of a corpus: German headers and French texts changed, one source gone, the benchmark's passages added."""
    none = F.lit(None).cast("string")
    made = lambda d: d.select(T.chunk_id(F.col("source"), none, F.lit("general"), F.col("text")).alias("chunk_id"), "text", "header", "doc_id")
    once = lambda d: chunking.keep_first(made(d), "chunk_id", "doc_id").drop("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").where("text is not null")
    first = docs.withColumn("header", F.concat_ws(" | ", "source", F.lit("2025")))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" (2026)"))).otherwise(F.col("text"))
    second = docs.where("source <> 'src3'").withColumn("text", text).withColumn("header", F.concat_ws(" | ", "source", F.when(F.col("lang") == "de", "2026").otherwise("2025")))
    more = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"), F.lit("en").alias("lang"), F.lit("benchmark | 2026").alias("header"))
    found = index.differences(once(first), once(second.unionByName(more)))
    return found.groupBy(F.substring_index("chunk_id", ":", 1).alias("source"), "status").agg(F.count("*").alias("n"))


def _replies(spark, sf_dir):
    t = _turns(spark, sf_dir)
    tail = F.when(F.col("turn") % 3 == 0, " B [2]. A [1].").when(F.col("turn") % 3 == 1, "").otherwise(" [9] [0]")
    return t.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("]"), tail).alias("reply"))


def citations(spark, sf_dir):
    r, n = F.col("reply"), F.lit(3)
    join = lambda c: F.array_join(F.transform(c, lambda m: m.cast("string")), ",")
    return _replies(spark, sf_dir).select(
        "conv_id", "turn", join(answering.markers(r)).alias("markers"), answering.citations_valid(r, n).alias("valid"), join(answering.invalid_markers(r, n)).alias("invalid"), join(answering.cited(r, n)).alias("cited"),
        answering.correction_hint(r, n).alias("hint"),
    )


def citation_cards(spark, sf_dir):
    """A benchmark item's made-up reply cites ranks; each card is the chunk of that rank."""
    ranked = bm25_topk(spark, sf_dir)
    n = ranked.groupBy("query_id").agg(F.count("*").alias("chunks"))
    replies = n.select("query_id", "chunks", F.concat(F.lit("x ["), (F.col("query_id") % 8 + 1).cast("string"), F.lit("] y [2][1] z [12]")).alias("reply"))
    return _big(answering.cards(replies, ranked).select("query_id", "place", "marker", "doc_id"))


def snippets(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = T.snippet(F.col("text"), F.col("quality") == 1)
    return _big(d.join(lab, "doc_id").select("doc_id", "quality", F.length(s).alias("n_chars"), F.md5(s.cast("binary")).alias("digest")))


def context_blocks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    ranked = retrieval.hydrate(bm25_topk(spark, sf_dir).select("query_id", "doc_id", "rank"), c, "text", "section", "source", "plan_year")
    block = answering.context_block(F.col("rank"), F.col("doc_id").cast("string"), F.col("source"), F.when(F.col("section") == "general", None).otherwise(F.col("section")), F.col("plan_year"), F.concat(F.lit("s3://"), "source"), F.col("text"))
    return answering.contexts(ranked, block).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def answer_state_machine(spark, sf_dir):
    r = _replies(spark, sf_dir)
    first = F.when(F.col("turn") % 7 == 5, F.concat(F.lit("No. "), F.lit(answering.REFUSAL))).otherwise(F.col("reply"))
    second = F.when(F.col("conv_id") % 3 == 0, F.lit("Now cited [1].")).when(F.col("conv_id") % 3 == 1, F.lit(answering.REFUSAL)).otherwise(F.lit("again nothing"))
    kind = answering.outcome((F.col("conv_id") % 5).cast("int"), F.when(F.col("turn") % 11 == 3, 0.2).when(F.col("turn") % 11 == 4, F.lit(None)).otherwise(0.7), F.col("conv_id") % 4 != 0, first, second)
    shown = answering.shown(kind, F.when(answering.citations_valid(first, (F.col("conv_id") % 5).cast("int")), first).otherwise(second))
    return r.select("conv_id", "turn", kind.alias("kind"), F.md5(shown.cast("binary")).alias("digest"))


def _items(spark, sf_dir):
    """Gold items from the benchmark: every fifth a trap; labels name a source, a section and a part of the language, or none."""
    i = F.col("item_id")
    trap = i % 5 == 4
    section = F.element_at(F.array(*map(F.lit, SECTION_KINDS)), (i % 7 + 1).cast("int"))
    label = lambda source, part: F.struct(F.concat(F.lit("src"), source.cast("string")).alias("doc_id"), part.cast("string").alias("measure_name_contains"), section.alias("section"))
    gold = F.array(label(i % 20, F.lit("E")), label((i + 1) % 20, F.lit(None)), label((i + 2) % 20, F.when(i % 6 == 0, F.lit("zz")).otherwise(F.lit("FR"))))
    return table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("item_id"), F.col("text").alias("question"), F.when(trap, "refusal_scope").otherwise(F.concat(F.lit("cat"), (i % 6).cast("string"))).alias("category"), F.when(i % 4 == 0, "dev").otherwise("test").alias("split"),
        F.when(trap & (i % 10 == 4), F.expr("cast(array() as array<struct<doc_id:string,measure_name_contains:string,section:string>>)")).otherwise(gold).alias("gold"),
        F.when(trap, F.lit(None)).when(i % 9 == 0, F.lit(" ")).otherwise(F.lit("ref")).alias("reference_answer"),
    )


def _labels(spark, sf_dir):
    long = _items(spark, sf_dir).where("not startswith(category, 'refusal')").select("item_id", F.posexplode("gold").alias("pos", "g"))
    return long.select(F.concat_ws(":", "item_id", F.col("pos").cast("string")).alias("label_id"), "item_id", "g.*")


def _gold_chunks(spark, sf_dir):
    c = passages(spark, sf_dir)
    return c.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "section", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("lang")).alias("measure_name"))


def gold_resolution(spark, sf_dir):
    return evaluation.resolved(evaluation.label_matches(_labels(spark, sf_dir), _gold_chunks(spark, sf_dir)))


def unresolved_labels(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return evaluation.unresolved(labels, evaluation.label_matches(labels, _gold_chunks(spark, sf_dir)))


def dataset_validation(spark, sf_dir):
    return evaluation.violations(_items(spark, sf_dir))


def dataset_summary(spark, sf_dir):
    return _big(evaluation.summary(_items(spark, sf_dir), gold_resolution(spark, sf_dir)))


def _metrics(spark, sf_dir, *lexical):
    """Metrics of each item for every arm: hybrid, or those asked for."""
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    gate = retrieval.best_similarity(c, q, floor=0.97).select(F.col("query_id").cast("string").alias("item_id"), "refused")
    items = _items(spark, sf_dir).select("item_id", "category", "split", F.col("category").startswith("refusal").alias("is_refusal")).join(gate, "item_id", "left")
    gold = gold_resolution(spark, sf_dir)
    found = retrieval.arms(c, q, SETTINGS, measure="measure_id", year="plan_year", lexical=lexical or (True,), texts=passages(spark, sf_dir))
    return [evaluation.item_metrics(items, ranked.select(F.col("query_id").cast("string").alias("item_id"), F.col("doc_id").alias("chunk_id"), "rank"), gold) for ranked in found]


def eval_per_item(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir)[0])


def eval_grouping_sets(spark, sf_dir):
    return rounded(evaluation.report(_metrics(spark, sf_dir)[0]))


def refusal_accuracy(spark, sf_dir):
    return rounded(evaluation.refusal_accuracy(_metrics(spark, sf_dir)[0]))


def ratchet_gate(spark, sf_dir):
    baseline = spark.createDataFrame(list(BASELINE.items()), "metric string, baseline double")
    return rounded(evaluation.ratchet(evaluation.report(_metrics(spark, sf_dir)[0]), baseline))


def hybrid_dense_delta(spark, sf_dir):
    hybrid, only = _metrics(spark, sf_dir, True, False)
    both = hybrid.withColumn("arm", F.lit("hybrid")).unionByName(only.withColumn("arm", F.lit("dense")))
    pivot = both.where("metric <> 'refused'").groupBy("metric").pivot("arm", ["hybrid", "dense"]).agg(F.avg("value"))
    return rounded(pivot.withColumn("delta", F.col("hybrid") - F.col("dense")))


def judge_verdicts(spark, sf_dir):
    """Made-up judge replies: prose or broken braces round a JSON verdict."""
    t = F.col("turn")
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "unsupported", "contradicted"))), (t % 3 + 1).cast("int"))
    flag = F.when(t % 2 == 0, F.lit(', "citation_valid": true')).when(t % 5 == 0, F.lit(', "citation_valid": false')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"claims": [{"claim": "a", "verdict": "supported", "citation_valid": true}, {"claim": "b", "verdict": "'), verdict, F.lit('"'), flag, F.lit('}], "notes": "n"}'))
    reply = F.when(F.col("conv_id") % 4 == 3, F.lit("I cannot grade this.")).when(F.col("conv_id") % 4 == 2, F.concat(F.lit("{not json} but: "), body)).otherwise(F.concat(F.lit("Sure:\n"), body, F.lit("\nDone.")))
    return rounded(_turns(spark, sf_dir).select("conv_id", "turn", *evaluation.verdict_counts(evaluation.judged(reply))))


def integrity_sha256(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", corpus.digest(F.col("html")).alias("sha256"))


def license_gate(spark, sf_dir):
    posture = F.element_at(F.array(*map(F.lit, ("us_gov_public_domain", "redistributable", "public_web_cite_only", "fetch_at_build_only"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(posture.alias("license_posture"), "source")
    return _big(d.groupBy("license_posture", corpus.committable(F.col("license_posture")).alias("committable")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")))


NAMES = (
    "tokenize_stats bm25_df_idf bm25_topk bm25_topk_filtered dense_topk dense_topk_filtered best_similarity_gate rrf_fuse hybrid_topk hybrid_fallback dense_only_arm routed_topk default_year year_inference alias_table alias_route measure_index augmented_query nested_documents "
    "literal_id_route token_estimate word_windows chunk_greedy chunk_ids chunk_dedup chunk_headers normalize_block field_split section_kinds segment_bounds page_asof segment_rows index_differences citations citation_cards snippets context_blocks "
    "answer_state_machine gold_resolution unresolved_labels dataset_validation dataset_summary eval_per_item eval_grouping_sets refusal_accuracy ratchet_gate hybrid_dense_delta judge_verdicts integrity_sha256 license_gate"
).split()


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in NAMES}
