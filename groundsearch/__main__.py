"""Command line: build, ask, eval, report, version.

    python -m groundsearch build --source DIR --index DIR [--texts DIR --manifest FILE [--renormalize]]
    python -m groundsearch ask "question" --index DIR [--year 2026] [--retrieval-only]
    python -m groundsearch eval --retrieval --dataset FILE --index DIR [--gate --baseline FILE] [--out FILE]
    python -m groundsearch report --readme FILE [--artifact FILE | --results DIR]

Vectors are read from the index where it has them; `main` takes a function that embeds passages and questions, without
which search is by words alone, and one that generates replies, without which an answer is the cards of the passages found.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import answering, assembly, evaluation, routing
from .operators.chunking import embed_text
from .plans import index, retrieval
from .sources import corpus, scratch

VERSION = "0.1.0"
#: Turns (query_id, text) into (query_id, embedding).
Embed = Callable[[DataFrame], DataFrame]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("groundsearch").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_index(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks as retrieval wants them: doc_id is the chunk's id, text what is searched."""
    index.verify(spark, directory)
    chunks = index.chunks(spark, directory).select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("document"), embed_text(F.col("header"), F.col("text")).alias("text"), F.col("text").alias("body"), "header", "section", "measure_id", "measure_name", "plan_year", "license_posture", "source_url")
    return chunks.join(index.vectors(spark, directory).withColumnRenamed("chunk_id", "doc_id"), "doc_id", "left")


def planned(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions (query_id, query, year) with the plan year and the measures (an empty list for all) that apply."""
    known = chunks.agg(F.sort_array(F.collect_set("plan_year")).alias("years")).crossJoin(routing.default_year(chunks))  # one row
    year = routing.inferred_year(F.col("query"), F.col("years"), F.col("default_year"), F.col("year"))
    asked = questions.crossJoin(F.broadcast(known)).select("query_id", "query", year.alias("plan_year"))
    routes = routing.route(asked, routing.alias_table(routing.entries(chunks)), year="plan_year")
    return asked.join(routes.withColumnRenamed("measure_ids", "measure_id"), "query_id")


def ask(args: argparse.Namespace) -> int:
    spark = session()
    chunks, settings = open_index(spark, args.index), Settings()
    question = spark.createDataFrame([("q", args.question, args.year)], "query_id string, query string, year int")
    asked = index.embed_questions(planned(chunks, question), args.embed, settings)
    best = retrieval.retrieve(chunks, asked, settings, measure="measure_id", year="plan_year", index=index.lexicon(spark, args.index))
    ranked = scratch.written(retrieval.hydrate(best, chunks, "header", "document", "body", "section", "measure_id", "plan_year", "license_posture", "source_url"), "found")
    from .functions.text import snippet

    block = answering.context_block(F.col("rank"), F.col("doc_id"), F.col("header"), F.col("measure_id"), F.col("plan_year"), F.col("source_url"), F.col("body"))
    similarity = retrieval.best_similarity(chunks, asked, settings.refusal_score_floor).select("query_id", F.col("best_similarity").alias("similarity"))
    counted = ranked.groupBy("query_id").agg(F.count("*").alias("chunks"))
    whole = question.select("query_id", F.col("query").alias("question")).join(answering.contexts(ranked, block), "query_id", "left").join(counted, "query_id", "left").join(similarity, "query_id", "left")
    answer = answering.answers(whole, None if args.retrieval_only else args.generate, floor=settings.refusal_score_floor).first()
    if answer.kind in ("answered", "retrieval_only"):
        cards = ranked.select("rank", "query_id", answering.title(F.col("header"), F.col("document")).alias("title"), "plan_year", "source_url", snippet(F.col("body"), corpus.committable(F.col("license_posture"))).alias("snippet"))
        if answer.kind == "answered":
            replies = counted.select("query_id", "chunks", F.lit(answer.reply).alias("reply"))
            cards = answering.cards(replies, cards)
        rows = cards.orderBy(*(["place"] if answer.kind == "answered" else ["rank"])).collect()  # final_k rows
    else:
        rows = []
    body, _, disclaimer = answer.text.rpartition("\n\n")
    print(body)
    for r in rows:
        print(f"[{r['rank']}] {r.title} ({r.plan_year}) {r.source_url}\n    {r.snippet}")
    print(f"\n{disclaimer}")
    return 0


def normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parses extracted texts into the source folder, where that holds no documents or is to be made anew."""
    if args.renormalize or not corpus.has_normalized(spark, args.source):
        manifest = corpus.load_manifest(spark, args.manifest)
        to_write = manifest.where("commit_policy = 'commit_normalized'")
        corpus.write_normalized(assembly.parsed(corpus.read_texts(spark, args.texts, to_write)), manifest, args.source)


def build(args: argparse.Namespace) -> int:
    spark = session()
    if args.texts:
        normalize(spark, args)
    print(json.dumps(index.build(corpus.load_normalized(spark, args.source), args.index, Settings(), embed=args.embed and (lambda texts: args.embed(texts.withColumnRenamed("chunk_id", "query_id")).withColumnRenamed("query_id", "chunk_id")))))
    return 0


def evaluate(args: argparse.Namespace) -> int:
    if not args.retrieval:
        print("choose a mode: --retrieval", file=sys.stderr)
        return 2
    if not Path(args.dataset).exists():
        print(f"no gold set at {args.dataset}", file=sys.stderr)
        return 1
    spark = session()
    chunks = open_index(spark, args.index)
    items = corpus.load_gold(spark, args.dataset)
    broken = [f"{r.item_id}: {r.problem}" for r in evaluation.violations(items).take(20)]
    if broken:
        raise evaluation.DatasetError("the gold set breaks its rules: " + "; ".join(broken))
    labels = items.select("item_id", F.posexplode("gold").alias("pos", "g")).select(F.concat_ws(":", "item_id", F.col("pos").cast("string")).alias("label_id"), "item_id", "g.*")
    matches = evaluation.label_matches(labels, chunks.select(F.col("doc_id").alias("chunk_id"), F.col("document").alias("doc_id"), "section", "measure_name"))
    lost = [r.label_id for r in evaluation.unresolved(labels, matches).select("label_id").take(20)]
    if lost:
        raise evaluation.DatasetError(f"labels that match no chunk: {sorted(lost)}")
    listed = items.select("item_id", "category", "split", F.col("category").startswith("refusal").alias("is_refusal"))
    gold = evaluation.resolved(matches)
    evaluation.require_gold(listed, gold)
    asked = index.embed_questions(planned(chunks, items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.lit(None).cast("int").alias("year"))), args.embed, Settings())
    if args.embed:  # without vectors there is neither a confidence gate nor a dense arm
        gate = retrieval.best_similarity(chunks, asked, Settings().refusal_score_floor).select(F.col("query_id").alias("item_id"), "refused")
        listed = listed.join(gate, "item_id", "left")
    else:
        listed = listed.withColumn("refused", F.lit(None).cast("boolean"))
    arms = retrieval.arms(chunks, asked, Settings(), measure="measure_id", year="plan_year", lexical=(True, False) if args.embed else (True,), index=index.lexicon(spark, args.index))
    scores = [evaluation.item_metrics(listed, ranked.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("chunk_id"), "rank"), gold) for ranked in arms]
    by: dict = {"category": {}, "split": {}, "overall": {}}
    for r in evaluation.report(scores[0]).collect():  # a few rows for each category
        (by["overall"] if r.scope == "overall" else by[r.scope].setdefault(r.name, {}))[r.metric] = r.value
    dense = {r.metric: r.value for r in evaluation.report(scores[1]).where("scope = 'overall'").collect()} if args.embed else {}
    dataset_hash = hashlib.sha256(Path(args.dataset).read_bytes()).hexdigest()[:16]
    artifact = {"config_hash": Settings().config_hash, "dataset_hash": dataset_hash, "metrics": {"overall": by["overall"], "per_category": by["category"], "per_split": by["split"], **({"dense_only_overall": dense} if dense else {})}}
    if args.out:
        evaluation.write_artifact(Path(args.out), artifact)
    print(evaluation.markdown(artifact))
    if args.gate and args.baseline and Path(args.baseline).exists():
        held = json.loads(Path(args.baseline).read_text())
        held = held.get("metrics", held)
        problems = evaluation.regressions(by["split"].get("test", by["overall"]), held.get("overall", held))
        print("\n".join(problems) or "no regression")
        return int(bool(problems))
    return 0


def report(args: argparse.Namespace) -> int:
    artifact = Path(args.artifact) if args.artifact else evaluation.latest_artifact(Path(args.results))
    evaluation.sync_region(Path(args.readme), json.loads(artifact.read_text()))
    return 0


def main(argv: list[str] | None = None, embed: Embed | None = None, generate: answering.Generate | None = None) -> int:
    parser = argparse.ArgumentParser(prog="groundsearch")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("build")
    p.add_argument("--source", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--texts", help="extracted texts, one file for each document of the manifest, to make the source from")
    p.add_argument("--manifest")
    p.add_argument("--renormalize", action="store_true", help="even if the source holds documents")
    p = commands.add_parser("ask")
    p.add_argument("question")
    p.add_argument("--index", required=True)
    p.add_argument("--year", type=int)
    p.add_argument("--retrieval-only", action="store_true")
    p = commands.add_parser("eval")
    p.add_argument("--retrieval", action="store_true")
    p.add_argument("--dataset", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--gate", action="store_true")
    p.add_argument("--baseline")
    p.add_argument("--out")
    p = commands.add_parser("report")
    p.add_argument("--artifact")
    p.add_argument("--results", default="results", help="the folder whose last artifact counts, if none is named")
    p.add_argument("--readme", required=True)
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "build" and (args.renormalize or args.texts or args.manifest) and not (args.texts and args.manifest):
        parser.error("--texts and --manifest go together, and --renormalize needs both")
    args.embed, args.generate = embed, generate
    try:
        if args.command == "version":
            print(VERSION)
            return 0
        return {"build": build, "ask": ask, "eval": evaluate, "report": report}[args.command](args)
    except index.StaleIndexError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
