"""Retrieval evaluation: gold labels, metrics, aggregates, the regression ratchet, and a judge's verdicts."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_scan import first_object

GATES = ("recall@8", "mrr")
BEGIN, END = "<!-- EVAL:BEGIN -->", "<!-- EVAL:END -->"


class DatasetError(ValueError):
    """The gold set breaks its rules, or labels match nothing."""


def violations(items: DataFrame) -> DataFrame:
    """item_id, problem: every broken rule of the gold set. Categories that begin with `refusal` are traps."""
    trap = F.col("category").startswith("refusal")
    size = F.coalesce(F.size("gold"), F.lit(0))
    blank = F.trim(F.coalesce("reference_answer", F.lit(""))) == ""
    checks = F.array(
        F.when(trap & (size > 0), "refusal item must carry no gold labels"),
        F.when(~trap & (size == 0), "answerable item needs >= 1 gold label"),
        F.when(~trap & blank, "answerable item needs a reference_answer"),
    )
    single = items.select("item_id", F.explode(F.filter(checks, lambda p: p.isNotNull())).alias("problem"))
    twice = items.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("duplicate item_id").alias("problem"))
    return single.unionByName(twice)


def label_matches(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """labels: label_id, item_id, doc_id, section, measure_name_contains; chunks: chunk_id, doc_id, section, measure_name. A null name asks for a null name."""
    name, part = F.col("measure_name"), F.col("measure_name_contains")
    fits = F.when(part.isNull(), name.isNull()).otherwise(F.coalesce(F.contains(F.lower(name), F.lower(part)), F.lit(False)))
    return labels.join(chunks.select("chunk_id", "doc_id", "section", "measure_name"), ["doc_id", "section"]).where(fits).select("label_id", "item_id", "chunk_id")


def resolved(matches: DataFrame) -> DataFrame:
    return matches.select("item_id", "chunk_id").distinct()


def unresolved(labels: DataFrame, matches: DataFrame) -> DataFrame:
    return labels.join(matches, "label_id", "left_anti")


def require_gold(items: DataFrame, gold: DataFrame) -> None:
    """An answerable item (is_refusal false) without a gold chunk has no metric: an error that names such items, so that none is left out unseen."""
    lost = items.where(~F.col("is_refusal")).join(gold, "item_id", "left_anti").select("item_id").orderBy("item_id").take(20)
    if lost:
        raise DatasetError(f"answerable items without a gold chunk: {[r.item_id for r in lost]}")


def item_metrics(items: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 8)) -> DataFrame:
    """item_id, category, split, metric, value. Answerable items: hit@1, mrr, precision@8, recall at each k. Traps with a `refused` flag: refused.

    items: item_id, category, split, is_refusal, refused (may be null); ranked: item_id, chunk_id, rank; gold: item_id, chunk_id.
    """
    if min(ks) < 1:
        raise ValueError("k must be positive")
    size = gold.groupBy("item_id").agg(F.count("*").alias("gold"))
    hits = ranked.join(gold, ["item_id", "chunk_id"]).groupBy("item_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in sorted({*ks, 8})])
    scored = items.join(size, "item_id", "left").join(hits, "item_id", "left")
    count = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    values = {"hit@1": (F.coalesce("first", F.lit(0)) == 1).cast("double"), "mrr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), "precision@8": count(8) / F.lit(8.0)}
    values |= {f"recall@{k}": count(k) / F.col("gold") for k in ks}
    answerable = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col("gold") > 0, v).alias("value")) for m, v in values.items()])
    trap = F.array(F.struct(F.lit("refused").alias("metric"), F.col("refused").cast("double").alias("value")))
    long = scored.select("item_id", "category", "split", F.explode(F.when(F.col("is_refusal"), trap).otherwise(answerable)).alias("m"))
    return long.select("item_id", "category", "split", "m.metric", "m.value").where("value is not null")


def report(metrics: DataFrame) -> DataFrame:
    """scope (category, split or overall), name, metric, value: means over the items that carry a metric. Refusals count by category only."""
    sets = metrics.groupingSets([["metric", "category"], ["metric", "split"], ["metric"]], "metric", "category", "split").agg(F.avg("value").alias("value"))
    scope = F.when(F.col("category").isNotNull(), "category").when(F.col("split").isNotNull(), "split").otherwise("overall")
    rows = sets.select(scope.alias("scope"), F.coalesce("category", "split", F.lit("")).alias("name"), "metric", "value")
    return rows.where("scope = 'category' or metric <> 'refused'")


def refusal_accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.where("metric = 'refused'").agg(F.avg("value").alias("refusal_trap_accuracy"))


def published(report_rows: DataFrame) -> dict[str, float]:
    """The test split's metrics, or else the overall ones."""
    rows = report_rows.where("(scope = 'split' and name = 'test') or scope = 'overall'").collect()  # a few metrics
    return {r.metric: r.value for r in rows if r.scope == "split"} or {r.metric: r.value for r in rows}


def regressions(current: Mapping[str, float], baseline: Mapping[str, float], tolerance: float = 0.02) -> list[str]:
    out = []
    for metric in GATES:
        if metric not in baseline:
            continue
        if metric not in current:
            out.append(f"{metric}: missing from report (baseline {baseline[metric]:.4f})")
        elif current[metric] < baseline[metric] - tolerance - 1e-12:
            out.append(f"{metric}: {current[metric]:.4f} < baseline {baseline[metric]:.4f} - {tolerance}")
    return out


def ratchet(report_rows: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """metric, baseline, value, regressed, as a table: gated metrics of `baseline` (metric, baseline) against the test split's, or the overall ones where there is no such split."""
    split = report_rows.where("scope = 'split' and name = 'test'").select("metric", F.col("value").alias("tested"))
    overall = report_rows.where("scope = 'overall'").select("metric", F.col("value").alias("whole"))
    some = split.agg((F.count("*") > 0).alias("some"))  # one row
    now = overall.join(split, "metric", "full").crossJoin(F.broadcast(some)).select("metric", F.when(F.col("some"), F.col("tested")).otherwise(F.col("whole")).alias("value"))
    joined = baseline.where(F.col("metric").isin(*GATES)).join(now, "metric", "left")
    return joined.withColumn("regressed", F.col("value").isNull() | (F.col("value") < F.col("baseline") - tolerance - 1e-12))


def markdown(artifact: Mapping) -> str:
    """The metrics table; with a second column for dense-only results where the artifact has them."""
    metrics = artifact["metrics"]
    main, other = metrics.get("overall", metrics), metrics.get("dense_only_overall") or {}
    head = ["Metric", "Hybrid", *(["Dense-only"] if other else [])]
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    lines += ["| " + " | ".join([m, f"{main[m]:.3f}", *([f"{other[m]:.3f}" if m in other else "–"] if other else [])]) + " |" for m in sorted(main)]
    stamps = [f"{k}: {artifact[k]}" for k in ("config_hash", "dataset_hash", "answer_model", "judge_model") if artifact.get(k)]
    return "\n".join([*lines, *(["", f"_{', '.join(stamps)}_"] if stamps else [])])


def summary(items: DataFrame, gold: DataFrame) -> DataFrame:
    """split, category, items, and the least, most and total gold chunks of an item."""
    sized = items.join(gold.groupBy("item_id").agg(F.count("*").alias("gold_chunks")), "item_id", "left")
    n = F.coalesce("gold_chunks", F.lit(0))
    return sized.groupBy("split", "category").agg(F.count("*").alias("items"), F.min(n).alias("least_gold"), F.max(n).alias("most_gold"), F.sum(n).alias("total_gold"))


def latest_artifact(directory: Path) -> Path:
    """The last artifact (*.json) of a results folder, by name: times of files change with every checkout."""
    found = sorted(directory.glob("*.json"), key=lambda p: p.name)
    if not found:
        raise DatasetError(f"no artifact in {directory}")
    return found[-1]


def write_artifact(path: Path, artifact: Mapping) -> None:
    path.write_text(json.dumps(artifact, sort_keys=True, indent=2, allow_nan=False) + "\n", encoding="utf-8", newline="\n")


def sync_region(path: Path, artifact: Mapping) -> str:
    """Replaces what stands between the marks of a text file; both must be there, in order."""
    text = path.read_text(encoding="utf-8")
    start, stop = text.find(BEGIN), text.find(END)
    if start < 0 or stop < start:
        raise DatasetError("marks are missing or out of order")
    new = f"{text[: start + len(BEGIN)]}\n{markdown(artifact)}\n{text[stop:]}"
    path.write_text(new, encoding="utf-8", newline="\n")
    return new


VERDICTS = ("supported", "unsupported", "contradicted")
VERDICT = "struct<claims:array<struct<claim:string,verdict:string,citation_valid:boolean>>,notes:string,problem:string>"


def _verdict(reply: str | None) -> dict:
    """claims and notes, or the problem that leaves them null."""
    found = first_object(reply or "")
    if found is None:
        return {"problem": "no JSON object"}
    claims = found.get("claims")
    if not isinstance(claims, list):
        return {"problem": "no 'claims' list"}
    out = []
    for i, claim in enumerate(claims):
        if not isinstance(claim, dict):
            return {"problem": f"claims[{i}] is not an object"}
        verdict, valid = claim.get("verdict"), claim.get("citation_valid")
        if verdict not in VERDICTS:
            return {"problem": f"claims[{i}]: invalid verdict"}
        if valid is not None and not isinstance(valid, bool):
            return {"problem": f"claims[{i}]: citation_valid is neither true, false nor null"}
        out.append({"claim": str(claim.get("claim") or ""), "verdict": verdict, "citation_valid": valid})
    return {"claims": out, "notes": str(found.get("notes") or "")}


def judged(reply: Column) -> Column:
    """A judge's reply to claims, notes and problem. The first JSON object in the reply counts, whatever stands around it; if any of its claims breaks the rules, claims are null and the problem says why."""

    @F.pandas_udf(VERDICT)
    def parse(replies: pd.Series) -> pd.DataFrame:
        found = [_verdict(r) for r in replies]
        return pd.DataFrame({k: pd.Series([v.get(k) for v in found], dtype=object) for k in ("claims", "notes", "problem")})

    return parse(reply)


def verdict_counts(verdict: Column) -> list[Column]:
    of = lambda v: F.size(F.filter(verdict.claims, lambda c: c.verdict == v))
    flags = F.filter(F.transform(verdict.claims, lambda c: c.citation_valid), lambda f: f.isNotNull())
    good = F.size(F.filter(flags, lambda f: f))
    total = F.size(verdict.claims)
    known = verdict.claims.isNotNull()
    return [
        F.when(known, total).alias("claims_total"), F.when(known, of("supported")).alias("claims_supported"), F.when(known, of("unsupported")).alias("claims_unsupported"),
        F.when(known, of("contradicted")).alias("claims_contradicted"), F.when(known & (F.size(flags) > 0), good / F.size(flags)).alias("citation_valid_ratio"),
        F.when(known & (total > 0), of("supported") / total).alias("faithfulness"),
    ]


def judge_input(question: Column, answer: Column, passages: Column) -> Column:
    numbered = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.lit("PASSAGES:\n"), numbered, F.lit("\n\nQUESTION:\n"), question, F.lit("\n\nANSWER:\n"), answer)
