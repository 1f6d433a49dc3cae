"""Routing of questions: aliases and literal ids to measures, mentions to plan years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .patterns import found_in

#: Parts of measure names and the aliases that stand for them. Fixed values.
ALIASES = {
    "breast cancer screening": ("bcs", "breast cancer", "mammogram", "mammography"),
    "colorectal cancer screening": ("col", "colorectal", "colonoscopy", "colorectal cancer"),
    "annual flu vaccine": ("flu", "influenza", "flu vaccine", "flu shot"),
    "monitoring physical activity": ("pao", "physical activity"),
    "special needs plan": ("snp",),
    "care for older adults": ("coa", "older adults"),
    "osteoporosis management": ("omw", "osteoporosis"),
    "eye exam": ("eed", "eye exam", "retinal exam", "diabetic eye"),
    "blood sugar controlled": ("gsd", "hbd", "glycemic", "blood sugar", "hba1c", "a1c"),
    "kidney health evaluation": ("ked", "kidney"),
    "controlling blood pressure": ("cbp", "blood pressure"),
    "reducing the risk of falling": ("frm", "falling", "falls", "fall risk"),
    "improving bladder control": ("mui", "bladder", "incontinence"),
    "medication reconciliation post-discharge": ("mrp", "medication reconciliation"),
    "plan all-cause readmissions": ("pcr", "readmission", "readmissions"),
    "statin therapy for patients with cardiovascular disease": ("spc", "statin"),
    "transitions of care": ("trc", "transitions of care"),
    "follow-up after emergency department visit": ("fmc", "emergency department", "ed visit"),
    "medication adherence for diabetes": ("mad", "adherence for diabetes"),
    "medication adherence for hypertension": ("mah", "ras antagonists"),
    "medication adherence for cholesterol": ("mac", "statins"),
    "mtm program completion": ("mtm", "cmr", "comprehensive medication review"),
    "statin use in persons with diabetes": ("supd", "statin"),
}
#: Aliases of several words match anywhere in a question.
PHRASES = tuple(sorted({alias for names in ALIASES.values() for alias in names if " " in alias}))
#: What says that a question compares years. A fixed value.
CROSS_YEAR = r"(?i)\b(chang\w*|renam\w*|differ\w*|previous year|prior year|prior to 20\d{2}|compar\w*|versus|vs\.?|new in|retired|no longer|used to be|year.over.year)\b"
LEAST_SHARE = 0.05


def entries(chunks: DataFrame) -> DataFrame:
    """plan_year, measure_id, measure_name of the measures that chunks name."""
    return chunks.where("measure_id is not null and measure_name is not null").select("plan_year", "measure_id", "measure_name").distinct()


def alias_table(entries: DataFrame) -> DataFrame:
    """Entries (plan_year, measure_id, measure_name) to (alias, plan_year, measure_ids). The fragments are a fixed short list."""
    known = F.array(*[F.struct(F.lit(fragment).alias("fragment"), F.array(*map(F.lit, names)).alias("names")) for fragment, names in ALIASES.items()])
    hits = F.filter(known, lambda a: F.contains(F.lower("measure_name"), a.fragment))
    named = entries.select("plan_year", "measure_id", F.explode(F.array_distinct(F.flatten(F.transform(hits, lambda a: a.names)))).alias("alias"))
    return named.groupBy("alias", "plan_year").agg(F.sort_array(F.collect_set("measure_id")).alias("measure_ids"))


def literal_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b([CD]\d{2})\b"), F.lit(1)), F.upper)))


def route(queries: DataFrame, aliases: DataFrame, *, text: str = "query", year: str | None = None, phrases: Sequence[str] = PHRASES) -> DataFrame:
    """query_id, measure_ids: sorted; empty for no filter. One-word aliases match tokens; those of several words (`phrases`) match anywhere, found in one pass over each question."""
    asked = queries.select("query_id", F.lower(text).alias("lowered"), tokens(F.col(text)).alias("tokens"), literal_ids(F.col(text)).alias("literal"), (F.col(year) if year else F.lit(None).cast("int")).alias("year"))
    words = aliases.where(~F.contains("alias", F.lit(" ")))
    in_year = F.col("year").isNull() | (F.col("year") == F.col("plan_year"))
    by_word = asked.select("query_id", "year", F.explode("tokens").alias("alias")).join(words, "alias").where(in_year)
    said = found_in(asked.select(F.struct("query_id", "year").alias("asked"), "lowered"), phrases, key="asked", text="lowered", into="alias")
    by_phrase = said.select("asked.*", "alias").join(aliases, "alias").where(in_year)
    found = by_word.select("query_id", F.explode("measure_ids").alias("m")).unionByName(by_phrase.select("query_id", F.explode("measure_ids").alias("m")))
    found = found.unionByName(asked.select("query_id", F.explode("literal").alias("m")))
    ids = found.groupBy("query_id").agg(F.sort_array(F.collect_set("m")).alias("measure_ids"))
    return asked.select("query_id").join(ids, "query_id", "left").select("query_id", F.coalesce("measure_ids", F.expr("cast(array() as array<string>)")).alias("measure_ids"))


def measure_index(chunks: DataFrame) -> DataFrame:
    """measure_name, measure_ids: each name's ids over all years, sorted, to choose measures from."""
    return entries(chunks).groupBy("measure_name").agg(F.sort_array(F.collect_set("measure_id")).alias("measure_ids"))


def augmented(queries: DataFrame, chosen: DataFrame, index: DataFrame, *, text: str = "query") -> DataFrame:
    """`queries` with the sorted ids of the measures that were chosen (query_id, measure_name) behind the text, for the router to find. Names that `index` lacks add nothing."""
    ids = chosen.join(index, "measure_name").select("query_id", F.explode("measure_ids").alias("m")).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("m")), " ").alias("__ids"))
    return queries.join(ids, "query_id", "left").withColumn(text, F.concat_ws(" ", text, "__ids")).drop("__ids")


def default_year(chunks: DataFrame) -> DataFrame:
    """One row: the latest year that holds at least a twentieth of the chunks, or null."""
    by_year = chunks.groupBy("plan_year").agg(F.count("*").alias("n"))
    total = by_year.agg(F.sum("n").alias("total"))
    return by_year.crossJoin(F.broadcast(total)).where(F.col("n") >= LEAST_SHARE * F.col("total")).agg(F.max("plan_year").alias("default_year"))  # one row


def inferred_year(text: Column, indexed: Column, default: Column, explicit: Column | None = None) -> Column:
    """An explicit year; else the one indexed year that is mentioned; else none for several or for comparisons; else the default."""
    mentioned = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    known = F.array_intersect(mentioned, indexed)
    found = F.when(F.size(known) == 1, F.get(known, F.lit(0))).when((F.size(known) > 1) | F.regexp_like(text, F.lit(CROSS_YEAR)), F.lit(None).cast("int")).otherwise(default)
    return F.coalesce(explicit, found) if explicit is not None else found
