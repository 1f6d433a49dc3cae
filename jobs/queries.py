"""The jobs as queries, and the same rows in SQL. Each runs twice into one new folder and returns what stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundsearch.plans.oracle import BM25, CHUNKED, ESTIMATE, _ranked
from groundsearch.sources.scratch import new_folder

from . import evaluate_retrieval, refresh_passages


def job1_refresh_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1", keep=True)
    for _ in range(2):
        refresh_passages.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/passages", f"{folder}/checkpoint")
    return refresh_passages.store(spark, f"{folder}/passages").selectExpr("chunk_id", "doc_id", "cast(pos as bigint) pos", "source", "header", "text", "cast(tokens as bigint) tokens", "cast(n_chars as bigint) n_chars", "batch", "lang")


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2", keep=True)
    for _ in range(2):
        evaluate_retrieval.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/report")
    return evaluate_retrieval.read(spark, f"{folder}/report").selectExpr("scope", "name", "metric", "round(round(value, 10), 6) as value")


JOB1_SQL = f"""{CHUNKED}, made as (
  select c.doc_id, c.pos, c.piece as text, d.lang, coalesce(d.source, '') as source,
    coalesce(d.source, '') || ':doc:general:' || substr(sha256(coalesce(d.source, '') || '|None|general|' || c.piece), 1, 16) as chunk_id
  from chunked c join documents d using (doc_id) where c.piece <> ''
), firsts as (
  select *, row_number() over (partition by chunk_id order by doc_id, pos) as n from made
)
select chunk_id, doc_id, pos, source, '[' || source || ' | General | General]' as header, text, {ESTIMATE.format("text")} as tokens, length(text) as n_chars, 0::bigint as batch, lang
from firsts where n = 1
"""

_MEANS = "select {scope} as scope, {name} as name, metric, avg(value) as value from metrics group by metric{by}"
JOB2_SQL = f"""with {BM25},
ranked as (select query_id as item_id, doc_id, rank from {_ranked("scored", 8, "round(score, 9) > 0")}),
gold as (select item_id, doc_id, lang from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''),
items as (select item_id, count(doc_id) as n, coalesce(arg_min(lang, doc_id), 'none') as category from benchmark left join gold using (item_id) group by item_id),
hits as (select item_id, min(rank) as first, count(*) filter (where rank <= 5) as h5, count(*) as h8 from ranked join gold using (item_id, doc_id) group by item_id),
metrics as (
  select item_id, category, m.metric, m.value from items i left join hits h using (item_id), lateral (values
    ('hit@1', (coalesce(first, 0) = 1)::int::double), ('mrr', coalesce(1.0::double / first, 0)), ('precision@8', coalesce(h8, 0) / 8.0::double),
    ('recall@5', coalesce(h5, 0) / n::double), ('recall@8', coalesce(h8, 0) / n::double)) m(metric, value)
  where n > 0
), means as (
  {_MEANS.format(scope="'category'", name="category", by=", category")} union all {_MEANS.format(scope="'overall'", name="''", by="")}
)
select scope, name, metric, round(round(value, 10), 6) as value from (
  select 'item' as scope, item_id::varchar as name, metric, value from metrics
  union all select 'item', item_id::varchar, 'documents', n::double from items
  union all select * from means
  union all select 'gate', '', metric, (value is null or value < 0.88::double - 1e-12)::int::double from (values ('recall@8'), ('mrr')) g(metric) left join (select metric, value from means where scope = 'overall') using (metric)
)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_refresh_passages": job1_refresh_passages, "job2_evaluate_retrieval": job2_evaluate_retrieval}


def oracle_sql() -> dict[str, str]:
    return {"job1_refresh_passages": JOB1_SQL, "job2_evaluate_retrieval": JOB2_SQL}
