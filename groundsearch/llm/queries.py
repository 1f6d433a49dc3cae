"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, lines, lm, packing, quality, simhash, spelling, suffixes, toxicity, urls
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_pages(table(spark, sf_dir, "pages"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out=crc_mod("doc_id", 10) == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn_from=crc_mod("doc_id", 5) != 0)
    done = quality.scored(docs, model)
    return done.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=crc_mod("doc_id", 4) != 2)
    done = toxicity.scored(docs, model)
    return done.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document; documents without a covered item have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_overlaps(docs, table(spark, sf_dir, "benchmark")).where(F.size("overlaps") > 0)
    best = F.array_max(F.transform("overlaps", lambda o: F.struct(o.coverage.alias("coverage"), (-o.item_id).alias("item"))))
    return found.select(
        "doc_id", F.lit(True).alias("contaminated"), (-best.item).alias("best_item_id"), best.coverage.alias("coverage"), F.transform("overlaps", lambda o: o.item_id).alias("item_ids")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_file(), window=2048, end_id=1)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, t=2)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark, urls.RULES))
    return done.select("page_id", "host", "path", "rule", "verdict")


_ESCAPED = "replace({0}, chr(92), chr(92)||'b')"
for _k, _v in chat.CONTROL.items():
    _ESCAPED = f"replace({_ESCAPED}, '{_k}', '{_v}')"

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP1_SQL = f"""
with p as (
  select page_id, lower(regexp_extract(url, '{lines.HOST}', 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(html, '{lines.INLINE_TAGS}', '', 'g'), '{lines.BLOCKS}', chr(10), 'g'),
      '[ \\t\\r\\f]*\\n[ \\t\\r\\f\\n]*', chr(10), 'g') as text
  from pages
), l as (
  select page_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from p
), seen as (
  select host, trim(line, {_SPACE}) as line, count(distinct page_id) as n from l where trim(line, {_SPACE}) <> '' group by all
), bad as (
  select host, line from seen join (select host, count(*) as total from p group by host) using (host) where n >= 2 and n > 0.1::double * total
), marked as (
  select l.page_id, l.line, l.pos, bad.line is not null as dropped from l left join bad on l.host = bad.host and trim(l.line, {_SPACE}) = bad.line
)
select page_id, p.host, coalesce(string_agg(marked.line, chr(10) order by pos) filter (where not dropped), '') as text,
  count(*) as n_lines, count(*) filter (where dropped) as n_dropped
from marked join p using (page_id) group by page_id, p.host
"""

OP9_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), t as (
  select *, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as opens,
    length({_ESCAPED.format("text")}) as escaped, length(replace({_ESCAPED.format("role")}, chr(10), chr(92)||'n')) as head
  from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(escaped + case when opens then head + {len(chat.OPEN) + 1 + len(chat.END) + 1} else {len(chat.AND)} end)::bigint as formatted_chars
from t group by conv_id
"""

#: crc32 by its definition, over the UTF-8 bytes of code points below U+0800.
OP11_SQL = """
with tab as materialized (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)
), runs as materialized (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) as run from documents
), lowered as materialized (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times from runs group by all
), hashed as materialized (
  select run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from lowered cross join tab
), words as materialized (
  select word, sum(times)::bigint as n from (
    select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed
  ) where length(word) >= 6 group by word having sum(times) >= 5
), gaps as materialized (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) u(i)
), pairs as materialized (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select w.word, g.word, g.n from gaps g join words w on g.rest = w.word
), best as materialized (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word
), forms as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n from words left join best using (word)
), chain as (
  with recursive steps as (
    select word, form as reached, 1 as step from forms where form is not null
    union all select s.word, f.form, step + 1 from steps s join forms f on f.word = s.reached where f.form is not null
  ) select word, arg_max(reached, step) as root from steps group by word
)
select f.word, f.form, coalesce(c.root, f.word) as root, f.n, f.n_near, f.form_n from forms f left join chain c using (word)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ann": op2_ann,
        "op3_language_model": op3_language_model,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_packing": op7_packing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_simhash": op10_simhash,
        "op11_spelling": op11_spelling,
        "op12_url_filter": op12_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op9_chat_formatting": OP9_SQL, "op11_spelling": OP11_SQL}
