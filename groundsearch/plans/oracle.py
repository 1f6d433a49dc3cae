"""The driver's queries in SQL for DuckDB, on the same tables."""

from __future__ import annotations

from ..operators.answering import REFUSAL, Messages
from ..operators.parsing import FIELD_KINDS
from ..operators.routing import ALIASES, CROSS_YEAR
from ..schemas import SECTION_KINDS
from .queries import BASELINE, MENTIONS, WORDS


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\pL\pN_]+'), lambda x: x <> '')"
SPLIT_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
ESTIMATE = f"greatest(floor(len({SPLIT_WORDS}) * 1.3::double), floor(length({{0}}) / 4))::bigint"
KINDS = _list(SECTION_KINDS)

CHUNKS = f"""chunks as (
  select doc_id, text, lang, source, ({KINDS})[doc_id % 7 + 1] as section, 2025 + doc_id % 3 as plan_year, lang || '-' || source as measure_id, embedding
  from documents left join embeddings on vec_id = doc_id
)"""
QUESTIONS = """questions as (
  select item_id as query_id, text as query, 2025 + item_id % 3 as plan_year, (['en', 'fr', 'de', 'es'])[item_id % 4 + 1] || '-src' || (item_id % 20) as measure_id, embedding
  from benchmark left join embeddings on vec_id = item_id
)"""
IDF = f"""toks as (select doc_id, {TOKENS.format("text")} as t from documents),
lens as (select doc_id, len(t) as n from toks),
summary as (select count(*) as docs, avg(n) as mean_length from lens),
flat as (select doc_id, unnest(t) as token from toks),
tf as (select doc_id, token, count(*) as f from flat group by all),
df as (select token, count(*) as df from tf group by token),
raw as (select token, df, ln(docs - df + 0.5::double) - ln(df + 0.5::double) as raw from df cross join summary),
floor_ as (select 0.25::double * avg(raw) as least from raw),
idf as (select token, df, case when raw < 0 then least else raw end as idf from raw cross join floor_)"""
BM25 = f"""{IDF},
asked as (select item_id as query_id, unnest({TOKENS.format("text")}) as token from benchmark),
scored as (
  select query_id, tf.doc_id, sum(idf * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * n / mean_length))) as score
  from asked join tf using (token) join idf using (token) join lens on lens.doc_id = tf.doc_id, summary group by 1, 2
)"""
#: Cosines of questions with all vectors.
COSINES = "cosines as (select query_id, q.plan_year, q.measure_id, vec_id as doc_id, label, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as score from questions q, embeddings e where q.embedding is not null)"


def _ranked(source: str, k: int, where: str = "true") -> str:
    return f"(select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from {source} where {where}) where rank <= {k})"


def _leg(name: str, source: str, filters: str, positive: bool) -> str:
    where = f"{filters}{' and round(score, 9) > 0' if positive else ''}"
    return f"{name} as (select query_id, doc_id, rank from {_ranked(source, 20, where)})"


FUSED = """{name} as (
  select query_id, doc_id, dense_rank, bm25_rank, score, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from (
    select coalesce(d.query_id, b.query_id) as query_id, coalesce(d.doc_id, b.doc_id) as doc_id, d.rank as dense_rank, b.rank as bm25_rank,
      coalesce(1.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score
    from {d} d full join {b} b on d.query_id = b.query_id and d.doc_id = b.doc_id))"""
#: Both legs' scores beside the filter columns of question and chunk.
PAIRS = f"""with {CHUNKS}, {QUESTIONS}, {BM25}, {COSINES},
lex as (select s.query_id, s.doc_id, s.score, q.plan_year = c.plan_year as in_year, q.measure_id = c.measure_id as in_measure from scored s join questions q using (query_id) join chunks c using (doc_id)),
den as (select s.query_id, s.doc_id, s.score, s.plan_year = c.plan_year as in_year, s.measure_id = c.measure_id as in_measure from cosines s join chunks c using (doc_id))"""
FALLBACK = f"""{PAIRS},
{_leg("d1", "den", "in_year and in_measure", False)}, {_leg("b1", "lex", "in_year and in_measure", True)}, none as (select * from b1 where false),
{_leg("d2", "den", "in_year", False)}, {_leg("b2", "lex", "in_year", True)},
{FUSED.format(name="hybrid_first", d="d1", b="b1")}, {FUSED.format(name="dense_first", d="d1", b="none")}, {FUSED.format(name="second", d="d2", b="b2")}"""
MERGED = """{name} as (
  select query_id, doc_id, score, used_fallback, row_number() over (partition by query_id order by turn, rank) as rank from (
    select f.*, 0 as turn, coalesce(n, 0) < 4 as used_fallback from {first} f left join (select query_id, count(*) as n from {first} group by 1) using (query_id)
    union all
    select s.*, 1, true from second s left join (select query_id, count(*) as n from {first} group by 1) c using (query_id)
    where coalesce(n, 0) < 4 and not exists (select 1 from {first} f where f.query_id = s.query_id and f.doc_id = s.doc_id)))"""
ROUTED_PAIRS = f"""with {CHUNKS}, {QUESTIONS}, {BM25}, {COSINES},
filters as (select query_id, case when query_id % 4 > 0 then plan_year end as y, case query_id % 3 when 0 then [measure_id, 'en-src' || (query_id % 7)] when 1 then [measure_id] end as ms from questions),
lex as (select s.query_id, s.doc_id, s.score, y is null or y = c.plan_year as in_year, ms is null or list_contains(ms, c.measure_id) as in_measure from scored s join filters using (query_id) join chunks c using (doc_id)),
den as (select s.query_id, s.doc_id, s.score, y is null or y = c.plan_year as in_year, ms is null or list_contains(ms, c.measure_id) as in_measure from cosines s join filters using (query_id) join chunks c using (doc_id) where s.query_id % 5 > 0)"""
#: The list without the measure filter follows only where there was one.
ROUTED_TOPK = f"""{ROUTED_PAIRS}, {_leg("d1", "den", "in_year and in_measure", False)}, {_leg("b1", "lex", "in_year and in_measure", True)}, {_leg("d2", "den", "in_year", False)}, {_leg("b2", "lex", "in_year", True)},
{FUSED.format(name="one", d="d1", b="b1")}, {FUSED.format(name="two", d="d2", b="b2")},
starved as (select query_id from filters left join one using (query_id) where ms is not null group by 1 having count(doc_id) < 4),
found as (select query_id, doc_id, score, used_fallback, row_number() over (partition by query_id order by turn, rank) as rank from (
  select one.*, 0 as turn, query_id in (from starved) as used_fallback from one
  union all select two.*, 1, true from two where query_id in (from starved) and not exists (select 1 from one where one.query_id = two.query_id and one.doc_id = two.doc_id)))"""
PARTS = _list(name.title() for name in ALIASES)
MEASURED = f"""measured as (
  select distinct 2025 + doc_id % 3 as plan_year, case when doc_id % 2 = 0 then 'C' else 'D' end || (10 + doc_id * 7 % 83) as measure_id, ({PARTS})[doc_id % {len(ALIASES)} + 1] || ' of ' || source as measure_name
  from documents where doc_id % 9 > 0)"""
NAMED = "(values " + ", ".join(f"('{f}', '{a}')" for f, names in ALIASES.items() for a in names) + ") a(fragment, alias)"
ALIAS_TABLE = f"{MEASURED}, aliases as (select distinct alias, plan_year, measure_id from measured, {NAMED} where contains(lower(measure_name), fragment))"
ROUTED = f"routed as (select item_id as query_id, text || ({_list(WORDS)})[item_id % 7 + 1] as query from benchmark)"
LITERAL = r"list_sort(list_distinct(list_transform(regexp_extract_all(query, '(?i)\b([CD]\d{2})\b', 1), lambda x: upper(x))))"
MARKERS = r"list_transform(regexp_extract_all(reply, '\[(\d+)\]', 1), lambda x: x::int)"
REPLIES = "replies as (select conv_id, turn, coalesce(text, '') || ' [' || (turn % 4) || ']' || case turn % 3 when 0 then ' B [2]. A [1].' when 1 then '' else ' [9] [0]' end as reply from conversations)"
_ITEM_SECTION = f"({KINDS})[item_id % 7 + 1]"
ITEMS = f"""items as (
  select item_id::varchar as item_id, item_id % 5 = 4 as trap, case when item_id % 5 = 4 then 'refusal_scope' else 'cat' || (item_id % 6) end as category, case when item_id % 4 = 0 then 'dev' else 'test' end as split,
    item_id % 5 = 4 and item_id % 10 = 4 as bare, case when item_id % 5 = 4 then null when item_id % 9 = 0 then ' ' else 'ref' end as reference_answer, item_id as i from benchmark
), labels_ as (
  select item_id::varchar || ':' || pos as label_id, item_id::varchar as item_id, 'src' || ((item_id + pos) % 20) as doc_id,
    case pos when 0 then 'E' when 2 then case when item_id % 6 = 0 then 'zz' else 'FR' end end as measure_name_contains, {_ITEM_SECTION} as section
  from benchmark, (values (0), (1), (2)) p(pos) where item_id % 5 <> 4
), gold_chunks as (
  select doc_id as chunk_id, source as doc_id, ({KINDS})[doc_id % 7 + 1] as section, case when lang = 'de' then null else lang end as measure_name from documents
), matches as (
  select label_id, item_id, chunk_id from labels_ l join gold_chunks c using (doc_id, section)
  where case when measure_name_contains is null then measure_name is null else coalesce(contains(lower(measure_name), lower(measure_name_contains)), false) end
), gold as (select distinct item_id, chunk_id from matches)"""
_HITS = "count(*) filter (where r.rank <= {k} and g.chunk_id is not null)"
METRICS = """{name} as (
  select i.item_id, i.category, i.split, m.metric, m.value from (
    select i.item_id, i.category, i.split, i.trap, (select count(*) from gold g where g.item_id = i.item_id) as n_gold, min(r.rank) filter (where g.chunk_id is not null) as first,
      count(*) filter (where r.rank <= 5 and g.chunk_id is not null) as h5, count(*) filter (where r.rank <= 8 and g.chunk_id is not null) as h8, any_value(gate.refused) as refused
    from items i left join (select * from {ranked} where rank <= 8) r on r.query_id = i.i left join gold g on g.item_id = i.item_id and g.chunk_id = r.doc_id left join gate on gate.query_id = i.i group by all
  ) i, lateral (values
    ('hit@1', case when not trap and n_gold > 0 then (coalesce(first, 0) = 1)::int::double end), ('mrr', case when not trap and n_gold > 0 then coalesce(1.0::double / first, 0) end),
    ('precision@8', case when not trap and n_gold > 0 then h8 / 8.0::double end), ('recall@5', case when not trap and n_gold > 0 then h5 / n_gold::double end),
    ('recall@8', case when not trap and n_gold > 0 then h8 / n_gold::double end), ('refused', case when trap then refused::int::double end)) m(metric, value)
  where m.value is not null)"""
GATE = "gate as (select q.query_id, coalesce(max(score) < 0.97, false) as refused from questions q left join cosines c using (query_id) group by 1)"
EVAL = f"""{FALLBACK}, {MERGED.format(name="found", first="hybrid_first")}, {MERGED.format(name="found_dense", first="dense_first")}, {ITEMS}, {GATE},
{METRICS.format(name="metrics", ranked="found")}, {METRICS.format(name="metrics_dense", ranked="found_dense")}"""
REPORT = """report as (
  select * from (
    select case when not grouping(category)::bool then 'category' when not grouping(split)::bool then 'split' else 'overall' end as scope, coalesce(category, split, '') as name, metric, avg(value) as value
    from metrics group by grouping sets ((metric, category), (metric, split), (metric)))
  where scope = 'category' or metric <> 'refused')"""
_LABELS = "|".join(label.replace(" ", r"\s+") for label in FIELD_KINDS)
_KIND = "case " + " ".join(f"when label = '{k}' then '{v}'" for k, v in FIELD_KINDS.items()) + " else 'general' end"
FIELDS = f"""blocks as (
  select doc_id, 'Lead of ' || source || chr(10) || '  Metric: ' || text || chr(10) || ' Data  Time Frame : ' || lang || chr(10) || 'Metric Notes: of ' || n_chars || chr(10) || 'Not a label: x' || chr(10) || source || ': NQF: no' as block from documents
), cut as (
  select doc_id, string_split(regexp_replace(block, '(?m)^[ \\t]*({_LABELS})\\s*:\\s*', '␞\\1␟', 'g'), '␞') as parts from blocks
), fields as (
  select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos from cut
), split_fields as (
  select doc_id, pos, case when pos = 0 then 'Body' else trim(regexp_replace(string_split(part, '␟')[1], '\\s+', ' ', 'g')) end as label, case when pos = 0 then part else substr(part, instr(part, '␟') + 1) end as body from fields
), kinds as (select doc_id, pos, label, {_KIND} as kind, md5(body) as digest from split_fields)"""


def _normal(text: str) -> str:
    """SQL of a block's normalised text."""
    lines = rf"list_filter(list_transform(string_split_regex({text}, '\r\n|[\n\r\x0B\f]'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '')"
    flat = f"array_to_string(list_transform({lines}, lambda x: case when starts_with(x, '•') or starts_with(x, '-') or starts_with(x, '–') then chr(10) else ' ' end || x), '')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({flat}, '[ \t]{{2,}}', ' ', 'g'), '•\s+', '• ', 'g'), '([A-Za-z0-9]) ?- ?([A-Za-z0-9])', '\1-\2', 'g'), '^\s+|\s+$', '', 'g')"


_MARK = "chr(1)"
#: Units are sentences, bullets and word windows; a window is the units lo .. hi, of which those from `fresh` on are new. Token counts run on.
CHUNKED = f"""with recursive docs as (select doc_id, text, {ESTIMATE.format("text")} as tokens from documents),
cut as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.;])\\s+', '\\1' || {_MARK}, 'g'), '\\n([•-])', {_MARK} || '\\1', 'g'), {_MARK}),
  lambda u: regexp_replace(u, '^\\s+|\\s+$', '', 'g')), lambda u: u <> '') as parts from docs where tokens > 480),
words as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as place from cut),
split as (select doc_id, place, part, {SPLIT_WORDS.format("part")} as w from words),
pieces as (select doc_id, place, 0 as turn, part as unit from split where len(w) <= 369
  union all select doc_id, place, turn, array_to_string(w[turn + 1 : turn + 369], ' ') from (select *, unnest(range(0, len(w), 320)) as turn from split where len(w) > 369)),
sized as (select *, {ESTIMATE.format("unit")} as t from pieces),
units as (select doc_id, list(unit order by place, turn) as u, list(total order by place, turn) as p from (select *, sum(t) over (partition by doc_id order by place, turn)::bigint as total from sized) group by 1),
walk as (
  select doc_id, 0 as n, 1::bigint as lo, greatest(1, len(list_filter(p, lambda x: x <= 480)))::bigint as hi from units
  union all
  select doc_id, n + 1, lo, greatest(fresh, len(list_filter(p, lambda x: x <= before + 480)))::bigint from (
    select doc_id, n, p, lo, fresh, coalesce(p[lo - 1], 0) as before from (
      select doc_id, n, p, hi + 1 as fresh, greatest(walk.lo, 1 + len(list_filter(p, lambda x: x < p[hi] - 64)) + (p[hi] > 64)::bigint) as lo from walk join units using (doc_id) where hi < len(p)))),
windows as (select doc_id, n, array_to_string(u[lo : hi], ' ') as w from walk join units using (doc_id)),
bounds as (select *, {ESTIMATE.format("w")} <= 480 as fits from windows),
short as (select doc_id, n, 0 as c, w as piece from bounds where fits
  union all select doc_id, n, c, regexp_replace(substr(w, c + 1, 1920), '^\\s+|\\s+$', '', 'g') from (select *, unnest(range(0, length(w), 1920)) as c from bounds where not fits)
  union all select doc_id, 0, 0, text from docs where tokens <= 480),
chunked as (select doc_id, row_number() over (partition by doc_id order by n, c) - 1 as pos, piece from short where piece <> '' or (n, c) = (0, 0))"""
_M = Messages()
_KNOWN = "(select list(distinct plan_year) from chunks)"
_DEFAULT = "(select max(plan_year) from (select plan_year, count(*) as n from chunks group by 1) where n >= 0.05::double * (select count(*) from chunks))"

SQL = {
    "tokenize_stats": f"select doc_id, len({TOKENS.format('text')}) as n_tokens, len(list_distinct({TOKENS.format('text')})) as n_distinct from documents",
    "bm25_df_idf": f"""with seen as materialized (select distinct doc_id, unnest({TOKENS.format("text")}) as token from documents),
df as materialized (select token, count(*) as df from seen group by token),
raw as materialized (select token, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from df cross join (select count(*) as n from documents)),
least_ as materialized (select 0.25::double * avg(raw) as least from raw)
select token, df, round(round(case when raw < 0 then least else raw end, 10), 6) as idf from raw cross join least_""",
    "bm25_topk": f"with {BM25} select query_id, doc_id, rank, round(round(score, 10), 6) as score from {_ranked('scored', 8, 'round(score, 9) > 0')}",
    "bm25_topk_filtered": f"with {CHUNKS}, {BM25} select query_id, doc_id, rank, round(round(score, 10), 6) as score from {_ranked('(select s.* from scored s join chunks c using (doc_id) where lang = ' + chr(39) + 'en' + chr(39) + ' and plan_year = 2026)', 8, 'round(score, 9) > 0')}",
    "dense_topk": f"with {QUESTIONS}, {COSINES} select query_id, doc_id, rank, round(round(score, 10), 6) as score from {_ranked('cosines', 8)}",
    "dense_topk_filtered": f"with {QUESTIONS}, {COSINES} select query_id, doc_id, rank, round(round(score, 10), 6) as score from {_ranked('cosines', 8, 'label = query_id % 10')}",
    "best_similarity_gate": f"with {CHUNKS}, {QUESTIONS}, {COSINES} select q.query_id, round(round(max(score), 10), 6) as best_similarity, coalesce(max(score) < 0.97, false) as refused from questions q left join (select cosines.* from cosines join chunks using (doc_id)) c using (query_id) group by 1",
    "rrf_fuse": f"{PAIRS}, {_leg('d', 'den', 'true', False)}, {_leg('b', 'lex', 'true', True)}, {FUSED.format(name='f', d='d', b='b')} select query_id, doc_id, dense_rank, bm25_rank, round(round(score, 10), 6) as score, rank from f",
    "hybrid_topk": f"{PAIRS}, {_leg('d', 'den', 'in_year', False)}, {_leg('b', 'lex', 'in_year', True)}, {FUSED.format(name='f', d='d', b='b')} select query_id, doc_id, rank, round(round(score, 10), 6) as score, dense_rank, bm25_rank, section, source from f join chunks using (doc_id) where rank <= 8",
    "hybrid_fallback": f"{FALLBACK}, {MERGED.format(name='found', first='hybrid_first')} select query_id, doc_id, rank, round(round(score, 10), 6) as score, used_fallback from found where rank <= 8",
    "dense_only_arm": f"{FALLBACK}, {MERGED.format(name='found', first='dense_first')} select query_id, doc_id, rank, round(round(score, 10), 6) as score, used_fallback from found where rank <= 8",
    "routed_topk": f"{ROUTED_TOPK} select query_id, doc_id, rank, round(round(score, 10), 6) as score, used_fallback from found where rank <= 8",
    "default_year": f"with {CHUNKS} select {_DEFAULT} as default_year",
    "year_inference": f"""with {CHUNKS}, said as (select item_id as query_id, text || ({_list(MENTIONS)})[item_id % 6 + 1] as query from benchmark),
      indexed as (select {_KNOWN} as indexed, {_DEFAULT} as latest),
      known as (select *, list_intersect(list_transform(regexp_extract_all(query, '\\b(20\\d{{2}})\\b', 1), lambda y: y::bigint), indexed) as years from said, indexed)
      select query_id, case when len(years) = 1 then years[1] when len(years) > 1 or regexp_matches(query, '{CROSS_YEAR}') then null else latest end::bigint as plan_year from known""",
    "alias_table": f"with {ALIAS_TABLE} select alias, plan_year::bigint as plan_year, string_agg(measure_id, ',' order by measure_id) as measure_ids from aliases group by all",
    "alias_route": f"""with {ALIAS_TABLE}, {ROUTED}, hits as (
      select distinct query_id, measure_id from routed, aliases where case when contains(alias, ' ') then contains(lower(query), alias) else list_contains({TOKENS.format("query")}, alias) end
      union select query_id, unnest({LITERAL}) from routed)
      select query_id, coalesce(string_agg(measure_id, ',' order by measure_id), '') as measure_ids from routed left join hits using (query_id) group by 1""",
    "literal_id_route": f"with {ROUTED} select query_id, array_to_string({LITERAL}, ',') as measure_ids from routed",
    "token_estimate": f"select doc_id, {ESTIMATE.format('text')} as tokens from documents",
    "word_windows": f"""with w as (select doc_id, {SPLIT_WORDS.format("text")} as w from documents), s as (select doc_id, w, unnest(range(0, len(w), 320)) as a from w)
      select doc_id, (a / 320)::bigint as pos, length(array_to_string(w[a + 1 : a + 369], ' ')) as n_chars, md5(array_to_string(w[a + 1 : a + 369], ' ')) as digest from s""",
    "chunk_greedy": f"{CHUNKED} select doc_id, pos, length(piece) as n_chars, {ESTIMATE.format('piece')} as tokens, md5(piece) as digest from chunked",
    "chunk_ids": f"""with {CHUNKS}, c as (select *, case when lang = 'en' then null else lang end as m from chunks)
      select doc_id, source || ':' || coalesce(m, 'doc') || ':' || section || ':' || substr(sha256(source || '|' || coalesce(m, 'None') || '|' || section || '|' || text), 1, 16) as chunk_id from c""",
    "chunk_dedup": f"""with {CHUNKS}, c as (select *, case when lang = 'en' then null else lang end as m from chunks)
      select source || ':' || coalesce(m, 'doc') || ':' || section || ':' || substr(sha256(source || '|' || coalesce(m, 'None') || '|' || section || '|' || text), 1, 16) as chunk_id, min(doc_id) as doc_id from c group by 1""",
    "chunk_headers": f"with {CHUNKS} select doc_id, '[' || source || ' | ' || case when lang = 'en' then 'General' else lang || ' ' || measure_id end || ' | ' || upper(section[1]) || section[2:] || ' | ' || plan_year || ']' as header from chunks",
    "normalize_block": f"""with raw as (select doc_id, 'Patient - level  ' || replace(text, '. ', '.' || chr(10) || '  • ') || chr(10) || chr(10) || ' - 2025- 2026' as t from documents), done as (select doc_id, {_normal("t")} as f from raw)
      select doc_id, length(f) as n_chars, md5(f) as digest from done""",
    "measure_index": f"with {MEASURED} select measure_name, string_agg(measure_id, ',' order by measure_id) as measure_ids from (select distinct measure_name, measure_id from measured) group by 1",
    "augmented_query": f"""with {MEASURED}, chosen as (select item_id as query_id, unnest([({PARTS})[item_id % {len(ALIASES)} + 1] || ' of src' || (item_id % 20), ({PARTS})[(item_id + 23) % {len(ALIASES)} + 1] || ' of src' || ((item_id + 23) % 20)]) as measure_name from benchmark where item_id % 4 > 0),
      ids as (select query_id, string_agg(measure_id, ' ' order by measure_id) as ids from (select distinct query_id, measure_id from chosen join measured using (measure_name)) group by 1)
      select item_id as query_id, text || coalesce(' ' || ids, '') as query from benchmark left join ids on query_id = item_id""",
    "nested_documents": f"""with d as (select doc_id, source, lang, regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g') as t, 'C' || (10 + doc_id % 80) as c, 'D' || (10 + doc_id % 70) as d, 2025 + doc_id % 3 as y, doc_id % 4 = 3 as plain from documents),
      flat as (
        select doc_id, 0 as m_pos, 0 as p, c as measure_id, 'Name of ' || source as measure_name, 'description' as kind, 'Metric' as heading, 2 as page, t as body from d where not plain
        union all select doc_id, 0, 1, c, 'Name of ' || source, 'exclusions', 'Exclusions', 2, 'none of ' || lang from d where not plain
        union all select doc_id, 1, 0, d, 'Part of ' || lang, 'timeline', 'Data Time Frame', 3, y::varchar from d where not plain
        union all select doc_id, null, 0, null, null, 'general', 'Introduction', 1, 'Notes of ' || source from d where not plain
        union all select doc_id, null, 1, null, null, 'general', 'Page 1', 1, 'Notes of ' || source || chr(10) || 'Measure: C01 - Listed ..... 9' from d where plain
        union all select doc_id, null, 2, null, null, 'general', 'Page 2', 2, 'Measure: ' || c || ' - Name of ' || source || chr(10) || 'Metric: ' || t || chr(10) || 'Exclusions: none of ' || lang from d where plain
        union all select doc_id, null, 3, null, null, 'general', 'Page 3', 3, 'Measure: ' || d || ': Part  of ' || lang || chr(10) || '  Data  Time Frame : ' || y from d where plain),
      done as (select *, {_normal("body")} as f from flat)
      select doc_id, m_pos::bigint as m_pos, row_number() over (partition by doc_id, m_pos order by p) - 1 as s_pos, measure_id, measure_name, kind, heading, page::bigint as page, md5(f) as digest from done where f <> ''""",
    "field_split": f"with {FIELDS} select doc_id, pos, label, kind, digest from kinds",
    "section_kinds": f"with {FIELDS} select kind, label, count(*) as n from kinds group by all",
    "segment_bounds": "select conv_id, turn as start, lead(turn) over (partition by conv_id order by turn) as stop from conversations where role = 'user'",
    "page_asof": "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as page from conversations",
    "segment_rows": """with heads as (select conv_id, turn as start from conversations where role = 'user')
      select h.conv_id, start + 3 as until, count(*) as turns, sum(length(text))::bigint as n_chars from conversations c asof join heads h on c.conv_id = h.conv_id and c.turn >= h.start
      where turn < start + 3 group by all""",
    "index_differences": """with one as (select distinct source || ':doc:general:' || substr(sha256(source || '|None|general|' || text), 1, 16) as id from documents where text is not null),
      two as (
        select id, min(doc_id), arg_min(lang, doc_id) as lang from (
          select source || ':doc:general:' || substr(sha256(source || '|None|general|' || t), 1, 16) as id, doc_id, lang from (select *, case when lang = 'fr' then text || ' (2026)' else text end as t from documents where source <> 'src3' and text is not null)
          union all select 'benchmark:doc:general:' || substr(sha256('benchmark|None|general|' || text), 1, 16), item_id, 'en' from benchmark) group by id)
      select split_part(coalesce(one.id, two.id), ':', 1) as source, case when one.id is null then 'added' when two.id is null then 'removed' when lang = 'de' then 'changed' else 'kept' end as status, count(*) as n
      from one full join two on one.id = two.id group by all""",
    "citations": f"""with {REPLIES}, m as (select conv_id, turn, {MARKERS} as m from replies),
      n as (select *, list_sort(list_distinct(list_filter(m, lambda x: x < 1 or x > 3))) as bad, list_filter(m, lambda x: x between 1 and 3) as good from m)
      select conv_id, turn, array_to_string(m, ',') as markers, len(m) > 0 and len(bad) = 0 as valid, array_to_string(bad, ',') as invalid,
        array_to_string(list_filter(good, lambda x, i: list_position(good, x) = i), ',') as cited,
        '{_M.correction.split("{problem}")[0]}' || case when len(bad) > 0 then 'it cited nonexistent passage(s) ' || array_to_string(list_transform(bad, lambda x: '[' || x || ']'), ', ') else 'it contained no citation markers at all' end
          || '{_M.correction.split("{problem}")[1].split("{n}")[0]}3{_M.correction.split("{n}")[1]}' as hint from n""",
    "citation_cards": f"""with {BM25}, r as (select * from {_ranked('scored', 8, 'round(score, 9) > 0')}), n as (select query_id, count(*) as n from r group by 1),
      m as (select query_id, n, [query_id % 8 + 1, 2, 1, 12] as m from n), g as (select query_id, list_filter(m, lambda x: x between 1 and n) as g from m),
      u as (select query_id, list_filter(g, lambda x, i: list_position(g, x) = i) as u from g), x as (select query_id, unnest(u) as marker, generate_subscripts(u, 1) - 1 as place from u)
      select x.query_id, place, marker, doc_id from x join r on r.query_id = x.query_id and r.rank = marker""",
    "snippets": f"""with s as (select doc_id, quality, case when quality = 1 or len({SPLIT_WORDS.format("text")}) <= 40 then text else array_to_string(({SPLIT_WORDS.format("text")})[1:40], ' ') || ' …' end as s from documents join labels using (doc_id))
      select doc_id, quality::bigint as quality, length(s) as n_chars, md5(s) as digest from s""",
    "context_blocks": f"""with {CHUNKS}, {BM25}, r as (select * from {_ranked('scored', 8, 'round(score, 9) > 0')})
      select query_id, md5(string_agg('[' || rank || '] ' || doc_id || ' | ' || source || ' | ' || case when section = 'general' then 'General' else section end || ' | ' || plan_year || ' | s3://' || source || chr(10) || text, chr(10) || chr(10) order by rank)) as digest
      from r join chunks using (doc_id) group by 1""",
    "answer_state_machine": f"""with {REPLIES}, a as (
        select conv_id, turn, conv_id % 5 as n, case turn % 11 when 3 then 0.2 when 4 then null else 0.7 end as sim, conv_id % 4 <> 0 as model,
          case when turn % 7 = 5 then 'No. {REFUSAL}' else reply end as first, case conv_id % 3 when 0 then 'Now cited [1].' when 1 then '{REFUSAL}' else 'again nothing' end as second from replies),
      v as (select *, {MARKERS.replace("reply", "first")} as m1, {MARKERS.replace("reply", "second")} as m2 from a),
      o as (select *, len(m1) > 0 and len(list_filter(m1, lambda x: x < 1 or x > n)) = 0 as ok1, len(m2) > 0 and len(list_filter(m2, lambda x: x < 1 or x > n)) = 0 as ok2 from v),
      k as (select *, case when n = 0 or coalesce(sim < 0.35, false) then 'refused_low_confidence' when not model then 'retrieval_only' when contains(first, '{REFUSAL}') then 'refused_by_model' when ok1 then 'answered'
          when contains(second, '{REFUSAL}') then 'refused_by_model' when ok2 then 'answered' else 'refused_citation_invalid' end as kind from o)
      select conv_id, turn, kind, md5(case kind when 'answered' then case when ok1 then first else second end when 'refused_by_model' then '{REFUSAL}' when 'refused_low_confidence' then '{_M.low_confidence}'
          when 'refused_citation_invalid' then '{_M.citation_invalid}' else '{_M.retrieval_only}' end || chr(10) || chr(10) || '{_M.disclaimer}') as digest from k""",
    "gold_resolution": f"with {ITEMS} select item_id, chunk_id from gold",
    "unresolved_labels": f"with {ITEMS} select label_id, item_id, doc_id, measure_name_contains, section from labels_ where label_id not in (select label_id from matches)",
    "dataset_validation": f"""with {ITEMS} select item_id, 'refusal item must carry no gold labels' as problem from items where trap and not bare
      union all select item_id, 'answerable item needs a reference_answer' from items where not trap and trim(coalesce(reference_answer, '')) = ''""",
    "dataset_summary": f"""with {ITEMS}, n as (select i.*, (select count(*) from gold g where g.item_id = i.item_id) as n from items i)
      select split, category, count(*) as items, min(n) as least_gold, max(n) as most_gold, sum(n)::bigint as total_gold from n group by all""",
    "eval_per_item": f"{EVAL} select item_id, category, split, metric, round(round(value, 10), 6) as value from metrics",
    "eval_grouping_sets": f"{EVAL}, {REPORT} select scope, name, metric, round(round(value, 10), 6) as value from report",
    "refusal_accuracy": f"{EVAL} select round(round(avg(value), 10), 6) as refusal_trap_accuracy from metrics where metric = 'refused'",
    "ratchet_gate": f"""{EVAL}, {REPORT}, baseline as (select * from (values {", ".join(f"('{k}', {v}::double)" for k, v in BASELINE.items())}) b(metric, baseline) where metric in ('recall@8', 'mrr'))
      select metric, baseline, round(round(value, 10), 6) as value, value is null or value < baseline - 0.02::double - 1e-12::double as regressed from baseline left join (select metric, value from report where scope = 'split' and name = 'test') using (metric)""",
    "hybrid_dense_delta": f"""{EVAL}, h as (select metric, avg(value) as hybrid from metrics where metric <> 'refused' group by 1), d as (select metric, avg(value) as dense from metrics_dense where metric <> 'refused' group by 1)
      select metric, round(round(hybrid, 10), 6) as hybrid, round(round(dense, 10), 6) as dense, round(round(hybrid - dense, 10), 6) + 0.0 as delta from h full join d using (metric)""",
    "judge_verdicts": """with v as (select conv_id, turn, conv_id % 4 <> 3 as ok, turn % 3 as t, case when turn % 2 = 0 then 1 when turn % 5 = 0 then 0 end as flag from conversations)
      select conv_id, turn, case when ok then 2::bigint end as claims_total, case when ok then 1 + (t = 0)::bigint end as claims_supported, case when ok then (t = 1)::bigint end as claims_unsupported, case when ok then (t = 2)::bigint end as claims_contradicted,
        case when ok then case when flag is null then 1.0::double else (1 + flag) / 2.0::double end end as citation_valid_ratio, case when ok then (1 + (t = 0)::int) / 2.0::double end as faithfulness from v""",
    "integrity_sha256": "select page_id, sha256(html) as sha256 from pages",
    "license_gate": """with p as (select (['us_gov_public_domain', 'redistributable', 'public_web_cite_only', 'fetch_at_build_only'])[doc_id % 4 + 1] as license_posture, source from documents)
      select license_posture, license_posture in ('us_gov_public_domain', 'redistributable') as committable, count(*) as n, count(distinct source) as sources from p group by 1""",
}
