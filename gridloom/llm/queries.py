"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import align, bpe, lattice, licenses, maxent, mil, mixing, quality, search, shards, simhash, urlfilter, wordbpe
from gridloom.llm.common import LOWER, UPPER, table

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.rejected_by("base").alias("base_failed"), "kept", "failures")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.round_trip(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_license_scan": op2_license_scan,
        "op3_lm_score": op3_lm_score,
        "op4_training_order": op4_training_order,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_url_filter": op6_url_filter,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_mix_sources": op10_mix_sources,
        "op11_word_bpe": op11_word_bpe,
        "op12_ranked_search": op12_ranked_search,
        "op13_token_alignment": op13_token_alignment,
    }


def _op2_sql() -> str:
    breaks = licenses.BREAKS
    phrases = "\n  union all ".join(
        f"select k, i - 1 as pos, '{label}' as label from words, unnest(range(1, len(w) + 1)) u(i) where "
        + " and ".join(f"w[i + {j}] = '{part}'" for j, part in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES
    )
    listed = ", ".join(f"({i}, '{label}', {pairs!r}, {need}, {block})" for i, label, pairs, need, block in licenses.template_sets(licenses.TEMPLATES))
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
with docs as (select row_number() over () as k, doc_id, {lower} as t from documents),
words as (select k, doc_id, list_filter(string_split_regex(t, '{breaks}'), lambda x: x <> '') as w from docs),
places as ({phrases}),
base as (select k, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as ls from places group by k),
templates(id, label, ps, need, block) as (values {listed}),
tp as (select id, label, need, block, len(ps) as n, unnest(ps) as pair from templates),
tw as (select distinct pair from tp),
pairs as (select k, i - 1 as pos, w[i] || ' ' || w[i + 1] as pair from words, unnest(range(1, len(w))) u(i)),
near as (select * from pairs semi join tw using (pair)),
hits as (select k, id, label, need, block, n, pos, pair from near join tp using (pair)),
firsts as (
  select a.k, a.id, a.pos, b.pair, min(b.pos) as f, max(b.pos) as l, any_value(a.pair) as head, any_value(a.label) as label, any_value(a.need) as need, any_value(a.n) as n
  from hits a join hits b on a.k = b.k and a.id = b.id and b.pos between a.pos and a.pos + a.block - 2 group by a.k, a.id, a.pos, b.pair),
windows as (
  select k, id, pos, any_value(label) as label, any_value(n) as n, count(*) as overlap, max(f) + 2 as stop, any_value(head) as head
  from firsts group by k, id, pos having count(*) >= any_value(need)),
blocks as (
  select *, overlap / n::double as c from windows w
  where not exists (select 1 from hits h where h.k = w.k and h.id = w.id and h.pair = w.head and h.pos > w.pos and h.pos <= w.stop - 2)),
maximal as (
  select * from blocks a where not exists (select 1 from blocks b where b.k = a.k and b.id = a.id and b.overlap > a.overlap and b.pos < a.stop and a.pos < b.stop)),
stay as (select * from maximal a where not exists (select 1 from maximal b where b.k = a.k and b.c > a.c and b.pos < a.stop and a.pos < b.stop)),
found as (select k, list(distinct label) as ls, max(c) as c from stay group by k)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(f.c, 0.0::double) end as score
from words w left join base b using (k) left join found f using (k)
"""


def _op6_sql() -> str:
    listed = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urlfilter.RULES)
    return f"""
with rules(action, rh, rp) as (values {listed}),
u as (select row_number() over () as k, page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) as x from pages),
p as (select k, page_id, coalesce(translate(x.h, '{UPPER}', '{LOWER}'), '') as host, coalesce(x.p, '') as path from u),
f as (
  select k, rh || rp as rule, action, row_number() over (partition by k order by length(rh || rp) desc, length(rh) desc) as n
  from p, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(action, case when host = '' then '{urlfilter.UNREACHABLE}' else '{urlfilter.OTHERWISE}' end) as verdict
from p left join (select * from f where n = 1) using (k)
"""


def _op8_sql() -> str:
    bits = " | ".join(f"(case when {sql} then {1 << quality.BIT[name]} else 0 end)" for name, sql in quality.RULES)
    return f"""
with w as (
  select doc_id, coalesce(text, '') as t, {WORDS_SQL} as w from documents),
x as (
  select doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls,
    list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) as g from w),
y as (
  select *, list_filter(list_transform(map_entries(histogram), lambda e: case when e.value > 1 then e.key end), lambda k: k is not null) as twice
  from (select *, list_histogram(g) as histogram from x)),
m as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, length(t) - length(replace(t, '!', '')) as n_bangs,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) as n_long_runs,
    len(list_filter(range(1, len(w) + 1), lambda i: coalesce(list_contains(twice, g[i]), false) or (i > 1 and coalesce(list_contains(twice, g[i - 1]), false)) or (i > 2 and coalesce(list_contains(twice, g[i - 2]), false)))) as n_repeat_words
  from y),
f as (select *, ({bits})::bigint as failures from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (failures & {quality.POLICIES["base"]}) <> 0 as base_failed, (failures & {quality.POLICIES["v1"]}) = 0 as kept, failures
from f
"""


def _op10_sql() -> str:
    picks = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
with s as (select row_number() over () as k, doc_id, source, md5(coalesce(text, '')) as digest, len({WORDS_SQL})::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size, source_size / (count(*) filter (size > 0))::double as mean, row_number() over (order by source nulls last) - 1 as place from s group by source),
c as (select *, [{picks}][(place % {len(mixing.WEIGHTS)} + 1)::int] as weight, source_size * {mixing.MAX_COPIES} as cap from t),
l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as level,
    cap::double / weight::double as ratio
  from c window o as (order by cap::double / weight::double, place rows between unbounded preceding and 1 preceding)),
a as (select arg_min(level, (ratio, place)) as lv from l where level * weight <= cap),
g as (select source, source_size, mean, coalesce(least(cap::double, lv * weight), cap::double) as target from l left join a on true),
d as (
  select k, s.doc_id, s.source, size, source_size, mean, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    (('0x' || substr(md5('17-' || coalesce(s.doc_id::varchar, 'null') || '-' || digest), 1, 13))::bigint::double + 0.5) / {2**52}::double as u
  from s join g on s.source is not distinct from g.source),
p as (select *, floor(rate)::bigint as whole, rate - floor(rate) as p, target - floor(rate) * source_size as rest from d),
r as (select *, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p) * (2 * mean / (mean + size))) end as rank from p),
o as (select *, coalesce(sum(size) over (partition by source order by rank, doc_id, k rows between unbounded preceding and 1 preceding), 0) as before from r where rank is not null and size > 0),
x as (select k from o where before + size / 2.0::double <= rest)
select doc_id, size, source_size, target, (case when size > 0 then whole + (case when x.k is null then 0 else 1 end) else 0 end)::bigint as copies,
  (case when size > 0 then whole + (case when x.k is null then 0 else 1 end) else 0 end * size)::bigint as taken
from r left join x using (k)
"""


def _op12_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as k, doc_id, {terms} as w from documents),
n as (select k, doc_id, len(w)::bigint as n from d where len(w) > 0),
s as (select count(*)::bigint as nn, sum(n)::bigint as l from n),
tf as (select k, term, count(*)::bigint as tf from (select k, unnest(w) as term from d) group by k, term),
df as (select term, count(*)::bigint as df from tf group by term),
q as (select distinct item_id, unnest({terms}) as term from benchmark),
w as (select item_id, term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from q join df using (term), s),
p as (
  select item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))))::bigint as score
  from w join tf using (term) join n using (k), s group by item_id, k, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from p where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= {search.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": _op2_sql(),
        "op6_url_filter": _op6_sql(),
        "op8_quality_rules": _op8_sql(),
        "op10_mix_sources": _op10_sql(),
        "op12_ranked_search": _op12_sql(),
    }
