"""Query 12: interaction of five filters over all documents."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.filter_audit import LEAST_DISTINCT, LEAST_WORDS, MOST_CAPITALS, NAMES, audit
from riskloom.llm.registry import query, table

_STEPS = range(1, len(NAMES) + 1)

SQL = rf"""
with words_ as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
masks as (
  select doc_id, part, cast(len(words) < {LEAST_WORDS} as int)
    + 2 * cast(100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) as int)
    + 4 * cast(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(body) as int)
    + 8 * cast(regexp_matches(body, '[#$%&*|]') as int)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by body), false) as int) as mask
  from words_),
known as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic
  from labels group by doc_id),
counts as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from masks left join known using (doc_id) group by part, mask),
letters as (select * from (values {', '.join(f"('{c}', {1 << i})" for i, c in enumerate(NAMES))}) t(letter, bit)),
orders as (
  select {' || '.join(f'l{i}.letter' for i in _STEPS)} as filter_order, [{', '.join(f'l{i}.bit' for i in _STEPS)}] as bits
  from {' cross join '.join(f'letters l{i}' for i in _STEPS)}
  where {' + '.join(f'l{i}.bit' for i in _STEPS)} = {(1 << len(NAMES)) - 1} and len(list_distinct(bits)) = {len(NAMES)}),
steps as (
  select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[:step - 1]), 0) as int) as before
  from orders cross join (select unnest(range(1, {len(NAMES) + 1})) as step)),
figures as (
  select part, filter_order, step, bit,
    sum(case when mask & (before + bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from counts cross join steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from figures"""


@query(SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
