"""Query 5: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.registry import query, table
from riskloom.llm.secrets import RULES, scan


def _kind_sql(no: int, rule) -> str:
    """Spans of one rule: running lengths of what lies between the matches and of the matches."""
    regex = rule.regex.replace("'", "''")
    group = f"regexp_extract_all(body, '{regex}', {rule.group})" if rule.group else "hits"
    return f"""
    select row, {no} as kind_no, '{rule.kind}' as kind, gap_end - len as start_at, gap_end as end_at from (
      select row, len, size, n, sum(gap + len) over (partition by row order by n) as gap_end from (
        select row, unnest(range(len(hits))) as n,
          unnest(list_transform(hits, lambda x: length(x))) as len,
          unnest(list_transform(sizes, lambda x: length(x))) as size,
          unnest(list_transform(gaps[:len(hits)], lambda x: length(x))) as gap
        from (select row, hits, {group} as sizes, string_split_regex(body, '{regex}') as gaps
          from (select row, body, regexp_extract_all(body, '{regex}') as hits from rows_)
          where len(hits) > 0)))
    where size >= {rule.least}"""


SQL = f"""
with rows_ as (select row_number() over () as row, doc_id, coalesce(text, '') as body from documents),
spans as ({' union all '.join(_kind_sql(k, r) for k, r in enumerate(RULES))}),
named as (select row, kind_no, kind, start_at, concat(kind, ':', cast(start_at as bigint), ':',
    cast(end_at as bigint)) as span from spans),
by_row as (
  select row, count(*) filter (where kind = 'assign') as n_assign,
    count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(span, ',' order by start_at, kind_no) filter (where kind_no < 3) as base,
    string_agg(span, ',' order by start_at, kind_no) as spans
  from named group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from rows_ left join by_row using (row)"""


@query(SQL)
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
