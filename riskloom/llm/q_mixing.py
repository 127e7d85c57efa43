"""Query 6: mixing all documents, the quality label of a document (if it has one) as its weight."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.mixing import mix, word_count
from riskloom.llm.registry import query, table

#: Weights by the label: good, bad, none.
GOOD, BAD, NONE = 2.0, 0.5, 1.0


def with_weight(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a further column for the label of their id, and the weight by it."""
    name = "label_quality"
    while name in docs.columns:
        name += "_"
    one = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias(name + "id"))
           .agg(F.max("quality").alias(name)))
    rows = docs.join(one, F.col("doc_id") == F.col(name + "id"), "left").select(*docs.columns, name)
    return rows, F.when(F.col(name) == 1, GOOD).when(F.col(name) == 0, BAD).otherwise(NONE)


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    (cast(concat('0x', substr(md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))), 1, 12)) as bigint)
      + cast(0.5 as double)) / cast(281474976710656 as double) as u
  from documents),
labelled as (select doc_id as lid, max(quality) as quality from labels group by doc_id),
keyed as (
  select doc_id, source, size, -ln(u) / (case quality when 1 then cast(2.0 as double)
      when 0 then cast(0.5 as double) else cast(1.0 as double) end) as k
  from sized left join labelled on doc_id = lid),
sizes as (select source, cast(sum(size) as bigint) as source_size from keyed group by source),
weighed as (
  select source, source_size, cast(2 as double) * source_size as cap,
    cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as w
  from sizes),
levels as (
  select *, cap / w as full_at,
    (cast(1.5 as double) * (select sum(source_size) from sizes)
       - coalesce(sum(cap) over (order by cap / w, source nulls last
           rows between unbounded preceding and 1 preceding), 0))
    / ((select sum(w) from weighed)
       - coalesce(sum(w) over (order by cap / w, source nulls last
           rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed),
targets as (
  select source, source_size, least(cap, coalesce(w * (select arg_min(level, full_at) from levels
    where full_at > level), cap)) as target from levels),
budgets as (
  select *, cast(round(target) as bigint) as budget from targets),
ranked as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then budget // source_size else 0 end as epochs,
    case when source_size > 0 then budget % source_size else 0 end as rest,
    coalesce(sum(size) over (partition by b.source order by k, doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as ahead
  from keyed d join budgets b on d.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(epochs * size + greatest(0, least(size, rest - ahead)) as bigint) as taken
from ranked"""


@query(SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    rows, weight = with_weight(docs, table(spark, sf_dir, "labels"))
    return (mix(rows, F.col("words"), weight)
            .select("doc_id", "size", "source_size", "target", "taken"))
