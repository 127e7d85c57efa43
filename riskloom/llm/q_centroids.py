"""Query 11: clusters of all embeddings around sixteen whole-number centroids."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.centroids import CENTROIDS, ROUNDS, SCALE, SEED, WIDTH, clusters
from riskloom.llm.registry import query, table


def _round_sql(no: int) -> str:
    """Assignment to the centroids of a round, and the centroids of the next one."""
    return f"""
a{no} as (
  select row, vec_id, v, min_by(k, (d, k)) as k, min(d) as d from (
    select row, vec_id, kept.v, k, list_sum(list_transform(range(1, {WIDTH + 1}),
        lambda i: cast(kept.v[i] - c.v[i] as hugeint) * (kept.v[i] - c.v[i]))) as d
    from kept cross join c{no} c)
  group by row, vec_id, v),
m{no} as (
  select k, list((s - ((s % n + n) % n)) // n order by i) as v from (
    select k, i, sum(v[i]) as s, count(*) as n
    from a{no} cross join (select unnest(range(1, {WIDTH + 1})) as i) group by k, i)
  group by k),
c{no + 1} as (select c.k, coalesce(m.v, c.v) as v from c{no} c left join m{no} m on c.k = m.k),"""


SQL = f"""
with kept as (
  select row_number() over () as row, vec_id, embedding,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: isfinite(cast(x as double)))) = {WIDTH}),
c0 as (
  select row_number() over (order by sha256('{SEED}:' || cast(vec_id as varchar)) nulls last, embedding) - 1 as k, v from kept
  qualify k < {CENTROIDS}),
{''.join(_round_sql(r) for r in range(ROUNDS + 1))}
named as (select k, sha256(array_to_string(v, ',')) as centroid_sha256 from c{ROUNDS})
select vec_id, cast(a.k as int) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a{ROUNDS} a join named on a.k = named.k"""


@query(SQL)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
