"""Names of two tables against each other: headers of uploaded files and names of parts."""

from pyspark.sql import functions as F

from riskloom.operators import catalogues
from riskloom.sources import adapter
from suite.base import query, sql_grams, sql_normalise, sql_similarity, view

view("part_names", f"""select distinct p_name || ' ' || p_brand as name,
    {sql_normalise("p_name || ' ' || p_brand")} as pnorm from part""")
view("part_grams", f"select *, {sql_grams('pnorm')} as pg from part_names", "part_names")
view("norm_grams", "select distinct norm, g from grams", "grams")
view("part_scores", f"""
  select norm, name as wanted, pnorm, {sql_similarity('norm', 'pnorm', 'g', 'pg', 2)} as score
  from norm_grams cross join part_grams""", "norm_grams part_grams")


def part_names(spark, sf_dir):
    return adapter.table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_brand").alias("name"))


@query("select norm as a, pnorm as b, score from part_scores where score >= cast(0.6 as double)"
       " group by norm, pnorm, score", "part_scores")
def catalogue_similarity(spark, sf_dir):
    left = catalogues.distinct_norms(adapter.header_names(spark, sf_dir))
    return catalogues.similar_norms(left, catalogues.distinct_norms(part_names(spark, sf_dir)))


@query("""
  select file_id, wanted, name, score, case prio when 1 then 'exacta' else 'similar' end as method from (
    select file_id, wanted, h.name, score, prio, row_number() over (
      partition by file_id, wanted order by prio, score desc, pos, h.name) as k
    from (select headers.*, norm from headers join norms using (name)) h
      join (select *, 3 as prio from part_scores where score >= cast(0.6 as double)) s using (norm))
  where k = 1""", "norms part_scores")
def catalogue_match(spark, sf_dir):
    return catalogues.match_catalogues(adapter.header_names(spark, sf_dir), part_names(spark, sf_dir))
