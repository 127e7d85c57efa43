"""Schema matching over the header names of many files."""

from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions.text import human_label as human
from riskloom.functions.text import normalise, similarity
from riskloom.operators import matching
from riskloom.sources import adapter
from suite.base import (dates_as_text, query, sql_normalise, sql_similarity)


@query(f"select file_id, pos, {sql_normalise('name')} as norm from headers", "headers")
def normalise_names(spark, sf_dir):
    return adapter.header_names(spark, sf_dir).select(
        "file_id", "pos", normalise(F.col("name")).alias("norm"))


@query(f"select distinct norm, required, {sql_similarity('rn', 'norm', 'rg', 'g', 0)} as score"
       " from grams cross join wanted", "grams wanted")
def name_similarity(spark, sf_dir):
    names = adapter.header_names(spark, sf_dir).select(
        normalise(F.col("name")).alias("norm")).distinct()
    wanted = F.explode(F.array(*[F.lit(r) for r in schema.REQUIRED])).alias("required")
    return names.select("norm", wanted).select(
        "norm", "required", similarity(F.lower("required"), F.col("norm")).alias("score"))


@query(f"""select file_id, pos, s.required from headers h join norms n on h.name = n.name
    join spelled s on s.syn = n.norm""", "headers norms spelled")
def synonym_hits(spark, sf_dir):
    return matching.synonym_hits(adapter.header_names(spark, sf_dir)).select(
        "file_id", "pos", "required")


@query("""select file_id, required, name, score, case prio when 1 then 'exacta'
    when 2 then 'sinonimo' else 'similar' end as method from best""", "best")
def match_columns(spark, sf_dir):
    return matching.match_columns(adapter.header_names(spark, sf_dir))


@query("""
  select file_id, case when e = 12 and r = 0 then 'ok' when e = 12 then 'auto'
      when e >= 6 then 'parcial' when e > 0 then 'vacio' else 'imposible' end as estado,
    e as n_encontradas, r as n_renombradas, cast(e > s as int) as conflicto,
    coalesce(mapeo, '') as mapeo, 12 - e as n_faltantes
  from (select f.file_id, count(required) as e,
      count(distinct case when name <> required then name end) as r,
      count(distinct name) as s,
      string_agg(required || '=' || name, ';' order by required) as mapeo
    from (select distinct file_id from headers) f left join best b on f.file_id = b.file_id
    group by f.file_id)""", "headers best")
def mapping_verdict(spark, sf_dir):
    best = matching.best_sources(adapter.header_names(spark, sf_dir))
    shown = F.array_join(F.transform("mapeo", lambda m: F.concat_ws("=", m["required"], m["name"])), ";")
    return matching.mapping_verdicts(best).select(
        "file_id", "estado", "n_encontradas", "n_renombradas", "conflicto", shown.alias("mapeo"),
        F.size("faltantes").cast("long").alias("n_faltantes"))


# One known foreign spelling per required column
FOREIGN = ["card_type", "card_status", "expiry date", "Repositorio", "CARD-LOCATION",
           "cupo_acumulado", "ultimo_retiro", "mora", "status_indicator", "amparada",
           "reexpedida", "payroll.type"]


@query("select tx_id, " + ", ".join(
    f"strftime({c}, '%Y-%m-%d') as {c}" if c in schema.DATE_COLUMNS else c
    for c in schema.REQUIRED) + " from card_tx", "card_tx")
def apply_mapping(spark, sf_dir):
    foreign = adapter.card_tx(spark, sf_dir).drop("fraude", "run_id").withColumnsRenamed(
        dict(zip(schema.REQUIRED, FOREIGN)))
    mapped = matching.apply_mapping(foreign, matching.detect_mapping(foreign))
    return dates_as_text(mapped)


@query("""
  select f.file_id, f.required, coalesce(b.name, m.name) as name,
    case when b.name is not null then 'automatico' when m.name is not null then 'manual'
      else 'falta' end as origen
  from (select h.file_id, slot, required, first_name from (
      select file_id, arg_min(name, (pos, name)) as first_name from headers group by file_id) h
    cross join required) f
  left join best b on b.file_id = f.file_id and b.required = f.required
  left join (select distinct file_id, name from headers) m on m.file_id = f.file_id
    and f.slot % 3 = 0 and m.name = f.first_name""", "headers required best")
def confirm_mapping(spark, sf_dir):
    names = adapter.header_names(spark, sf_dir)
    return matching.merge_manual(matching.best_sources(names), adapter.manual_choices(names),
                                 names)


@query("""select file_id, pos, array_to_string([upper(substr(x, 1, 1)) || substr(x, 2)
    for x in string_split(lower(replace(name, '_', ' ')), ' ')], ' ') as nombre from headers""", "headers")
def human_label(spark, sf_dir):
    return adapter.header_names(spark, sf_dir).select(
        "file_id", "pos", human(F.col("name")).alias("nombre"))


@query("""select distinct file_id, 'extra' as tipo, name from headers
    where name not in (select required from required)
  union all select file_id, 'falta', required from (
    select f.file_id, r.required from (select distinct file_id from headers) f
      cross join required r
    except select file_id, name from headers)""", "headers required")
def schema_diff(spark, sf_dir):
    return matching.schema_difference(adapter.header_names(spark, sf_dir), schema.REQUIRED)
