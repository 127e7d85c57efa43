"""Samples, splits, label noise and the building of training sets."""

from pyspark.sql import functions as F

from riskloom.operators import sampling, unions
from riskloom.sources import adapter
from suite.base import query, view

view("hashed", "select *, md5(tx_id || '|42') as h from scored", "scored")
view("ranked", """select *, row_number() over (partition by fraude order by h, tx_id) as rk,
    count(*) over (partition by fraude) as nc, count(*) over () as nt from hashed""", "hashed")
view("class_sizes", """select fraude, nc, nt, t, nc * t // nt as base, nc * t % nt as rest from (
    select fraude, count(*) as nc, sum(count(*)) over () as nt,
      cast(ceil(sum(count(*)) over () * cast(0.3 as double)) as bigint) as t
    from scored group by fraude)""", "scored")
view("test_sizes", """select fraude, base + cast(row_number() over (order by rest desc, fraude)
    <= t - sum(base) over () as int) as k from class_sizes""", "class_sizes")


@query("select tx_id, md5(tx_id || '|42') as orden from card_tx", "card_tx")
def seeded_shuffle(spark, sf_dir):
    return sampling.seeded_shuffle(adapter.card_tx(spark, sf_dir)).select("tx_id", "orden")


@query("""select tx_id, fraude from ranked
  where nt <= 6000 or rk <= least(nc, 6000 * nc // nt)""", "ranked")
def stratified_cap(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    return sampling.stratified_cap(rows, 6000).select("tx_id", "fraude")


@query("""select tx_id, r.fraude, cast(rk <= k as int) as es_prueba
  from ranked r join test_sizes s on r.fraude = s.fraude""", "ranked test_sizes")
def stratified_split(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    return sampling.stratified_split(rows).select("tx_id", "fraude", "es_prueba")


view("noisy", """select tx_id, fraude_true, marked as es_etiqueta_ruidosa,
    case when marked = 1 then 1 - fraude_true else fraude_true end as fraude from (
  select tx_id, fraude as fraude_true, cast(rk <= case when fraude = 0 then noise // 2
      else noise - noise // 2 end as int) as marked from (
    select *, cast(floor(nt * cast(0.2 as double)) as bigint) as noise from ranked))""", "ranked")


@query("select * from noisy", "noisy")
def label_noise(spark, sf_dir):
    noisy = sampling.label_noise(adapter.scored_tx(spark, sf_dir))
    return noisy.select("tx_id", "fraude_true", "fraude", "es_etiqueta_ruidosa")


@query("""select fraude_true, es_etiqueta_ruidosa, count(*) as n from noisy
  group by fraude_true, es_etiqueta_ruidosa""", "noisy")
def noise_audit(spark, sf_dir):
    return sampling.noise_audit(sampling.label_noise(adapter.scored_tx(spark, sf_dir)))


@query("""select tx_id, fraude, case when run_id >= '1996' then q end as q from scored
  where fraude <> prediccion""", "scored")
def accumulate_errors(spark, sf_dir):
    """Errors of the later runs added to a backlog of the earlier ones, which has no score."""
    rows = adapter.scored_tx(spark, sf_dir)
    backlog = unions.errors_of(rows.filter("run_id < '1996'")).drop("q")
    newer = unions.errors_of(rows.filter("run_id >= '1996'"))
    return unions.append_backlog(backlog, newer).select("tx_id", "fraude", "q")


@query("select tx_id, 1 as fraude, q from scored where prediccion = 1", "scored")
def accumulate_frauds(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    return unions.append_backlog(None, unions.frauds_of(rows)).select("tx_id", "fraude", "q")


view("weight", """select greatest(5, cast(floor(b * cast(0.1 as double)) as bigint)
    // greatest(e, 1)) as peso from (select count(*) as b,
      count(*) filter (where fraude <> prediccion) as e from scored)""", "scored")


@query("""select tx_id, fraude, unnest(range(1, peso + 1)) as copia from scored, weight
  where fraude <> prediccion""", "scored weight")
def weighted_replication(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    copies = sampling.replicate_corrections(rows, unions.errors_of(rows))
    return copies.select("tx_id", "fraude", "copia")


@query("select tx_id, fraude, peso from scored, weight where fraude <> prediccion",
       "scored weight")
def weighted_rows(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    return sampling.weigh_corrections(rows, unions.errors_of(rows)).select(
        "tx_id", "fraude", "peso")


@query("""select tx_id, fraude, cast(null as int) as q, run_id from scored
  union all select tx_id, coalesce(cast(case when tx_id % 4 <> 0 then fraude end as int), 0), q,
    cast(null as varchar) from scored
  union all select tx_id, fraude, q, run_id from scored where fraude <> prediccion""", "scored")
def combine_training(spark, sf_dir):
    """Base set, one usable extra set with gaps in its label, one without any, and corrections."""
    rows = adapter.scored_tx(spark, sf_dir)
    gappy = rows.drop("run_id").withColumn(
        "fraude_true", F.when(F.col("tx_id") % 4 != 0, F.col("fraude").cast("double")))
    extras, _ = unions.usable_extras({"a": gappy, "b": rows.drop("fraude"), "c": None})
    parts = [unions.with_label(rows.drop("q")), *extras, unions.errors_of(rows)]
    return unions.combine(parts).select("tx_id", "fraude", "q", "run_id")


@query("""select tx_id, Tipo_tarjeta, Cuotas_mora, fraude, 'Bogotá' as Ubicacion from scored
  union all select tx_id + 1000000000, Tipo_tarjeta, cast(null as int), 1, 'Bogotá' from scored
    where fraude = 1""", "scored")
def augment_union(spark, sf_dir):
    """Synthetic frauds lack a column and carry a foreign one."""
    rows = adapter.scored_tx(spark, sf_dir).select("tx_id", "Tipo_tarjeta", "Cuotas_mora",
                                                   "fraude")
    made = rows.filter("fraude = 1").withColumn("tx_id", F.col("tx_id") + 1_000_000_000).drop(
        "Cuotas_mora").withColumn("ruido", F.lit(0.5))
    return unions.augment(rows, made)
