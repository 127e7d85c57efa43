"""Similar transactions, verdicts, review progress and run history."""

from pyspark.sql import functions as F

from riskloom.operators import filters, modelbook, review, similar, unions
from riskloom.session import scratch_path
from riskloom.sources import adapter, catalog
from suite.base import long, query, tenths

_SIMILAR = ("abs(a.q - b.q) <= 1000 and a.tx_id <> b.tx_id"
            " and cast(a.Estado_tarjeta = b.Estado_tarjeta as int)"
            " + cast(a.Localizacion_tarjeta = b.Localizacion_tarjeta as int)"
            " + cast(abs(a.Cuotas_mora - b.Cuotas_mora) <= 1 as int) >= 2")


@query(f"select b.tx_id, b.q from scored a join scored b on {_SIMILAR} where a.tx_id = 0",
       "scored")
def similar_one(spark, sf_dir):
    return similar.similar_to(adapter.scored_tx(spark, sf_dir), 0).select("tx_id", "q")


_ALERTS = """(select arg_min(tx_id, (-q, tx_id)) as tx_id from scored
  group by Tipo_tarjeta, Estado_tarjeta)"""
_PAIRS = f"""select a.tx_id as ref_id, b.tx_id from scored a join scored b on {_SIMILAR}
  where a.tx_id in (select tx_id from {_ALERTS} t)"""


def _alerts(rows):
    """The most probable fraud of every card type and state."""
    top = F.min_by(F.struct(*rows.columns), F.struct(-F.col("q"), F.col("tx_id")))
    return rows.groupBy("Tipo_tarjeta", "Estado_tarjeta").agg(top.alias("r")).select("r.*")


@query(_PAIRS, "scored")
def similar_many(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    return similar.similar_rows(rows, _alerts(rows))


# the most probable fraud of every run, card type and state
_RUN_ALERTS = """(select arg_min(t, (-q, tx_id)) as t from scored t
  group by run_id, Tipo_tarjeta, Estado_tarjeta)"""


@query(f"""select a.tx_id as ref_id, count(*) as n_similares, min(b.tx_id) as primera, max(b.tx_id) as ultima
  from scored a join scored b on {_SIMILAR} where a.tx_id in (select t.tx_id from {_RUN_ALERTS})
  group by a.tx_id""", "scored")
def similar_band(spark, sf_dir):
    """Through the band join over ranges, whatever the number of references."""
    rows = adapter.scored_tx(spark, sf_dir)
    top = F.min_by(F.struct(*rows.columns), F.struct(-F.col("q"), F.col("tx_id")))
    refs = rows.groupBy("run_id", "Tipo_tarjeta", "Estado_tarjeta").agg(top.alias("r")).select("r.*")
    return similar.similar_rows(rows, refs, broadcast_refs=0).groupBy("ref_id").agg(
        F.count("*").alias("n_similares"), F.min("tx_id").alias("primera"), F.max("tx_id").alias("ultima"))


@query(f"""select ref_id, tx_id, orden from (select ref_id, tx_id, row_number() over (
    partition by ref_id order by tx_id) as orden from ({_PAIRS})) where orden <= 5""", "scored")
def similar_preview(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    first = similar.first_similar(similar.similar_rows(rows, _alerts(rows)))
    return first.select("ref_id", "tx_id", long("orden"))


@query(f"""select a.tx_id, count(b.tx_id) as n_similares from scored a left join scored b
    on {_SIMILAR} group by a.tx_id""", "scored")
def similar_counts(spark, sf_dir):
    return similar.similar_counts(adapter.scored_tx(spark, sf_dir))


# --- verdicts -----------------------------------------------------------------------------------
_LATEST = """(select indice, arg_max(marcacion, (ts, seq)) as marcacion from feedback
  group by indice)"""


@query(f"""select tx_id, prediccion, marcacion as marcacion_usuario,
    cast(case when marcacion = 'verdadero_positivo' then 1 when marcacion is not null then 0 end
      as int) as etiqueta_usuario
  from scored left join {_LATEST} f on tx_id = indice""", "scored feedback")
def apply_feedback(spark, sf_dir):
    marked = review.apply_marks(adapter.scored_tx(spark, sf_dir),
                                adapter.feedback_log(spark, sf_dir), ["timestamp", "seq"])
    return marked.select("tx_id", "prediccion", "marcacion_usuario", "etiqueta_usuario")


@query("select usuario, indice, marcacion, 1 as con_hora from feedback", "feedback")
def feedback_append(spark, sf_dir):
    """Two appends, the second without times, read back as one log."""
    book = catalog.Catalog(spark, scratch_path(spark, "feedback"))
    rows = adapter.feedback_log(spark, sf_dir)
    book.add_feedback(rows.filter("marcacion = 'dudoso'"))
    book.add_feedback(rows.filter("marcacion <> 'dudoso'").drop("timestamp"))
    return book.feedback.read().select(
        "usuario", "indice", "marcacion",
        F.col("timestamp").isNotNull().cast("int").alias("con_hora"))


@query("""select coalesce(usuario, 'desconocido') as usuario, count(*) as total,
    count(*) filter (where marcacion = 'verdadero_positivo') as verdaderos_positivos,
    count(*) filter (where marcacion = 'falso_positivo') as falsos_positivos
  from feedback group by 1
  union all select '*', count(*), count(*) filter (where marcacion = 'verdadero_positivo'),
    count(*) filter (where marcacion = 'falso_positivo') from feedback""", "feedback")
def feedback_summary(spark, sf_dir):
    return review.feedback_summary(adapter.feedback_log(spark, sf_dir))


_STATE = """select run_id, count(*) filter (where fraude <> prediccion) as n_errores,
    count(etiqueta_usuario) as n_revisadas,
    count(etiqueta_usuario) filter (where fraude <> prediccion) as n_err_revisadas
  from reviewed group by run_id"""
_FLAGS = f"""{tenths('n_revisadas', 'n_errores')} as pct_revision,
    cast(n_errores > 0 and n_revisadas >= n_errores as int) as revision_completa,
    cast(n_revisadas > 0 as int) as puede_reentrenar"""


@query(f"select *, {_FLAGS} from ({_STATE})", "reviewed")
def review_state(spark, sf_dir):
    return review.review_state(adapter.reviewed_tx(spark, sf_dir), ["run_id"])


@query(f"select * from (select *, {_FLAGS} from ({_STATE})) where revision_completa = 1",
       "reviewed")
def reviewed_runs(spark, sf_dir):
    return review.reviewed_runs(adapter.reviewed_tx(spark, sf_dir), ["run_id"])


@query(f"""select run_id, cast(not (n_errores > 0 and n_revisadas < n_errores) as int)
      as permitido, greatest(0, n_errores - n_revisadas) as faltan, n_errores,
    {tenths('n_revisadas', 'n_errores')} as pct_revision from ({_STATE})""", "reviewed")
def retrain_gate(spark, sf_dir):
    return review.retrain_gate(adapter.reviewed_tx(spark, sf_dir), ["run_id"])


@query(f"""select *, {tenths('total_marcados', 'total_marcables')} as pct_revision,
    cast(total_marcados >= total_marcables and total_marcables > 0 as int) as completa
  from (select count(prediccion) as total_marcables, count(marcacion_usuario) as total_marcados,
    count(*) filter (where marcacion_usuario = 'verdadero_positivo') as n_confirmados
  from reviewed)""", "reviewed")
def review_progress(spark, sf_dir):
    return review.review_progress(adapter.reviewed_tx(spark, sf_dir))


@query("select tx_id, marcacion_usuario from reviewed where marcacion_usuario is not null",
       "reviewed")
def marked_rows(spark, sf_dir):
    return review.marked_rows(adapter.reviewed_tx(spark, sf_dir))


@query("select tx_id, q from reviewed where marcacion_usuario = 'verdadero_positivo'", "reviewed")
def confirmed_only(spark, sf_dir):
    return filters.confirmed(adapter.reviewed_tx(spark, sf_dir)).select("tx_id", "q")


@query("""select count(*) as total, cast(sum(fraude) as bigint) as fn,
    cast(count(*) - sum(fraude) as bigint) as fp from scored where fraude <> prediccion""",
       "scored")
def error_summary(spark, sf_dir):
    return review.error_backlog_summary(unions.errors_of(adapter.scored_tx(spark, sf_dir)))


# --- runs ---------------------------------------------------------------------------------------
_RUN = f"""select run_id, count(*) as n_filas, count(*) filter (where prediccion = 1) as n_fraudes,
    count(*) filter (where prediccion = 0) as n_legitimas,
    count(*) filter (where fraude <> prediccion) as n_errores,
    count(etiqueta_usuario) as n_revisadas from reviewed group by run_id"""
_HISTORY = f"""select 'analisis ' || run_id as nombre, 'analisis_' || run_id || '.csv' as archivo,
    run_id || '-01 00:00:00' as fecha,
    'Modelo_' || (cast(substr(run_id, 6, 2) as int) % 4) as modelo,
    'tx_' || replace(run_id, '-', '_') || '.csv' as database, n_filas, n_fraudes,
    run_id >= '1993-01' as tiene_gt, n_errores, n_revisadas,
    {tenths('n_revisadas', 'n_errores')} as pct_revision,
    run_id >= '1993-01' and n_revisadas*3 >= n_errores*4 as revision_completa
  from ({_RUN})"""


@query(f"""select *, {tenths('n_fraudes', 'n_filas')} as pct_fraude,
    {tenths('n_revisadas', 'n_errores')} as pct_revision,
    cast(n_errores > 0 and n_revisadas >= n_errores as int) as revision_completa
  from ({_RUN})""", "reviewed")
def run_register(spark, sf_dir):
    return review.run_summary(adapter.reviewed_tx(spark, sf_dir), ["run_id"])


@query(f"""select archivo, modelo, n_filas, n_errores from ({_HISTORY})
  where tiene_gt and not revision_completa and (contains(lower(nombre), 'modelo_1')
    or contains(lower(modelo), 'modelo_1') or contains(lower(database), 'modelo_1'))""",
       "reviewed")
def run_filter(spark, sf_dir):
    pending = filters.runs(adapter.run_history(spark, sf_dir), "pendiente", " MODELO_1")
    return pending.select("archivo", "modelo", "n_filas", "n_errores")


@query(f"""select archivo, numero, pagina from (select archivo, row_number() over (
    order by fecha desc, archivo desc) as numero, least(3, greatest(1,
    (count(*) over () + 9) // 10)) as pagina from ({_HISTORY}))
  where numero > (pagina - 1)*10 and numero <= pagina*10""", "reviewed")
def run_page(spark, sf_dir):
    shown = filters.run_page(adapter.run_history(spark, sf_dir), 3)
    return shown.select("archivo", long("numero"), long("pagina"))


@query("""select tx_id, q, prediccion from reviewed
  where run_id = (select max(run_id) from reviewed)""", "reviewed")
def run_load(spark, sf_dir):
    rows = adapter.reviewed_tx(spark, sf_dir)
    newest = rows.agg(F.max("run_id"))
    return rows.filter(F.col("run_id") == newest.scalar()).select("tx_id", "q", "prediccion")


@query(f"select archivo, n_filas from ({_HISTORY}) where tiene_gt", "reviewed")
def run_delete(spark, sf_dir):
    history = adapter.run_history(spark, sf_dir)
    kept = modelbook.remove(history, filters.runs(history, "sin_gt"), "archivo")
    return kept.select("archivo", "n_filas")


@query(f"""select h.archivo, coalesce(s.n_errores, h.n_errores) as n_errores,
    coalesce(s.n_marcadas, h.n_revisadas) as n_revisadas
  from ({_HISTORY}) h left join (
    select 'analisis_' || run_id || '.csv' as archivo,
      count(*) filter (where fraude <> prediccion) as n_errores, count(marcacion) as n_marcadas
    from scored left join {_LATEST} f on tx_id = indice
    group by run_id having count(marcacion) > 0) s on s.archivo = h.archivo""",
       "reviewed feedback")
def sync_review(spark, sf_dir):
    """The feedback log applied to the history; months without any verdict keep their counts."""
    marked = review.apply_marks(adapter.scored_tx(spark, sf_dir),
                                adapter.feedback_log(spark, sf_dir), ["timestamp", "seq"])
    state = review.review_state(marked, ["run_id"]).filter("n_revisadas > 0").withColumn(
        "archivo", F.concat(F.lit("analisis_"), F.col("run_id"), F.lit(".csv"))).withColumn(
        "revision_completa", F.col("revision_completa") == 1)
    history = adapter.run_history(spark, sf_dir)
    return review.sync_history(history, state, "archivo").select(
        "archivo", "n_errores", "n_revisadas")


@query(f"""select nombre, case when nombre in (select archivo from ({_HISTORY})) then 'historial'
    when nombre in (select run_id from ({_RUN})) then 'database' else 'omitido' end as origen
  from (select case cast(substr(run_id, 6, 2) as int) % 3 when 0 then 'analisis_' || run_id || '.csv'
    when 1 then run_id else 'perdido_' || run_id end as nombre from ({_RUN}))""", "reviewed")
def extra_lookup(spark, sf_dir):
    history = adapter.run_history(spark, sf_dir)
    rows = adapter.card_tx(spark, sf_dir)
    datasets = catalog.dataset_profiles(rows, "run_id")
    month, run = F.substring("nombre", 6, 2).cast("int") % 3, F.col("nombre")
    wanted = datasets.select(
        F.when(month == 0, F.concat(F.lit("analisis_"), run, F.lit(".csv")))
        .when(month == 1, run).otherwise(F.concat(F.lit("perdido_"), run)).alias("nombre"))
    return modelbook.lookup_extras(wanted, history, datasets)


@query(f"""select archivo, modelo, nombre, database from ({_HISTORY})
  where archivo = (select max(archivo) from ({_HISTORY}))""", "reviewed")
def run_lookup(spark, sf_dir):
    history = adapter.run_history(spark, sf_dir)
    key = history.agg(F.max("archivo"))
    return history.filter(F.col("archivo") == key.scalar()).select(
        "archivo", "modelo", "nombre", "database")


# --- datasets -----------------------------------------------------------------------------------
_DATASETS = """select run_id as nombre, count(*) as filas, cast(15 as bigint) as columnas,
    1 as tiene_fraude, cast(sum(fraude) as bigint) as n_fraudes from card_tx group by run_id"""


@query(_DATASETS, "card_tx")
def dataset_register(spark, sf_dir):
    return catalog.dataset_profiles(adapter.card_tx(spark, sf_dir), "run_id")


@query(f"select * from ({_DATASETS}) where n_fraudes * 8 >= filas", "card_tx")
def dataset_delete(spark, sf_dir):
    datasets = catalog.dataset_profiles(adapter.card_tx(spark, sf_dir), "run_id")
    return modelbook.remove(datasets, datasets.filter("n_fraudes * 8 < filas"), "nombre")
