"""Classification metrics, curves, and the model catalogue."""

from pyspark.sql import functions as F

from riskloom.operators import metrics, modelbook
from riskloom.plans import reports
from riskloom.session import scratch_path
from riskloom.sources import adapter, files
from suite.base import AP, AUC, long, query, r6, sql_ratio, sql_report, view

_COUNTS = """select count(*) filter (where fraude=1 and prediccion=1) as tp,
    count(*) filter (where fraude=0 and prediccion=1) as fp,
    count(*) filter (where fraude=0 and prediccion=0) as tn,
    count(*) filter (where fraude=1 and prediccion=0) as fn"""


@query(f"""select *, {sql_ratio('tp', '(tp+fp)')} as precision, {sql_ratio('tp', '(tp+fn)')}
    as recall from ({_COUNTS} from scored)""", "scored")
def confusion_counts(spark, sf_dir):
    return metrics.confusion_report(adapter.scored_tx(spark, sf_dir))


@query("""select fraude as real, count(*) filter (where prediccion = 0) as pred_0,
    count(*) filter (where prediccion = 1) as pred_1 from scored group by fraude""", "scored")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(adapter.scored_tx(spark, sf_dir))


@query(sql_report("scored"), "scored")
def classification_report(spark, sf_dir):
    return metrics.classification_report(adapter.scored_tx(spark, sf_dir))


@query(f"select round({AUC}, 6) as roc_auc from curve", "curve")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(adapter.scored_tx(spark, sf_dir)).select(r6("roc_auc"))


@query(f"select round({AP}, 6) as pr_auc from curve", "curve")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(adapter.scored_tx(spark, sf_dir)).select(r6("pr_auc"))


@query(f"select {sql_ratio('tn', '(tn+fp)')} as especificidad from ({_COUNTS} from scored)",
       "scored")
def specificity(spark, sf_dir):
    return metrics.specificity(adapter.scored_tx(spark, sf_dir))


@query("""select umbral, cast(tp as double) / pos as tpr, cast(fp as double) / neg as fpr
  from curve""", "curve")
def roc_curve(spark, sf_dir):
    return metrics.roc_points(adapter.scored_tx(spark, sf_dir))


@query("""select umbral / cast(10000 as double) as umbral,
    cast(tp as double) / (tp + fp) as precision, cast(tp as double) / pos as recall
  from curve""", "curve")
def pr_curve(spark, sf_dir):
    """On raw probabilities, by buckets: the form for scores that are on no grid."""
    return metrics.pr_points(adapter.scored_tx(spark, sf_dir), score="probabilidad")


_SECTIONS = """case clase when '0' then 'Clase 0 - Legítima' when '1' then 'Clase 1 - Fraude'
    else 'Métricas generales' end as seccion"""


@query(f"""select {_SECTIONS}, upper(substr(metrica, 1, 1)) || substr(metrica, 2) as metrica, valor
    from ({sql_report('scored')}) where clase in ('0', '1', 'accuracy')
  union all select 'Métricas generales', 'ROC AUC', round({AUC}, 6) from curve
  union all select 'Métricas generales', 'PR AUC', round({AP}, 6) from curve
  union all select 'Retroalimentación', 'Total marcaciones', cast(count(*) as double)
    from feedback
  union all select 'Retroalimentación', 'Verdaderos positivos confirmados',
    cast(count(*) filter (where marcacion = 'verdadero_positivo') as double) from feedback
  union all select 'Retroalimentación', 'Falsos positivos reportados',
    cast(count(*) filter (where marcacion = 'falso_positivo') as double) from feedback""",
       "scored curve feedback")
def performance_report(spark, sf_dir):
    report = reports.performance_report(adapter.scored_tx(spark, sf_dir),
                                        adapter.feedback_log(spark, sf_dir))
    area = F.col("metrica").isin("ROC AUC", "PR AUC")
    return report.withColumn("valor", F.when(area, F.round("valor", 6)).otherwise(F.col("valor")))


# --- many models at once ------------------------------------------------------------------------
view("model_auc", f"select modelo, {AUC} as roc_auc, {AP} as pr_auc from model_curve"
     " group by modelo", "model_curve")
view("model_report", sql_report("model_scores", "modelo"), "model_scores")


def _pick(clase: str, metrica: str) -> str:
    return f"max(valor) filter (where clase = '{clase}' and metrica = '{metrica}')"


view("model_docs", f"""select a.modelo, roc_auc, pr_auc, {_pick('accuracy', 'accuracy')} as acc,
    {_pick('1', 'f1-score')} as f1, {_pick('1', 'precision')} as pr1,
    {_pick('1', 'recall')} as re1, {_pick('0', 'support')} as s0, {_pick('0', 'recall')} as r0
  from model_auc a join model_report r on a.modelo = r.modelo group by a.modelo, roc_auc, pr_auc""",
     "model_auc model_report")
view("shared_report", sql_report("scored"), "scored")
view("shared_doc", f"""select (select {AUC} from curve) as roc_auc, (select {AP} from curve)
    as pr_auc, {_pick('accuracy', 'accuracy')} as acc, {_pick('1', 'f1-score')} as f1,
    {_pick('1', 'precision')} as pr1, {_pick('1', 'recall')} as re1,
    {_pick('0', 'support')} as s0, {_pick('0', 'recall')} as r0 from shared_report""",
     "curve shared_report")
_OWN = "not contains(modelo, 'Backup')"
view("model_book", f"""select m.nombre, m.es_original, m.fecha, case when d.modelo is not null
      then 'propia' else 'global' end as metrics_source,
    {', '.join(f'case when d.modelo is not null then d.{c} else g.{c} end as {c}' for c in
               ('roc_auc', 'pr_auc', 'acc', 'f1', 'pr1', 're1', 's0', 'r0'))}
  from models m left join (select * from model_docs where {_OWN}) d on d.modelo = m.nombre
    cross join shared_doc g""", "models model_docs shared_doc")


def _book(spark, sf_dir):
    own = metrics.metrics_document(adapter.model_scores(spark, sf_dir), ["modelo"])
    shared = metrics.metrics_document(adapter.scored_tx(spark, sf_dir))
    return modelbook.with_metrics(
        adapter.model_rows(spark, sf_dir),
        own.filter(~F.col("modelo").contains("Backup")), shared)


@query("""select modelo, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc
  from model_auc""", "model_auc")
def model_areas(spark, sf_dir):
    rows = adapter.model_scores(spark, sf_dir)
    return metrics.areas(rows, ["modelo"]).select("modelo", r6("roc_auc"), r6("pr_auc"))


@query("select modelo, clase, metrica, valor from model_report", "model_report")
def model_reports(spark, sf_dir):
    return metrics.classification_report(adapter.model_scores(spark, sf_dir), ["modelo"])


@query(f"""select modelo, round({sql_ratio('s0*r0', '(s0*r0 + s0*(1-r0))')}, 6) as especificidad
  from model_docs""", "model_docs")
def model_specificity(spark, sf_dir):
    report = metrics.classification_report(adapter.model_scores(spark, sf_dir), ["modelo"])
    return modelbook.model_specificity(report, ["modelo"]).select("modelo", r6("especificidad"))


@query("""select nombre, metrics_source, round(roc_auc, 6) as roc_auc, f1 as f1_fraude
  from model_book""", "model_book")
def model_metrics(spark, sf_dir):
    doc = F.col("metricas")
    return _book(spark, sf_dir).select(
        "nombre", "metrics_source", F.round(doc.roc_auc, 6).alias("roc_auc"),
        doc.classification_report["1"]["f1-score"].alias("f1_fraude"))


@query("""select nombre, cast(row_number() over (order by roc_auc desc nulls last, nombre)
      as bigint) as puesto, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc,
    round(acc*100, 6) as accuracy, f1 as f1_fraude, pr1 as precision_fraude, re1 as recall_fraude,
    round(s0*r0 / nullif(s0*r0 + s0*(1-r0), 0), 6) as especificidad from model_book""",
       "model_book")
def model_ranking(spark, sf_dir):
    rows = modelbook.ranked(modelbook.ranking(_book(spark, sf_dir), digits=None))
    return rows.select("nombre", long("puesto"), r6("roc_auc"), r6("pr_auc"), r6("accuracy"),
                       "f1_fraude", "precision_fraude", "recall_fraude", r6("especificidad"))


@query("""select modelo, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc,
    f1 as f1_fraude, s0 as soporte_0 from model_docs""", "model_docs")
def metrics_json(spark, sf_dir):
    """Nested metrics documents, written as JSON and read back by path."""
    path = scratch_path(spark, "metrics-json")
    files.write_metrics(
        metrics.metrics_document(adapter.model_scores(spark, sf_dir), ["modelo"]), path)
    report = F.col("classification_report")
    return files.read_metrics(spark, path).select(
        "modelo", r6("roc_auc"), r6("pr_auc"), report["1"]["f1-score"].alias("f1_fraude"),
        report["0"]["support"].alias("soporte_0"))


@query(f"""select n.clase, n.metrica, v.valor as anterior, n.valor as nuevo,
    round(n.valor - v.valor, 6) as delta
  from ({sql_report('scored')}) n full join (
    {sql_report('(select fraude, cast(q >= 4000 as int) as prediccion from scored)')}) v
  on n.clase = v.clase and n.metrica = v.metrica""", "scored")
def metrics_delta(spark, sf_dir):
    rows = adapter.scored_tx(spark, sf_dir)
    old = metrics.classification_report(
        rows.withColumn("prediccion", (F.col("q") >= 4000).cast("int")))
    new = metrics.classification_report(rows)
    delta = metrics.metrics_delta(old, new, ["clase", "metrica"])
    return delta.withColumn("delta", F.round("delta", 6))


@query(f"select modelo, round(roc_auc, 6) as roc_auc, clave as grid_pos from (select *,"
       " row_number() over (order by roc_auc desc, clave) as k from (select modelo, roc_auc,"
       " cast(regexp_extract(modelo, '[0-9]+') as bigint) as clave from model_auc"
       " where roc_auc is not null)) where k = 1", "model_auc")
def best_of_grid(spark, sf_dir):
    areas = metrics.roc_auc(adapter.model_scores(spark, sf_dir), ["modelo"]).filter(
        "roc_auc is not null")
    place = F.regexp_extract("modelo", "[0-9]+", 0).cast("long")
    best = modelbook.best_of_grid(areas.withColumn("grid_pos", place))
    return best.select("modelo", r6("roc_auc"), "grid_pos")


# --- catalogue ----------------------------------------------------------------------------------
@query("""select nombre, cast(es_original as int) as es_original, fecha,
    translate(replace(nombre, '.joblib', ''), '_-', '  ') as etiqueta from models
  where case when es_original then not regexp_matches(lower(nombre), 'anterior|backup')
    else not contains(lower(nombre), 'anterior') end""", "models")
def model_catalog(spark, sf_dir):
    return modelbook.catalogue(adapter.model_rows(spark, sf_dir)).select(
        "nombre", F.col("es_original").cast("int").alias("es_original"), "fecha", "etiqueta")


@query("select 'modelo_5.joblib' as nombre from supplier limit 1")
def active_model_preferred(spark, sf_dir):
    return modelbook.active_model(adapter.model_rows(spark, sf_dir),
                                  ["modelo_principal.joblib", "modelo_5.joblib"], "base.joblib")


@query("""select coalesce(min(nombre), 'base.joblib') as nombre from models where es_original
    and not regexp_matches(lower(nombre), 'anterior|backup')""", "models")
def active_model(spark, sf_dir):
    return modelbook.active_model(adapter.model_rows(spark, sf_dir),
                                  ["modelo_principal.joblib"], "base.joblib")


@query("select nombre, fecha from models where es_original or fecha >= '2024-06-01'", "models")
def model_delete(spark, sf_dir):
    models = adapter.model_rows(spark, sf_dir)
    gone = modelbook.deletable(models, models.filter("fecha < '2024-06-01'"))
    return modelbook.remove(models, gone, "nombre").select("nombre", "fecha")


@query("""select nombre as Modelo, case when es_original then 'Original' else 'Reentrenado' end
    as Tipo, fecha as Fecha, round(roc_auc, 6) as ROC_AUC, round(pr_auc, 6) as PR_AUC,
    round(acc*100, 6) as Accuracy, f1 as F1_Fraude, pr1 as Precision_Fraude,
    re1 as Recall_Fraude from model_book""", "model_book")
def ranking_export(spark, sf_dir):
    rows = modelbook.export_rows(modelbook.ranking(_book(spark, sf_dir), digits=None))
    return rows.select("Modelo", "Tipo", "Fecha", r6("ROC_AUC"), r6("PR_AUC"), r6("Accuracy"),
                       "F1_Fraude", "Precision_Fraude", "Recall_Fraude")
