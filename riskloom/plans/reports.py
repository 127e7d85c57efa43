"""Exported reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.operators.clean import present
from riskloom.operators.metrics import metrics_document
from riskloom.operators.review import feedback_summary


def fraud_report(scored: DataFrame, stamp: bool = True, id_col: str = "tx_id") -> DataFrame:
    """Predicted frauds, most probable first; ties by id, so that a frequent probability is
    still spread over the sort's partitions."""
    rows = scored.filter(F.col("prediccion") == 1)
    if stamp:
        rows = rows.withColumn("Timestamp_reporte", F.date_format(
            F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    if "probabilidad" in rows.columns:
        rows = rows.orderBy(F.desc("probabilidad"), id_col)
    return present(rows, schema.REPORT_COLUMNS)


def performance_report(scored: DataFrame, feedback: DataFrame, score: str = "q",
                       info: dict[str, str] | None = None) -> DataFrame:
    """Long rows ``(seccion, metrica, valor)``; ``texto`` carries parameters and stamps."""
    doc = metrics_document(scored, score=score)
    general, report = "Métricas generales", F.col("classification_report")
    cells = [(general, "ROC AUC", F.col("roc_auc")), (general, "PR AUC", F.col("pr_auc")),
             (general, "Accuracy", report["accuracy"])]
    for clase, title in (("0", "Clase 0 - Legítima"), ("1", "Clase 1 - Fraude")):
        cells += [(title, m.capitalize(), report[clase][m])
                  for m in ("precision", "recall", "f1-score", "support")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("seccion"), F.lit(m).alias("metrica"), v.alias("valor"))
        for s, m, v in cells])).alias("r")
    parts = [doc.select(rows).select("r.*")]
    totals = feedback_summary(feedback).filter(F.col("usuario") == "*")
    texts = {"total": "Total marcaciones",
             "verdaderos_positivos": "Verdaderos positivos confirmados",
             "falsos_positivos": "Falsos positivos reportados"}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(text).alias("metrica"), F.col(c).cast("double").alias("valor"))
        for c, text in texts.items()])).alias("p")
    parts.append(totals.select(F.lit("Retroalimentación").alias("seccion"), pairs)
                 .select("seccion", "p.metrica", "p.valor"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if info is not None:
        rows = [("INFO REPORTE", k, None, v) for k, v in info.items()]
        extra = scored.sparkSession.createDataFrame(
            rows, "seccion string, metrica string, valor double, texto string")
        out = out.withColumn("texto", F.lit(None).cast("string")).unionByName(extra)
    return out
