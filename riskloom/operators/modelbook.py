"""Model catalogue, ranking and comparison. One row per model, so these tables are small;
all of it stays in plain joins and sorts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.labels import ratio

# Words in the name of a file that is a backup
BACKUP_WORDS = "anterior|backup"


def is_backup(name: Column) -> Column:
    return F.lower(name).rlike(BACKUP_WORDS)


def catalogue(models: DataFrame) -> DataFrame:
    """Originals by name, then retrained ones newest first; backups are hidden.

    A retrained model is hidden only for "anterior", an original one for either word.
    """
    name = F.lower("nombre")
    hidden = F.when(F.col("es_original"), is_backup(F.col("nombre"))).otherwise(
        name.contains("anterior"))
    stem = F.regexp_replace("nombre", r"\.[^.]*$", "")
    return (models.filter(~hidden)
            .withColumn("etiqueta", F.regexp_replace(stem, "[_-]", " "))
            .orderBy(F.desc("es_original"), F.when(F.col("es_original"), F.col("nombre")),
                     F.desc("fecha"), "nombre"))


def active_model(models: DataFrame, preferred: list[str], default: str) -> DataFrame:
    """First preferred name that exists, else the first original that is no backup, else the
    default; always one row."""
    place = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        place = F.when(F.col("nombre") == name, F.lit(i)).otherwise(place)
    known = F.col("nombre").isin(preferred) if preferred else F.lit(False)
    usable = models.filter(known | (F.col("es_original") & ~is_backup(F.col("nombre"))))
    first = usable.agg(F.min_by("nombre", F.struct(place, F.col("nombre"))).alias("nombre"))
    return first.select(F.coalesce("nombre", F.lit(default)).alias("nombre"))


def deletable(models: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of the asked names that may be deleted: existing, and not original."""
    return models.filter(~F.col("es_original")).join(
        asked.select("nombre").distinct(), "nombre", "left_semi")


def remove(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def with_metrics(models: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """Model rows with their own metrics document, else the shared one, and which it was."""
    mine = own.select(F.col("modelo").alias("nombre"), F.struct(
        "roc_auc", "pr_auc", "classification_report").alias("_own"))
    other = shared.select(F.struct("roc_auc", "pr_auc", "classification_report").alias("s"))
    joined = models.join(mine, "nombre", "left").withColumn("_shared", other.scalar())
    source = F.when(F.col("_own").isNotNull(), F.lit("propia")).when(
        F.col("_shared").isNotNull(), F.lit("global"))
    return joined.select(*models.columns, F.coalesce("_own", "_shared").alias("metricas"),
                         source.alias("metrics_source"))


def _specificity(report: Column) -> Column:
    support, recall = report["0"]["support"], report["0"]["recall"]
    tn, fp = support * recall, support * (1 - recall)
    return F.when(tn + fp > 0, tn / (tn + fp))


def ranking(with_docs: DataFrame, digits: int | None = 4) -> DataFrame:
    """Ranking columns; ``digits=None`` leaves the values unrounded."""
    report = F.col("metricas.classification_report")
    values = {
        "roc_auc": F.col("metricas.roc_auc"), "pr_auc": F.col("metricas.pr_auc"),
        "f1_fraude": report["1"]["f1-score"], "precision_fraude": report["1"]["precision"],
        "recall_fraude": report["1"]["recall"], "especificidad": _specificity(report)}
    accuracy = report["accuracy"] * 100
    if digits is not None:
        values = {k: F.round(v, digits) for k, v in values.items()}
        accuracy = F.round(accuracy, 2)
    rest = [c for c in with_docs.columns if c != "metricas"]
    return with_docs.select(*rest, *[v.alias(k) for k, v in values.items()],
                            accuracy.alias("accuracy"),
                            F.col("metricas").isNotNull().cast("int").alias("tiene_metricas"))


def ranked(rows: DataFrame) -> DataFrame:
    """Place of each model: those with metrics first, then by ROC AUC. One row per model."""
    order = W.partitionBy(F.lit(0)).orderBy(
        F.desc("tiene_metricas"), F.desc(F.coalesce("roc_auc", F.lit(0.0))), "nombre")
    return rows.withColumn("puesto", F.row_number().over(order))


def export_rows(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("es_original"), F.lit("Original")).otherwise(F.lit("Reentrenado"))
    names = {"roc_auc": "ROC_AUC", "pr_auc": "PR_AUC", "accuracy": "Accuracy",
             "f1_fraude": "F1_Fraude", "precision_fraude": "Precision_Fraude",
             "recall_fraude": "Recall_Fraude"}
    return rows.select(F.col("nombre").alias("Modelo"), kind.alias("Tipo"),
                       F.col("fecha").alias("Fecha"),
                       *[F.col(a).alias(b) for a, b in names.items()])


def best_of_grid(results: DataFrame, score: str = "roc_auc", place: str = "grid_pos") -> DataFrame:
    """The highest score; the earliest grid point on a tie."""
    best = F.max_by(F.struct(*results.columns), F.struct(F.col(score), -F.col(place)))
    return results.agg(best.alias("b")).select("b.*")


def model_specificity(report: DataFrame, by: list[str] = ()) -> DataFrame:
    """Specificity rebuilt from recall and support of class 0 in a long report."""
    def at(metric: str) -> Column:
        return F.max(F.when((F.col("clase") == "0") & (F.col("metrica") == metric),
                            F.col("valor")))
    wide = report.groupBy(*by).agg(at("support").alias("s"), at("recall").alias("r"))
    tn, fp = F.col("s") * F.col("r"), F.col("s") * (1 - F.col("r"))
    return wide.select(*by, ratio(tn, tn + fp).alias("especificidad"))


def lookup_extras(wanted: DataFrame, runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Where each wanted file lies: run history first, then the dataset catalogue."""
    r = runs.select(F.col("archivo").alias("nombre"), F.lit("historial").alias("_r"))
    d = datasets.select("nombre", F.lit("database").alias("_d"))
    found = wanted.join(r, "nombre", "left").join(d, "nombre", "left")
    return found.select("nombre", F.coalesce("_r", "_d", F.lit("omitido")).alias("origen"))
