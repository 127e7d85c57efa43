"""Analyst verdicts and review progress."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions.labels import mark_label, percent_tenths


def latest_marks(feedback: DataFrame, order: list[str], id_col: str = "indice") -> DataFrame:
    """The last verdict per row. One aggregation, combined before the shuffle."""
    return feedback.groupBy(F.col(id_col).alias("tx_id")).agg(
        F.max_by("marcacion", F.struct(*order)).alias("marcacion_usuario"))


def apply_marks(scored: DataFrame, feedback: DataFrame, order: list[str],
                id_col: str = "indice") -> DataFrame:
    """Scored rows with their latest verdict and its label; verdicts on unknown ids are ignored."""
    base = scored.drop("marcacion_usuario", "etiqueta_usuario")
    return base.join(latest_marks(feedback, order, id_col), "tx_id", "left").withColumn(
        "etiqueta_usuario", mark_label(F.col("marcacion_usuario")))


def mark_one(scored: DataFrame, feedback: DataFrame, tx_id: int) -> None:
    """Guard for a single verdict: the row has to exist."""
    if scored.filter(F.col("tx_id") == tx_id).limit(1).count() == 0:
        raise ValueError(f"Índice inválido: {tx_id}")


def error_flag() -> Column:
    return F.coalesce(F.col("fraude").cast("int") != F.col("prediccion").cast("int"),
                      F.lit(False))


def review_state(df: DataFrame, by: list[str]) -> DataFrame:
    """Errors and reviewed rows per run. Any labelled row counts as reviewed, as does a row that
    is no error, so the share can pass 100; ``n_err_revisadas`` counts reviewed errors only."""
    reviewed = F.col("etiqueta_usuario").isNotNull()
    counts = df.groupBy(*by).agg(
        F.count_if(error_flag()).alias("n_errores"),
        F.count_if(reviewed).alias("n_revisadas"),
        F.count_if(error_flag() & reviewed).alias("n_err_revisadas"))
    return review_columns(counts)


def review_columns(counts: DataFrame) -> DataFrame:
    """Shares and verdicts from the counts of each run."""
    err, rev = F.col("n_errores"), F.col("n_revisadas")
    return counts.withColumns({
        "pct_revision": percent_tenths(rev, err),
        "revision_completa": ((err > 0) & (rev >= err)).cast("int"),
        "puede_reentrenar": (rev > 0).cast("int"),
    })


def reviewed_runs(df: DataFrame, by: list[str]) -> DataFrame:
    return review_state(df, by).filter("revision_completa = 1")


def retrain_gate(df: DataFrame, by: list[str]) -> DataFrame:
    """May the run be used for retraining, and if not, how much review is left."""
    state = review_state(df, by)
    left = F.greatest(F.lit(0), F.col("n_errores") - F.col("n_revisadas"))
    blocked = (F.col("n_errores") > 0) & (left > 0)
    return state.select(*by, (~blocked).cast("int").alias("permitido"),
                        left.cast("long").alias("faltan"), "n_errores", "pct_revision")


def review_progress(df: DataFrame) -> DataFrame:
    """Marked rows out of all predicted ones."""
    counts = df.agg(F.count("prediccion").alias("total_marcables"),
                    F.count("marcacion_usuario").alias("total_marcados"),
                    F.count_if(F.col("marcacion_usuario") == schema.MARK_TRUE)
                    .alias("n_confirmados"))
    total, done = F.col("total_marcables"), F.col("total_marcados")
    return counts.withColumns({
        "pct_revision": percent_tenths(done, total),
        "completa": ((done >= total) & (total > 0)).cast("int")})


def marked_rows(df: DataFrame) -> DataFrame:
    """Rows that carry one of the two known verdicts."""
    return df.filter(F.col("marcacion_usuario").isin(schema.MARK_TRUE, schema.MARK_FALSE)).select(
        "tx_id", "marcacion_usuario")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Verdicts in all (user ``*``) and by user; a missing user has the unknown name."""
    user = F.coalesce(F.col("usuario"), F.lit(schema.UNKNOWN))
    per_user = feedback.groupBy(user.alias("usuario")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("marcacion") == schema.MARK_TRUE).alias("verdaderos_positivos"),
        F.count_if(F.col("marcacion") == schema.MARK_FALSE).alias("falsos_positivos"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
            for c in ("total", "verdaderos_positivos", "falsos_positivos")]
    return per_user.unionByName(per_user.agg(*sums).withColumn("usuario", F.lit("*")))


def run_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """History row per run: class counts and review state in one aggregation."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n_filas"),
        F.count_if(F.col("prediccion") == 1).alias("n_fraudes"),
        F.count_if(F.col("prediccion") == 0).alias("n_legitimas"),
        F.count_if(error_flag()).alias("n_errores"),
        F.count("etiqueta_usuario").alias("n_revisadas"))
    err, rev = F.col("n_errores"), F.col("n_revisadas")
    return counts.withColumns({
        "pct_fraude": percent_tenths(F.col("n_fraudes"), F.col("n_filas")),
        "pct_revision": percent_tenths(rev, err),
        "revision_completa": ((err > 0) & (rev >= err)).cast("int")})


def sync_history(history: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """History rows with fresh review counts; runs that were not recomputed keep theirs."""
    fresh = ["n_errores", "n_revisadas", "pct_revision", "revision_completa"]
    new = state.select(key, *[F.col(c).alias(f"_{c}") for c in fresh])
    joined = history.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fresh}).drop(
        *[f"_{c}" for c in fresh])


def error_backlog_summary(backlog: DataFrame) -> DataFrame:
    fn = F.coalesce(F.sum("fraude"), F.lit(0)).cast("long")
    return backlog.agg(F.count("*").alias("total"), fn.alias("fn"),
                       (F.count("*") - fn).alias("fp"))
