"""Row filters, text search and paging."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schema
from riskloom.functions.labels import error_tag, outcome_text
from riskloom.operators.ranks import keys_at_ranks, one_group, rank_page

SHALLOW = 10_000     # a page that ends before this row is cut by a top-k sort


def tab(df: DataFrame, name: str = "fraudes") -> DataFrame:
    """Predicted frauds, predicted legitimate rows, or every row with its outcome text."""
    if name == "analisis":
        if "fraude" not in df.columns:
            return df
        return df.withColumn("resultado", outcome_text(F.col("fraude"), F.col("prediccion")))
    return df.filter(F.col("prediccion") == (0 if name == "legitimas" else 1))


def error_rows(df: DataFrame, id_col: str = "tx_id", first: int = 50) -> DataFrame:
    """The first false negatives and false positives by id, with the full count of each kind."""
    tagged = df.withColumn("tipo_error", error_tag(F.col("fraude"), F.col("prediccion")))
    wrong = tagged.filter(F.col("tipo_error").isNotNull())
    totals = wrong.groupBy("tipo_error").agg(F.count("*").alias("n_tipo"))
    place = F.row_number().over(W.partitionBy("tipo_error").orderBy(id_col))
    # the rank limit is applied in every task before the shuffle, so no kind is a hot group
    top = wrong.withColumn("_k", place).filter(F.col("_k") <= first).drop("_k")
    return top.join(F.broadcast(totals), "tipo_error")


def search(df: DataFrame, pattern: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where any column, as text, holds the case-insensitive pattern; null never does."""
    pattern = pattern.strip()
    if not pattern:
        return df
    hit = F.lit(False)
    for name in cols or df.columns:
        hit = hit | F.coalesce(F.col(name).cast("string").rlike("(?i)" + pattern), F.lit(False))
    return df.filter(hit)


def page(df: DataFrame, number: int, size: int | None, id_col: str = "tx_id") -> DataFrame:
    """One page by id. Early pages are a top-k; deep ones are found by their rank."""
    if size is None:
        return df.orderBy(id_col)
    if number * size <= SHALLOW:
        return df.orderBy(id_col).offset((number - 1) * size).limit(size)
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return rank_page(df, number, size, id_col)
    return df.orderBy(id_col).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    pages = F.ceil(F.col("total") / size)
    return df.agg(F.count("*").alias("total")).withColumn(
        "total_paginas", F.greatest(F.lit(1), pages).cast("long"))


def runs(df: DataFrame, state: str = "todos", text: str = "") -> DataFrame:
    """Run history by review state and by a piece of its name, model or dataset."""
    done, labelled = F.col("revision_completa"), F.col("tiene_gt")
    states = {"completo": done, "pendiente": labelled & ~done, "sin_gt": ~labelled}
    if state in states:
        df = df.filter(states[state])
    text = text.strip().lower()
    if text:
        hit = F.lit(False)
        for name in ("nombre", "modelo", "database"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(text))
        df = df.filter(hit)
    return df


def run_page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Newest first; a page number outside the history shows its nearest page."""
    key = ["fecha", "archivo"]

    def as_targets(sizes: DataFrame) -> DataFrame:
        pages = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
        asked = sizes.select("_all", "n", F.greatest(
            F.lit(1), F.least(F.lit(number), pages)).cast("long").alias("pagina"))
        ends = F.explode(F.array(
            F.struct(F.lit("lo").alias("side"), F.greatest(
                F.lit(1), F.col("n") - F.col("pagina") * size + 1).alias("k")),
            F.struct(F.lit("hi").alias("side"),
                     (F.col("n") - (F.col("pagina") - 1) * size).alias("k")))).alias("e")
        return asked.select("_all", "pagina", ends).select(
            "_all", F.struct("pagina", "e.side").alias("target"), "e.k")

    cuts = keys_at_ranks(df.select(one_group("archivo").alias("_all"), *key), ["_all"], key,
                         F.substring("fecha", 1, 10), as_targets)
    ends = cuts.agg(F.struct(
        F.max("target.pagina").alias("pagina"),
        *[F.max(F.when(F.col("target.side") == side, F.struct(*key))).alias(side)
          for side in ("lo", "hi")]).alias("b"))
    rows = df.withColumn("_b", ends.scalar()).filter(
        (F.struct(*key) >= F.col("_b.lo")) & (F.struct(*key) <= F.col("_b.hi")))
    place = F.row_number().over(W.partitionBy("pagina").orderBy(*[F.desc(k) for k in key]))
    return (rows.withColumn("pagina", F.col("_b.pagina")).drop("_b")
            .withColumn("numero", (F.col("pagina") - 1) * size + place))


def confirmed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("marcacion_usuario") == schema.MARK_TRUE)
