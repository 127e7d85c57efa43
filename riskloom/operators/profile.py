"""Table profile, outliers, class counts and fill values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.labels import imbalance_verdict, percent_hundredths, percent_tenths
from riskloom.operators.ranks import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells and, with a label, fraud and legitimate counts."""
    nulls = F.lit(0)
    for field in df.schema.fields:
        missing = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(field.name)
        nulls = nulls + missing.cast("int")
    aggs = [F.count("*").alias("total_filas"),
            F.lit(len(df.columns)).cast("long").alias("total_columnas"),
            F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("valores_nulos")]
    if "fraude" in df.columns:
        aggs += [F.count_if(F.col("fraude") == 1).alias("fraudes"),
                 F.count_if(F.col("fraude") == 0).alias("legitimas")]
    out = df.agg(*aggs)
    if "fraude" in df.columns:
        out = out.withColumn("pct_fraude",
                             percent_hundredths(F.col("fraudes"), F.col("total_filas")))
    return out


def imbalance(df: DataFrame) -> DataFrame:
    return profile(df).select("fraudes", "total_filas", "pct_fraude",
                              imbalance_verdict(F.col("pct_fraude")).alias("alerta"))


def class_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count("*").alias("n_filas"),
                    F.count_if(F.col("prediccion") == 1).alias("n_fraudes"),
                    F.count_if(F.col("prediccion") == 0).alias("n_legitimas"))
    return counts.withColumn("pct_fraude",
                             percent_tenths(F.col("n_fraudes"), F.col("n_filas")))


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor"))
        for c in cols])).alias("p")
    return (df.select(pairs).select("p.*").filter("valor is not null")
            .groupBy("columna", "valor").agg(F.count("*").alias("n")))


def iqr_fences(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Quartiles and the 1.5 IQR fences per numeric column."""
    quarts = quantiles(df, cols or numeric_columns(df), [0.25, 0.75])
    wide = quarts.groupBy("columna").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return wide.select("columna", "q1", "q3", (F.col("q1") - spread).alias("lo"),
                       (F.col("q3") + spread).alias("hi"))


def flag_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Adds ``es_outlier``: outside the fences in any of the columns."""
    cols = cols or numeric_columns(df)
    fences = iqr_fences(df, cols)
    one_row = fences.agg(F.struct(*[
        F.max(F.when(F.col("columna") == c, F.struct("lo", "hi"))).alias(c)
        for c in cols]).alias("f"))
    out = df.withColumn("_f", one_row.scalar())
    hit = F.lit(False)
    for c in cols:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None))
        hit = hit | F.coalesce((value < F.col(f"_f.{c}.lo")) | (value > F.col(f"_f.{c}.hi")),
                               F.lit(False))
    return out.withColumn("es_outlier", hit).drop("_f")


def fill_values(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Median of numeric columns and most frequent text (smallest on a tie), as text."""
    medians = quantiles(df, numeric, [0.5]).select(
        "columna", F.lit("median").alias("method"), F.col("quantile").alias("number"),
        F.lit(None).cast("string").alias("text"))
    modes = (category_counts(df, text).groupBy("columna")
             .agg(F.min_by("valor", F.struct(-F.col("n"), F.col("valor"))).alias("text"))
             .select("columna", F.lit("mode").alias("method"),
                     F.lit(None).cast("double").alias("number"), "text"))
    return medians.unionByName(modes)


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Fills nulls by median and mode."""
    values = fill_values(df, numeric, text)
    one_row = values.agg(F.struct(*[
        F.max(F.when(F.col("columna") == c, F.col("number"))).alias(c) for c in numeric
    ] + [F.max(F.when(F.col("columna") == c, F.col("text"))).alias(c) for c in text]).alias("v"))
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"_v.{c}"))
              for c in numeric}
    filled |= {c: F.coalesce(F.col(c), F.col(f"_v.{c}")) for c in text}
    return df.withColumn("_v", one_row.scalar()).withColumns(filled).drop("_v")


def zscore(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Standard score with the population deviation; a constant column scales by 1."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
        for c in cols]).alias("s"))
    scaled = {}
    for c in cols:
        std = F.col(f"_s.{c}.std")
        scaled[c + suffix] = (F.col(c) - F.col(f"_s.{c}.mean")) / F.when(std == 0, 1.0).otherwise(
            std)
    return df.withColumn("_s", stats.scalar()).withColumns(scaled).drop("_s")


def zscore_inverse(df: DataFrame, source: DataFrame, cols: list[str],
                   suffix: str = "_z") -> DataFrame:
    """Back from standard scores to values, with the statistics of ``source``."""
    stats = source.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
        for c in cols]).alias("s"))
    raw = {}
    for c in cols:
        std = F.col(f"_s.{c}.std")
        raw[c] = F.col(c + suffix) * F.when(std == 0, 1.0).otherwise(std) + F.col(f"_s.{c}.mean")
    return df.withColumn("_s", stats.scalar()).withColumns(raw).drop("_s")


def known_categories(df: DataFrame, cols: list[str], limit: int = 1000
                     ) -> dict[str, dict[str, int]]:
    """Category counts per column, values sorted; refuses a column with more than ``limit``.

    At most ``limit`` rows per column and one more reach the driver.
    """
    if not cols:
        return {}
    rows = category_counts(df, cols).limit(limit * len(cols) + 1).collect()
    found = {c: {r.valor: r.n for r in sorted(rows) if r.columna == c} for c in cols}
    over = [c for c, counts in found.items() if len(counts) > limit]
    if over or len(rows) > limit * len(cols):
        raise ValueError(f"more than {limit} categories: {over or cols}")
    return found


def dummies(df: DataFrame, cols: list[str], known: dict[str, list[str]] | None = None,
            ) -> DataFrame:
    """0/1 column per category, without the first one in sorted order."""
    known = known or {c: list(v) for c, v in known_categories(df, cols).items()}
    coded = {f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
             for c in cols for v in known[c][1:]}
    return df.withColumns(coded).drop(*cols)
