"""Exact classification metrics as aggregations; every function takes optional groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.labels import ratio
from riskloom.operators.selection import placed, range_cuts
from riskloom.session import written

RAW_ROWS = 200_000       # distinct raw scores whose running sums one task works out


def confusion(df: DataFrame, by: list[str] = (), label: str = "fraude",
              prediction: str = "prediccion") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def confusion_report(df: DataFrame, by: list[str] = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(df, by).withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def confusion_matrix(df: DataFrame, label: str = "fraude",
                     prediction: str = "prediccion") -> DataFrame:
    """Rows are the truth, columns the prediction; an empty cell is 0."""
    table = df.groupBy(label).pivot(prediction, [0, 1]).count()
    return table.select(F.col(label).alias("real"),
                        *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}")
                          for c in (0, 1)])


def _report(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, dict[str, Column]]:
    """Classification report as expressions over the four confusion counts."""
    s0, s1 = tn + fp, tp + fn
    parts = {
        "precision": (ratio(tn, tn + fn), ratio(tp, tp + fp)),
        "recall": (ratio(tn, s0), ratio(tp, s1)),
        "f1-score": (ratio(2 * tn, 2 * tn + fn + fp), ratio(2 * tp, 2 * tp + fp + fn)),
    }
    out = {
        "0": {m: zero for m, (zero, _) in parts.items()} | {"support": s0},
        "1": {m: one for m, (_, one) in parts.items()} | {"support": s1},
        "macro avg": {m: (zero + one) / 2 for m, (zero, one) in parts.items()}
        | {"support": s0 + s1},
        "weighted avg": {m: ratio(zero * s0 + one * s1, s0 + s1)
                         for m, (zero, one) in parts.items()} | {"support": s0 + s1},
        "accuracy": {"accuracy": ratio(tp + tn, s0 + s1)},
    }
    return {c: {m: v.cast("double") for m, v in row.items()} for c, row in out.items()}


def _long(report: dict[str, dict[str, Column]]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(c).alias("clase"), F.lit(m).alias("metrica"), v.alias("valor"))
        for c, row in report.items() for m, v in row.items()])).alias("m")


def classification_report(df: DataFrame, by: list[str] = (), label: str = "fraude",
                          prediction: str = "prediccion") -> DataFrame:
    """Long rows ``(clase, metrica, valor)`` from the four confusion counts."""
    counts = confusion(df, by, label, prediction)
    rows = _long(_report(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))
    return counts.select(*by, rows).select(*by, "m.*")


def specificity(df: DataFrame, by: list[str] = ()) -> DataFrame:
    counts = confusion(df, by)
    return counts.select(*by, ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias(
        "especificidad"))


def curve(df: DataFrame, by: list[str] = (), label: str = "fraude", score: str = "q",
          buckets: int | None = None, prediction: str | None = None) -> DataFrame:
    """Cumulative counts at each distinct score, highest first: ``tp, fp, pos, neg`` and the
    counts ``p, n`` at the score itself; with a prediction also ``p1, n1``, those predicted 1.

    For whole-number scores the window runs over distinct scores, at most 10,001 per group for
    ``q``. Raw scores have no such bound: there the distinct scores are written once and cut into
    ranges of counted size wherever they lie, running sums work inside each range, and only the
    totals of ranges are summed in one place. ``buckets`` asks for that many ranges at least.
    """
    by = list(by)
    raw = buckets is not None or not isinstance(df.schema[score].dataType, T.IntegralType)
    y = F.col(label)
    counts = {"p": F.count_if(y == 1), "n": F.count_if(y == 0)}
    if prediction:
        counts |= {"p1": F.count_if((y == 1) & (F.col(prediction) == 1)),
                   "n1": F.count_if((y == 0) & (F.col(prediction) == 1))}
    at = df.groupBy(*by, F.col(score).alias("umbral")).agg(
        *[c.alias(name) for name, c in counts.items()]).withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    whole = W.partitionBy(*keys)
    if not raw:
        upto = W.partitionBy(*keys).orderBy(F.desc("umbral")).rowsBetween(
            W.unboundedPreceding, 0)
        return at.select(*by, "umbral", *counts, F.sum("p").over(upto).alias("tp"),
                         F.sum("n").over(upto).alias("fp"), F.sum("p").over(whole).alias("pos"),
                         F.sum("n").over(whole).alias("neg"))
    at = written(at, "scores")
    size = max(1, at.count() // buckets) if buckets else RAW_ROWS
    at = placed(at, "umbral", range_cuts(at, "umbral", size)).withColumnRenamed("_r", "_b")
    before = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select(
        *keys, "_b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("fp0"),
        F.sum("bp").over(whole).alias("pos"), F.sum("bn").over(whole).alias("neg"))
    inner = W.partitionBy(*keys, "_b").orderBy(F.desc("umbral")).rowsBetween(
        W.unboundedPreceding, 0)
    return at.join(sums, [*keys, "_b"]).select(
        *by, "umbral", *counts, (F.sum("p").over(inner) + F.col("tp0")).alias("tp"),
        (F.sum("n").over(inner) + F.col("fp0")).alias("fp"), "pos", "neg")


_WHOLE = "decimal(19,0)"


def _auc() -> Column:
    """Twice the area is summed in whole numbers, so that the order of rows cannot matter."""
    twice = F.sum(F.col("n").cast(_WHOLE) * (2 * F.col("tp") - F.col("p")).cast(_WHOLE))
    both = 2 * F.max("pos").cast(_WHOLE) * F.max("neg").cast(_WHOLE)
    return F.when(both > 0, twice.cast("double") / both.cast("double"))


def _ap() -> Column:
    """Precision times the recall gained at each score (steps, not trapezoids)."""
    gain = F.sum(F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return F.when(F.max("pos") > 0, gain / F.max("pos"))


def roc_auc(df: DataFrame, by: list[str] = (), label: str = "fraude", score: str = "q",
            buckets: int | None = None) -> DataFrame:
    return curve(df, by, label, score, buckets).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str] = (), label: str = "fraude",
                      score: str = "q", buckets: int | None = None) -> DataFrame:
    return curve(df, by, label, score, buckets).groupBy(*by).agg(_ap().alias("pr_auc"))


def areas(df: DataFrame, by: list[str] = (), label: str = "fraude", score: str = "q",
          buckets: int | None = None) -> DataFrame:
    """Both areas from one pass over the curve."""
    return curve(df, by, label, score, buckets).groupBy(*by).agg(
        _auc().alias("roc_auc"), _ap().alias("pr_auc"))


def roc_points(df: DataFrame, by: list[str] = (), label: str = "fraude", score: str = "q",
               buckets: int | None = None) -> DataFrame:
    return curve(df, by, label, score, buckets).select(
        *by, "umbral", ratio(F.col("tp"), F.col("pos")).alias("tpr"),
        ratio(F.col("fp"), F.col("neg")).alias("fpr"))


def pr_points(df: DataFrame, by: list[str] = (), label: str = "fraude", score: str = "q",
              buckets: int | None = None) -> DataFrame:
    return curve(df, by, label, score, buckets).select(
        *by, "umbral", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ratio(F.col("tp"), F.col("pos")).alias("recall"))


def metrics_document(df: DataFrame, by: list[str] = (), label: str = "fraude",
                     prediction: str = "prediccion", score: str = "q",
                     buckets: int | None = None) -> DataFrame:
    """One nested document per group: areas and the classification report as structs.

    The confusion counts ride along with the curve, so the rows are read and shuffled once.
    """
    sums = curve(df, by, label, score, buckets, prediction).groupBy(*by).agg(
        _auc().alias("roc_auc"), _ap().alias("pr_auc"), F.sum("p1").alias("tp"),
        F.sum("n1").alias("fp"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    tp, fp = F.col("tp"), F.col("fp")
    report = _report(tp, fp, F.col("neg") - fp, F.col("pos") - tp)
    nested = F.struct(*[
        row["accuracy"].alias(c) if c == "accuracy"
        else F.struct(*[v.alias(m) for m, v in row.items()]).alias(c)
        for c, row in report.items()])
    return sums.select(*by, "roc_auc", "pr_auc", nested.alias("classification_report"))


def metrics_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new value of each metric and their difference."""
    left = old.select(*keys, F.col("valor").alias("anterior"))
    right = new.select(*keys, F.col("valor").alias("nuevo"))
    return left.join(right, keys, "full_outer").withColumn(
        "delta", F.col("nuevo") - F.col("anterior"))
