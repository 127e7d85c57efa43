"""Exact order statistics without sorting the whole table in one task.

Rows are first counted per coarse, order-preserving bucket. A running sum over the few bucket
rows tells which bucket holds a wanted rank, and only the rows of that bucket are ordered.
The answer is a key value, so the caller filters the wide table by comparison and never
shuffles it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.operators.selection import keys_at

HASH_PREFIX = 5          # 16**5 buckets: about a million rows each at a trillion rows


def keys_at_ranks(df: DataFrame, by: list[str], key: list[str], bucket: Column,
                  targets: Callable[[DataFrame], DataFrame],
                  weight: Column | None = None) -> DataFrame:
    """Key of the row at each wanted rank (1-based), per group ``by``.

    ``targets`` gets one row per group with its total ``n`` and returns rows
    ``(*by, target, k)``; there must be few of them, as they are broadcast. Ranks outside
    1..n give no row. ``weight`` counts a row several times.
    """
    keyed = df.select(*by, *key, bucket.alias("_bucket"),
                      (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_n"))
    running = sizes.withColumn(
        "_upto", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")))
    wanted = targets(sizes.groupBy(*by).agg(F.sum("_n").alias("n")))
    picks = (running.join(F.broadcast(wanted), by)
             .filter((F.col("_upto") - F.col("_n") < F.col("k")) & (F.col("k") <= F.col("_upto")))
             .select(*by, "target", "_bucket",
                     (F.col("k") - F.col("_upto") + F.col("_n")).alias("_need")))
    inside = keyed.join(F.broadcast(picks), [*by, "_bucket"])
    order = W.partitionBy(*by, "target").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)
    return (inside.withColumn("_cum", F.sum("_w").over(order))
            .filter((F.col("_cum") >= F.col("_need"))
                    & (F.col("_cum") - F.col("_w") < F.col("_need")))
            .select(*by, "target", *key))


def one_group(col: str) -> Column:
    """0 on every row, but not a constant: a constant key would turn the joins on it into
    nested loops."""
    return F.least(F.length(F.col(col).cast("string")), F.lit(0))


def hash_order(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random order of the rows, the same on every engine with md5."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def mark_first_by_hash(df: DataFrame, by: str, id_col: str, seed: int, flag: str,
                       quota: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``flag``: 1 for the first k rows of each class in hash order.

    ``by`` is a class column with few values. ``quota`` turns class sizes ``(by, n)`` into
    ``(by, k)``. The wide rows are compared with one cut per class; they are not shuffled.
    """
    def as_targets(sizes: DataFrame) -> DataFrame:
        return quota(sizes).select(by, F.lit("cut").alias("target"), F.col("k"))

    hashed = df.withColumn("_hash", hash_order(id_col, seed))
    cuts = keys_at_ranks(hashed, [by], ["_hash", id_col],
                         F.substring("_hash", 1, HASH_PREFIX), as_targets)
    cuts = cuts.select(by, F.col("_hash").alias("_cut"), F.col(id_col).alias("_cut_id"))
    inside = (F.col("_hash") < F.col("_cut")) | (
        (F.col("_hash") == F.col("_cut")) & (F.col(id_col) <= F.col("_cut_id")))
    return (hashed.join(F.broadcast(cuts), by, "left")
            .withColumn(flag, F.coalesce(inside, F.lit(False)).cast("int"))
            .select(*df.columns, flag))


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values in long form ``(columna, value)``; NaN and null drop."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.nanvl(F.col(c).cast("double"), F.lit(None))
                 .alias("value")) for c in cols])).alias("p")
    return df.select(pairs).select("p.*").filter("value is not null")


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles, rows ``(columna, prob, quantile)``.

    Each value is counted where it lies; only the few values around a quantile are ever sorted.
    """
    def as_targets(sizes: DataFrame) -> DataFrame:
        wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
        pos = sizes.select("columna", "n", wanted).withColumn(
            "_pos", (F.col("n") - 1) * F.col("prob"))
        sides = F.explode(F.array(
            F.struct(F.lit("lo").alias("side"), F.floor("_pos").alias("r")),
            F.struct(F.lit("hi").alias("side"), F.ceil("_pos").alias("r")))).alias("s")
        return pos.select("columna", "prob", "_pos", sides).select(
            "columna",
            F.struct("prob", (F.col("_pos") - F.floor("_pos")).alias("frac"),
                     F.col("s.side").alias("side")).alias("target"),
            (F.col("s.r") + 1).alias("k"))

    at = keys_at(column_values(df, cols), ["columna"], "value", as_targets)
    ends = at.groupBy("columna", F.col("target.prob").alias("prob")).agg(
        F.max("target.frac").alias("frac"),
        F.max(F.when(F.col("target.side") == "lo", F.col("value"))).alias("lo"),
        F.max(F.when(F.col("target.side") == "hi", F.col("value"))).alias("hi"))
    return ends.select("columna", "prob", (F.col("lo") + (F.col("hi") - F.col("lo"))
                                           * F.col("frac")).alias("quantile"))


def rank_page(df: DataFrame, page: int, size: int, id_col: str = "tx_id") -> DataFrame:
    """Rows of one page by id, found by id cuts: neither the depth of the page nor the spread of the
    ids costs anything extra."""
    first, last = (page - 1) * size, page * size

    def as_targets(sizes: DataFrame) -> DataFrame:
        ends = F.explode(F.array(
            F.struct(F.lit("after").alias("t"), F.lit(first).cast("long").alias("k")),
            F.struct(F.lit("upto").alias("t"),
                     F.least(F.lit(last).cast("long"), F.col("n")).alias("k")))).alias("e")
        return sizes.select("_all", ends).select("_all", F.col("e.t").alias("target"), "e.k")

    cuts = keys_at(df, [], id_col, as_targets)
    bounds = cuts.agg(F.max(F.when(F.col("target") == "after", F.col(id_col))).alias("a"),
                      F.max(F.when(F.col("target") == "upto", F.col(id_col))).alias("b"))
    rows = df.filter(F.col(id_col) <= bounds.select("b").scalar())
    if first > 0:
        rows = rows.filter(F.col(id_col) > bounds.select("a").scalar())
    return rows.orderBy(id_col)
