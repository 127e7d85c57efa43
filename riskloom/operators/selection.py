"""Keys at wanted ranks and even ranges of keys, found by counting in rounds.

A round counts rows in buckets that keep the order of the keys. Doubles start with 64 buckets a power
of two, whole numbers with their top bits. Where a bucket that matters still holds more than ``limit``
rows of different keys, the next round divides the span between its least and its largest key again, so
each round takes a span to a 4096th or less: six rounds end at single keys wherever they lie, and one or
two are the rule. Every round is one aggregation that combines inside each task; only bucket counts are
shuffled, and the one group that is sorted in the end has at most ``limit`` rows.
"""

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 100_000
BITS = 12
TOP = 52             # bits of a whole number that the first round leaves to the others


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: 64 steps per power of two, for both signs."""
    step, offset = 64, 64 * 1100
    size = F.abs(value)
    up = F.when(size == float("inf"), 2 * offset).otherwise(
        F.floor(F.log2(F.when(size < float("inf"), size)) * step).cast("long") + offset)
    return F.when(value > 0, up).when(value < 0, -up).otherwise(F.lit(0).cast("long"))


def is_whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.IntegralType)


def _first(whole: bool) -> Column:
    return F.shiftright("_v", TOP) if whole else value_bucket(F.col("_v"))


def _inner(whole: bool) -> Column:
    """Bucket between the least key ``_lo`` and the largest key ``_hi``, which never share one."""
    if whole:
        return F.expr("shiftright(_v - _lo, _shift)")
    part = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return F.least(F.floor(part * (1 << BITS)), F.lit((1 << BITS) - 1))


def _counted(rows: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    return rows.groupBy(*by, bucket.alias("_b")).agg(
        F.sum("_w").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def narrowed(rows: DataFrame, by: list[str], whole: bool,
             targets: Callable[[DataFrame], DataFrame], limit: int = LIMIT) -> tuple[DataFrame, list, T.StructType]:
    """The span that holds each wanted rank: rows ``(*by, target, _lo, _hi, _need, _rows)``.

    ``_need`` is the rank inside the span. A span holds one key or at most ``limit`` rows.
    """
    sizes = _counted(rows, by, _first(whole))
    upto = F.sum("_n").over(W.partitionBy(*by).orderBy("_b"))
    wanted = targets(sizes.groupBy(*by).agg(F.sum("_n").alias("n")))
    inside = (F.col("_upto") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_upto"))
    columns = [*by, "target", "_lo", "_hi", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_rows"]
    picks = (sizes.withColumn("_upto", upto).join(F.broadcast(wanted.withColumnRenamed("k", "_need")), by)
             .where(inside).select(*columns))
    kind, found = picks.schema, picks.collect()
    while wide := [r for r in found if r["_lo"] != r["_hi"] and r["_rows"] > limit]:
        spans = _spans(rows, wide, kind, whole)
        parts = rows.join(F.broadcast(spans), by).where("_v between _lo and _hi").withColumnsRenamed(
            {"_lo": "_from", "_hi": "_to"})
        bucket = _inner(whole)
        parts = parts.withColumns({"_lo": F.col("_from"), "_hi": F.col("_to")}).withColumn("_b", bucket).drop("_lo", "_hi")
        group = [*by, "target"]
        counts = _counted(parts, [*group, "_need"], F.col("_b"))
        upto = F.sum("_n").over(W.partitionBy(*group).orderBy("_b"))
        more = counts.withColumn("_upto", upto).where(inside).select(*columns).collect()
        found = [r for r in found if r["_lo"] == r["_hi"] or r["_rows"] <= limit] + more
    return _spans(rows, found, kind, whole), found, kind


def _spans(rows: DataFrame, found: list, kind: T.StructType, whole: bool) -> DataFrame:
    spans = rows.sparkSession.createDataFrame([tuple(r) for r in found], kind)
    if not whole:
        return spans
    shift = {r["_hi"] - r["_lo"]: max(0, (r["_hi"] - r["_lo"]).bit_length() - BITS) for r in found}
    out = F.lit(0)
    for gap, bits in shift.items():
        out = F.when(F.col("_hi") - F.col("_lo") == gap, bits).otherwise(out)
    return spans.withColumn("_shift", out) if any(shift.values()) else spans.withColumn("_shift", F.lit(0))


def keys_at(df: DataFrame, by: list[str], key: str, targets: Callable[[DataFrame], DataFrame],
            weight: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """Key of the row at each wanted rank (1-based) of each group: ``(*by, target, key)``.

    ``targets`` gets ``(*by, n)`` and returns ``(*by, target, k)``, of which there are few; ranks
    outside 1..n give no row. Null keys and NaN have no rank. ``weight`` counts a row several times.
    """
    whole = is_whole(df, key)
    value = F.col(key).cast("long") if whole else F.nanvl(F.col(key).cast("double"), F.lit(None))
    rows = df.select(*by, value.alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w")).where(
        "_v is not null")
    groups = list(by)
    if not groups:
        # 0 on every row, but not a constant: a constant key would turn joins into nested loops
        rows, groups = rows.withColumn("_all", F.pmod(F.hash("_v"), F.lit(1))), ["_all"]
    spans, _, _ = narrowed(rows, groups, whole, targets, limit)
    one = spans.where("_lo = _hi").select(*by, "target", F.col("_lo").alias(key))
    order = W.partitionBy(*groups, "target").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    rest = (rows.join(F.broadcast(spans.where("_lo < _hi")), groups).where("_v between _lo and _hi")
            .groupBy(*groups, "target", "_need", "_v").agg(F.sum("_w").alias("_w"))
            .withColumn("_upto", F.sum("_w").over(order))
            .where("_upto >= _need and _upto - _w < _need").select(*by, "target", F.col("_v").alias(key)))
    return one.unionByName(rest)


def range_cuts(df: DataFrame, key: str, size: int) -> list[float]:
    """Ascending keys that cut the rows into ranges of at most ``2 * size`` rows, or of one key.

    Buckets above ``size`` rows are divided in rounds, then neighbours are put together. The driver
    holds the first round's buckets (140,802 at most, a few thousand in practice) and about six counts
    for every ``size`` rows.
    """
    rows = df.select(F.nanvl(F.col(key).cast("double"), F.lit(None)).alias("_v"), F.lit(1).cast("long").alias("_w")
                     ).where("_v is not null")
    leaves = sorted((r["_lo"], r["_hi"], r["_rows"]) for r in _counted(rows, [], _first(False)).collect())
    while wide := {i: leaf for i, leaf in enumerate(leaves) if leaf[2] > size and leaf[0] < leaf[1]}:
        parts = {i: min(1 << BITS, 4 * -(-n // size)) for i, (_, _, n) in wide.items()}
        spans = df.sparkSession.createDataFrame([(i, lo, hi, parts[i]) for i, (lo, hi, _) in wide.items()],
                                                "_r int, _lo double, _hi double, _parts int")
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts")),
                        F.col("_parts") - 1)
        inside = placed(rows, "_v", [lo for lo, _, _ in leaves[1:]]).join(F.broadcast(spans), "_r")
        counts = _counted(inside.withColumn("_p", place).drop("_lo", "_hi"), ["_r"], F.col("_p")).collect()
        leaves = sorted([leaf for i, leaf in enumerate(leaves) if i not in wide]
                        + [(r["_lo"], r["_hi"], r["_rows"]) for r in counts])
    cuts, held = [], 0
    for lo, _, n in leaves:
        if held and held + n > size:
            cuts.append(lo)
            held = 0
        held += n
    return cuts


def placed(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    """``df`` with ``_r``, the number of cuts at or below the key; NaN is above all, null is -1."""
    if not cuts:
        return df.withColumn("_r", F.when(F.col(key).isNull(), -1).when(F.isnan(F.col(key).cast("double")), 1).otherwise(0))
    inf = float("inf")
    sorter = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_key", outputCol="_place", handleInvalid="keep")
    out = sorter.transform(df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("nan")))))
    return out.withColumn("_r", F.when(F.col(key).isNull(), -1).otherwise(F.col("_place")).cast("int")).drop("_key", "_place")
