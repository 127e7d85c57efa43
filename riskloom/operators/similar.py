"""Similar transactions: close probability and at least two of three matching traits.

Probabilities are compared as whole numbers of 1/10,000 (column ``q``), so the edges of the
band are exact. The traits are card state, location, and overdue instalments within one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators.selection import placed

BAND = 1000              # 0.10
BROADCAST_REFS = 10_000  # reference rows that may be sent to every executor
RANGE_ROWS = 1_000_000   # rows from which a range of probabilities is cut off

STATE, PLACE, DUE = "Estado_tarjeta", "Localizacion_tarjeta", "Cuotas_mora"


def traits_shared(a: str, b: str) -> Column:
    """How many of the three traits two aliased rows share; a null shares nothing."""
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in (STATE, PLACE)]
    same.append(F.abs(F.col(f"{a}.{DUE}") - F.col(f"{b}.{DUE}")) <= 1)
    total = F.lit(0)
    for match in same:
        total = total + F.coalesce(match, F.lit(False)).cast("int")
    return total


def similar_to(df: DataFrame, tx_id: int, id_col: str = "tx_id") -> DataFrame:
    """Rows similar to one row. Without a ``q`` column the band is not applied."""
    cols = [c for c in (STATE, PLACE, DUE, "q") if c in df.columns]
    ref = df.filter(F.col(id_col) == tx_id).select(F.struct(*cols).alias("r"))
    near = df.withColumn("_r", ref.scalar()).alias("t").filter(F.col(id_col) != tx_id)
    hits = F.lit(0)
    for c in cols:
        if c == "q":
            continue
        match = (F.abs(F.col(c) - F.col(f"_r.{c}")) <= 1) if c == DUE else (
            F.col(c) == F.col(f"_r.{c}"))
        hits = hits + F.coalesce(match, F.lit(False)).cast("int")
    if "q" in cols:
        near = near.filter(F.abs(F.col("q") - F.col("_r.q")) <= BAND)
    return near.filter(hits >= 2).drop("_r")


def band_cuts(df: DataFrame, rows: int = RANGE_ROWS) -> list[float]:
    """Starts of ranges of ``q`` that are two bands wide or wider and hold ``rows`` rows or more.

    Rows are counted per band width; the driver gets one count for each, eleven for probabilities.
    """
    cells = df.where("q is not null").groupBy(F.floor(F.col("q") / BAND).alias("cell")).count().collect()
    cuts, start, held = [], None, 0
    for cell, n in sorted((r["cell"], r["count"]) for r in cells):
        if start is None or (held >= rows and cell - start >= 2):
            cuts, start, held = [*cuts, float(cell * BAND)], cell, 0
        held += n
    return cuts[1:]


def on_their_bands(refs: DataFrame, cuts: list[float]) -> DataFrame:
    """References copied to each range that their band touches. A range is at least as wide as a
    band, so those are two at most."""
    ends = refs.withColumns({"_low": F.col("q") - BAND, "_high": F.col("q") + BAND})
    low = placed(ends, "_low", cuts).withColumnRenamed("_r", "_first")
    high = placed(low, "_high", cuts).withColumnRenamed("_r", "_last")
    return high.withColumn("_r", F.explode(F.sequence("_first", "_last"))).drop("_low", "_high", "_first", "_last")


def similar_rows(df: DataFrame, refs: DataFrame, id_col: str = "tx_id",
                 broadcast_refs: int = BROADCAST_REFS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pairs ``(ref_id, tx_id)`` for a set of reference rows.

    Few references are broadcast, each to its bucket of probabilities and both neighbours. More of
    them go through a band join over ranges cut where the counted rows are: a row lies in one range, a
    reference in two at most, and adaptive execution splits the rows of a range that is large.
    """
    cols = [id_col, STATE, PLACE, DUE, "q"]
    left, right = (side.select(*cols).where("q is not null") for side in (df, refs))
    if refs.select(id_col).limit(broadcast_refs + 1).count() <= broadcast_refs:
        left = left.withColumn("_r", F.floor(F.col("q") / BAND))
        right = F.broadcast(right.withColumn("_r", F.explode(F.array(*[
            F.floor(F.col("q") / BAND) + d for d in (-1, 0, 1)]))))
    else:
        cuts = band_cuts(left, range_rows)
        left, right = placed(left, "q", cuts), on_their_bands(right, cuts)
    t, r = left.alias("t"), right.alias("r")
    on = ((F.col("t._r") == F.col("r._r")) & (F.abs(F.col("t.q") - F.col("r.q")) <= BAND)
          & (F.col(f"t.{id_col}") != F.col(f"r.{id_col}")) & (traits_shared("t", "r") >= 2))
    return t.join(r, on).select(F.col(f"r.{id_col}").alias("ref_id"), F.col(f"t.{id_col}"))


def first_similar(pairs: DataFrame, id_col: str = "tx_id", first: int = 5) -> DataFrame:
    """Preview: the first rows per reference. Spark cuts each task to ``first`` per reference
    before the shuffle (window group limit), so a reference with many matches is no hot group."""
    order = W.partitionBy("ref_id").orderBy(id_col)
    return pairs.withColumn("orden", F.row_number().over(order)).filter(F.col("orden") <= first)


def similar_counts(df: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """Number of similar rows for every row, without building one pair.

    Rows are counted per (state, place, due, q). Rows sharing at least two traits are
    |sp| + |sd| + |pd| - 2 |spd|, and the band is a difference of two running sums over q.
    The work after the first aggregation depends on the number of distinct cells only.
    """
    cell = [STATE, PLACE, DUE, "q"]
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"))
    s, p, d, q = (F.col(c) for c in cell)

    def entry(kind: str, due: Column, at: Column, turn: int, n: Column, factor: int) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(F.lit("s" in kind), s).alias("a"), F.when(F.lit("p" in kind), p).alias("b"),
            F.when(F.lit("d" in kind), due).cast("long").alias("c"),
            at.cast("long").alias("at"), F.lit(turn).alias("turn"), n.cast("long").alias("m"),
            F.lit(factor).alias("factor"))

    entries = []
    for kind, factor in (("sp", 1), ("sd", 1), ("pd", 1), ("spd", -2)):
        known = F.lit(True)
        for letter, trait in (("s", s), ("p", p), ("d", d)):
            if letter in kind:
                known = known & trait.isNotNull()
        # the cell is seen from three neighbouring due values, and asks at both ends of its band
        rows = [entry(kind, d + step, q, 0, F.col("n"), 0)
                for step in ((-1, 0, 1) if "d" in kind else (0,))]
        rows += [entry(kind, d, q + BAND, 1, F.lit(0), factor),
                 entry(kind, d, q - BAND - 1, 1, F.lit(0), -factor)]
        entries.append(F.when(known, F.array(*rows)).otherwise(F.array()))
    line = cells.select(*cell, F.explode(F.flatten(F.array(*entries))).alias("e")).select(
        *cell, "e.*")
    running = F.sum("m").over(W.partitionBy("kind", "a", "b", "c").orderBy("at", "turn")
                              .rowsBetween(W.unboundedPreceding, 0))
    per_cell = (line.withColumn("upto", running).filter("turn = 1").groupBy(*cell)
                .agg(F.sum(F.col("factor") * F.col("upto")).alias("near")))

    left = df.select(id_col, *cell).alias("t")
    right = per_cell.alias("c")
    on = F.lit(True)
    traits = F.lit(0)
    for c in cell:
        on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}"))
        if c != "q":
            traits = traits + F.col(f"t.{c}").isNotNull().cast("int")
    # a row is near itself as soon as two of its traits are known
    near = F.coalesce(F.col("c.near"), F.lit(0)) - (traits >= 2).cast("int")
    return left.join(right, on, "left").select(F.col(f"t.{id_col}"),
                                               near.cast("long").alias("n_similares"))
