"""Review state of every run, kept up to date from a stream of verdicts.

``operators.review`` works the state out from all rows. Here a verdict costs work for its own row only:

1. ``changed_marks``: a stateful stream keeps the last verdict of each transaction, by the given order,
   and passes on (old, new) where a file of verdicts changes it. Late and repeated verdicts lose against
   a later one that is already known, in whatever order files come.
2. ``write_changes``: each micro-batch finds the run of the changed transactions in the scored rows and
   stores how much the counts of each run move. A batch that Spark runs again after a failure writes the
   same folder again, so nothing counts twice.
3. ``live_state``: the counts of the runs plus the sum of their moves, the columns of ``review_state``.

State is one value for each of ``BLOCKS`` blocks, to which transactions with a verdict are dealt by a
hash of their id: a Python call and a state value for each transaction would cost far more than the
verdicts themselves. A block that gets a verdict is read and written as a whole, so a batch costs its
verdicts and the blocks that they touch. Verdicts on unknown ids change nothing, and verdicts without
an id are left out.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.labels import mark_label
from riskloom.operators.review import error_flag, review_columns

CHANGES = "tx_id long, old string, new string"
MOVES = "n_revisadas long, n_err_revisadas long"
#: Part of the state's layout: a checkpoint is only good for the number that it began with.
BLOCKS = 1 << 14
_BLOCK = pa.schema([("tx_id", pa.int64()), ("place", pa.string()), ("mark", pa.string())])


def order_text(order: list[Column]) -> Column:
    """One text that sorts like the columns: numbers and times at full width, nulls first."""
    def wide(c: Column) -> Column:
        above = c.cast("long").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
        return F.lpad(F.coalesce(above.cast("string"), F.lit("")), 20, "0")

    return F.concat_ws("|", *[F.when(c.isNull(), F.lpad(F.lit(""), 20, " ")).otherwise(wide(c)) for c in order])


def changed_marks(feedback: DataFrame, order: list[Column], id_col: str = "indice") -> DataFrame:
    """(tx_id, old, new) whenever the last verdict of a transaction changes. ``order`` tells which of
    two verdicts is later and has to tell them apart: whole numbers, or times to the microsecond."""
    rows = feedback.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("tx_id"), F.col("marcacion").alias("mark"), order_text(order).alias("place"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("tx_id"), F.lit(BLOCKS)))
    return dealt.groupBy("block").applyInPandasWithState(
        _last, CHANGES, "marks binary", "update", GroupStateTimeout.NoTimeout)


def _last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps (place, mark) of the last verdict of each transaction of a block."""
    known = _unpacked(state.get[0]) if state.exists else {}
    before = {}
    for frame in frames:
        for tx, place, mark in zip(frame["tx_id"].tolist(), frame["place"].tolist(), frame["mark"].tolist()):
            best, old = known.get(tx, (None, None))
            if best is None or place >= best:
                before.setdefault(tx, old)
                known[tx] = (place, mark)
    if before:
        state.update((_packed(known),))
    changed = [(tx, old, known[tx][1]) for tx, old in before.items() if known[tx][1] != old]
    if changed:
        yield pd.DataFrame(changed, columns=["tx_id", "old", "new"])


def _packed(known: dict) -> bytes:
    places, marks = zip(*known.values())
    columns = [pa.array(c, kind, from_pandas=True) for c, kind in zip((list(known), places, marks), _BLOCK.types)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_BLOCK))
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict:
    ids, places, marks = (c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns)
    return dict(zip(ids, zip(places, marks)))


def moves(changes: DataFrame, scored: DataFrame, run: str = "run_id") -> DataFrame:
    """How the counts of each run move. The narrow scored rows are read once a batch; adaptive
    execution broadcasts the changes where they are few."""
    step = (mark_label(F.col("new")).isNotNull().cast("long") - mark_label(F.col("old")).isNotNull().cast("long"))
    known = scored.select("tx_id", run, error_flag().alias("wrong"))
    return (changes.select("tx_id", step.alias("step")).where("step <> 0").join(known, "tx_id")
            .groupBy(run).agg(F.sum("step").alias("n_revisadas"),
                              F.sum(F.when(F.col("wrong"), F.col("step")).otherwise(0)).alias("n_err_revisadas")))


def write_changes(changes: DataFrame, scored: DataFrame, sink: str, progress: str, run: str = "run_id"):
    """Starts the query over all files that are there; ``sink`` and ``progress`` lie on shared storage."""
    def store(batch: DataFrame, number: int) -> None:
        moves(batch, scored, run).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (changes.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", progress).trigger(availableNow=True).start())


def live_state(spark: SparkSession, scored: DataFrame, sink: str, run: str = "run_id") -> DataFrame:
    """``review_state`` of every run, without a look at any verdict."""
    errors = scored.groupBy(run).agg(F.count_if(error_flag()).alias("n_errores"))
    kind = scored.select(run).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    moved = spark.read.schema(f"{kind}, {MOVES}").parquet(f"{sink}/batch=*").groupBy(run).agg(
        F.sum("n_revisadas").alias("n_revisadas"), F.sum("n_err_revisadas").alias("n_err_revisadas"))
    zero = F.lit(0).cast("long")
    counts = errors.join(moved, run, "left").select(run, "n_errores", *[
        F.coalesce(c, zero).alias(c) for c in ("n_revisadas", "n_err_revisadas")])
    return review_columns(counts)
