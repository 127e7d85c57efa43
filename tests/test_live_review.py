"""The review state kept by a stream equals the one worked out from all rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.review import apply_marks, review_state
from riskloom.streaming import review as streaming
from riskloom.streaming.review import changed_marks, live_state, order_text, write_changes

LOG = "at long, seq long, indice long, marcacion string"
SCORED = "tx_id long, run_id string, fraude int, prediccion int, q int"


def marks(seed):
    pick = random.Random(seed)
    kinds = ["verdadero_positivo", "falso_positivo", "dudoso", None]
    out = [(pick.choice([None, -5, 0, 3, 10 ** 15, 7]), k, pick.choice([*range(60), 777, None]), pick.choice(kinds)) for k in range(300)]
    return out + out[:40]       # the same verdicts once more, in other files


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, f"r{i % 5}" if i % 11 else None, int(i % 3 == 0), int(i % 4 == 0), i) for i in range(80)]
    return spark.createDataFrame(rows, SCORED)


def run(spark, folder, scored):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    changes = changed_marks(stream, [F.col("at"), F.col("seq")])
    write_changes(changes, scored, f"{folder}/out", f"{folder}/progress").awaitTermination(300)
    return {tuple(r) for r in live_state(spark, scored, f"{folder}/out").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_batch_after_any_order_of_files(spark, folder, scored, seed):
    rows = marks(seed)
    random.Random(seed + 10).shuffle(rows)
    for start, end in ((0, 250), (250, 340)):       # the second time, the query goes on from its checkpoint
        spark.createDataFrame(rows[start:end], LOG).repartition(5).write.mode("append").parquet(f"{folder}/in")
        got = run(spark, folder, scored)
        known = spark.createDataFrame(rows[:end], LOG)
        batch = review_state(apply_marks(scored, known, ["at", "seq"]), ["run_id"])
        want = {tuple(r) for r in batch.where("run_id is not null").collect()}
        assert {g for g in got if g[0] is not None} == want
    assert run(spark, folder, scored) == got        # no new files, nothing moves


def test_a_batch_written_again_counts_once(spark, folder, scored):
    rows = [(1, k, k % 60, "falso_positivo") for k in range(100)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}/in")
    before = run(spark, folder, scored)
    spark.read.parquet(f"{folder}/out/batch=0").write.mode("append").parquet(f"{folder}/copy")
    spark.read.parquet(f"{folder}/copy").write.mode("overwrite").parquet(f"{folder}/out/batch=0")
    assert {tuple(r) for r in live_state(spark, scored, f"{folder}/out").collect()} == before


def test_state_is_kept_by_block(spark, folder, scored, monkeypatch):
    """A value for each transaction would mean a Python call for each of them, too."""
    monkeypatch.setattr(streaming, "BLOCKS", 4)
    rows = marks(3)
    spark.createDataFrame(rows, LOG).repartition(5).write.parquet(f"{folder}/in")
    got = run(spark, folder, scored)
    batch = review_state(apply_marks(scored, spark.createDataFrame(rows, LOG), ["at", "seq"]), ["run_id"])
    assert {g for g in got if g[0] is not None} == {tuple(r) for r in batch.where("run_id is not null").collect()}
    assert spark.read.format("statestore").load(f"{folder}/progress").count() <= 4


def test_order_text_sorts_like_the_columns(spark):
    values = [None, -(1 << 63), -(1 << 62), -1, 0, 1, 9, 10, (1 << 63) - 1]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in values for b in values)]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    want = [r.k for r in df.orderBy("a", "b").collect()]
    assert [r.k for r in df.orderBy(order_text([F.col("a"), F.col("b")])).collect()] == want
