"""Ranks and ranges of keys that lie anywhere, against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators import metrics, ranks, selection


def targets_of(wanted):
    def targets(sizes):
        return sizes.select(*[c for c in sizes.columns if c != "n"], F.explode(F.array(*[
            F.struct(F.lit(str(k)).alias("target"), F.lit(k).cast("long").alias("k")) for k in wanted])).alias("t")).select(
            *[c for c in sizes.columns if c != "n"], "t.target", "t.k")
    return targets


def shapes(whole):
    pick = random.Random(8)
    if whole:
        return {"sparse": [pick.getrandbits(64) - (1 << 63) for _ in range(3000)], "ends": [-(1 << 63), (1 << 63) - 1, 0, -1] * 30,
                "dense": [10 ** 15 + k for k in range(3000)], "one": [7] * 500,
                "clumps": [(1 << 62) + pick.randrange(50) for _ in range(2000)] + list(range(900))}
    return {"close": [1 + pick.random() * 2 ** -40 for _ in range(3000)], "wide": [pick.choice([-1, 1]) * 10 ** pick.uniform(-320, 308) for _ in range(2000)],
            "ends": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 20, "one": [0.25] * 500,
            "neighbours": [math.nextafter(1, 2), 1.0, math.nextafter(1, 0)] * 300}


@pytest.mark.parametrize("whole", [True, False])
def test_keys_at_ranks(spark, whole):
    data = shapes(whole)
    rows = [(name, v) for name, values in data.items() for v in values] + [("one", None)]
    kind = "long" if whole else "double"
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(6)
    wanted = [0, 1, 2, 60, 250, 499, 500, 1500, 3000, 5000]
    got = {(r["g"], int(r["target"])): r["v"] for r in selection.keys_at(df, ["g"], "v", targets_of(wanted), limit=16).collect()}
    want = {(g, k): sorted(values)[k - 1] for g, values in data.items() for k in wanted if 1 <= k <= len(values)}
    assert got == want


def test_last_group_is_bounded(spark):
    """A million distinct doubles inside one bucket of the first round."""
    df = spark.range(1_000_000).select((1 + F.col("id") / F.lit(1e9)).alias("v"))
    assert df.select(selection.value_bucket(F.col("v")).alias("b")).distinct().count() == 1
    rows = df.select(F.lit("a").alias("g"), F.col("v").alias("_v"), F.lit(1).cast("long").alias("_w"))
    _, found, _ = selection.narrowed(rows, ["g"], False, targets_of([1, 333_333, 1_000_000]), 1000)
    assert len(found) == 3 and all(r["_rows"] <= 1000 for r in found)
    got = {(r.columna, r.prob): r.quantile for r in ranks.quantiles(df, ["v"], [0.1, 0.5]).collect()}
    values = np.arange(1_000_000) / 1e9 + 1
    assert got == {("v", p): pytest.approx(np.quantile(values, p), abs=1e-15) for p in (0.1, 0.5)}


def test_weights_and_no_rows(spark):
    df = spark.createDataFrame([(5, 3), (2, 4), (9, 1), (None, 7), (2, 1)], "v int, w int")
    got = {int(r["target"]): r["v"] for r in selection.keys_at(df, [], "v", targets_of([1, 5, 6, 8, 9, 10]), F.col("w")).collect()}
    assert got == {1: 2, 5: 2, 6: 5, 8: 5, 9: 9}
    assert selection.keys_at(df.where("v > 99"), [], "v", targets_of([1])).count() == 0


@pytest.mark.parametrize("number", [1, 2, 17, 31])
def test_pages_of_random_ids(spark, number):
    ids = sorted(shapes(True)["sparse"])
    df = spark.createDataFrame([(i, str(i)) for i in ids], "tx_id long, t string").repartition(4)
    assert [r.tx_id for r in ranks.rank_page(df, number, 100).collect()] == ids[(number - 1) * 100:number * 100]


def test_page_sorts_no_more_than_the_limit(spark, monkeypatch):
    ids = spark.range(200_000).select(F.xxhash64("id").alias("tx_id"))
    spans = []
    inner = selection.narrowed

    def seen(*args):
        out = inner(*args[:-1], 500)
        spans.extend(out[1])
        return out

    monkeypatch.setattr(selection, "narrowed", seen)
    page = [r.tx_id for r in ranks.rank_page(ids, 1200, 100).collect()]
    assert all(r["_rows"] <= 500 for r in spans) and len(spans) == 2
    assert page == sorted(r.tx_id for r in ids.collect())[119_900:120_000]


def test_ranges_hold_what_they_should(spark):
    pick = random.Random(2)
    values = ([pick.random() * 1e-6 for _ in range(4000)] + [1 - pick.random() * 1e-9 for _ in range(4000)] + [0.5] * 1000
              + [10 ** pick.uniform(-300, 0) for _ in range(500)])
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    cuts = selection.range_cuts(df, "v", 100)
    assert cuts == sorted(set(cuts))
    groups = {r["_r"]: (r["n"], r["d"]) for r in selection.placed(df, "v", cuts).groupBy("_r").agg(
        F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
    assert groups.pop(-1) == (1, 0)
    assert groups.pop(len(cuts) + 1) == (1, 1)
    assert all(n <= 200 or d == 1 for n, d in groups.values()) and len(groups) == len(cuts) + 1
    for r in selection.placed(df.where("v = v"), "v", cuts).sample(0.05, 1).collect():
        assert r["_r"] == sum(c <= r["v"] for c in cuts)


@pytest.mark.parametrize("size", [50, 10_000])
def test_skewed_raw_scores(spark, monkeypatch, size):
    pick = random.Random(3)
    rows = [(pick.choice("ab"), pick.random() < 0.3, pick.choice([1e-7, 1e-5, 1]) * pick.randrange(900) / 900) for _ in range(4000)]
    df = spark.createDataFrame([(m, int(y), s) for m, y, s in rows], "m string, fraude int, s double").repartition(4)
    monkeypatch.setattr(metrics, "RAW_ROWS", size)
    got = {(r.m, r.umbral): (r.tp, r.fp, r.pos, r.neg) for r in metrics.curve(df, ["m"], score="s").collect()}
    want = {}
    for m in "ab":
        mine = [(s, y) for g, y, s in rows if g == m]
        for s in {s for s, _ in mine}:
            want[m, s] = (sum(y for t, y in mine if t >= s), sum(not y for t, y in mine if t >= s), sum(y for _, y in mine), sum(not y for _, y in mine))
    assert got == want
    areas = metrics.areas(df, ["m"], score="s")
    whole = metrics.areas(df.withColumn("rank", F.dense_rank().over(W.orderBy("s"))), ["m"], score="rank")
    assert {r.m: r.roc_auc for r in areas.collect()} == {r.m: r.roc_auc for r in whole.collect()}
