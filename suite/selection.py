"""Ranks, pages and curves of keys that lie close together or far apart."""

from pyspark.sql import functions as F

from riskloom.operators import metrics, ranks
from riskloom.sources import adapter
from suite.base import AP, AUC, query, sql_curve, view

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
PAGE, SIZE = 21, 50

# every value between 1 and 1.01, most of them distinct
view("narrow", """select 1 + l_extendedprice / cast(100000000 as double) as price,
    -1 - l_extendedprice * l_quantity / cast(1000000000000 as double) as worth from lineitem""")


def narrow_values(spark, sf_dir):
    price, units = F.col("l_extendedprice"), F.col("l_quantity")
    return adapter.table(spark, sf_dir, "lineitem").select(
        (1 + price / F.lit(1e8)).alias("price"), (-1 - price * units / F.lit(1e12)).alias("worth"))


@query(" union all ".join(f"select '{c}' as columna, cast({p} as double) as prob,"
                          f" round(quantile_cont({c}, {p}), 12) as quantile from narrow"
                          for c in ("price", "worth") for p in PROBS), "narrow")
def narrow_quantiles(spark, sf_dir):
    return ranks.quantiles(narrow_values(spark, sf_dir), ["price", "worth"], PROBS).withColumn(
        "quantile", F.round("quantile", 12))


# ids of 60 bits that leave most of their range empty
view("hashed", """select cast('0x' || substr(md5(cast(tx_id as varchar)), 1, 15) as bigint) as tx_id,
    q, tx_id as source_id from scored""", "scored")


@query(f"select tx_id, q, source_id from hashed order by tx_id limit {SIZE} offset {(PAGE - 1) * SIZE}", "hashed")
def sparse_page(spark, sf_dir):
    hashed = F.conv(F.substring(F.md5(F.col("tx_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = adapter.scored_tx(spark, sf_dir).select(hashed.alias("tx_id"), "q", F.col("tx_id").alias("source_id"))
    return ranks.rank_page(rows, PAGE, SIZE)


# raw scores of which nine in ten lie under 1e-4
view("raw_scored", """select run_id, fraude, case when tx_id % 10 = 0 then q / cast(10000 as double)
    else q / cast(1000000000 as double) + tx_id % 997 / cast(10000000000000 as double) end as q
  from scored""", "scored")
view("raw_curve", sql_curve("raw_scored", "run_id"), "raw_scored")


@query(f"select run_id, round({AUC}, 9) as roc_auc, round({AP}, 6) as pr_auc from raw_curve group by run_id", "raw_curve")
def raw_areas(spark, sf_dir):
    key, q = F.col("tx_id"), F.col("q")
    score = F.when(key % 10 == 0, q / F.lit(1e4)).otherwise(q / F.lit(1e9) + key % 997 / F.lit(1e13))
    rows = adapter.scored_tx(spark, sf_dir).select("run_id", "fraude", score.alias("score"))
    return metrics.areas(rows, ["run_id"], score="score").select(
        "run_id", F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))
