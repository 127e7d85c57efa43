"""Plan shapes: what must not appear in them at scale."""

import pytest

import __spark_entry__ as entry
from riskloom.operators import metrics, profile, sampling
from riskloom.sources import adapter


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas",
                 "ArrowEval", "BatchEvalPython", "FlatMapGroups"):
        assert word not in text, word


def test_columns_are_pruned(spark, sf_dir):
    text = plan(adapter.card_tx(spark, sf_dir).select("tx_id", "Cuotas_mora"))
    assert "o_totalprice" not in text and "l_extendedprice" not in text
    assert "PushedFilters: [Or(EqualTo(l_linestatus,F),EqualTo(l_returnflag,R))" in text


def test_rows_are_counted_before_they_are_moved(spark, sf_dir):
    """Going up from a scan, a partial aggregate comes before any exchange of rows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as tx_id", "cast(o_orderkey % 2 as int) as fraude",
        "cast(o_orderkey % 10001 as int) as q")
    for df in (metrics.curve(rows), metrics.metrics_document(rows, prediction="fraude"),
               profile.iqr_fences(rows, ["q"]), profile.category_counts(rows, ["q"])):
        text = plan(df)
        tree = text[:text.index("\n\n\n")].splitlines()
        scans = [i for i, line in enumerate(tree) if "Scan parquet" in line]
        above = [next((line for line in reversed(tree[:i]) if " Exchange" in line
                       or "HashAggregate" in line or "BroadcastHashJoin" in line), "")
                 for i in scans]
        assert above and not any(" Exchange" in line for line in above)


def test_samples_do_not_shuffle_the_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "*", "o_orderkey as tx_id", "cast(o_orderkey % 2 as int) as fraude")
    text = plan(sampling.stratified_split(rows))
    tree = text[:text.index("\n\n\n")].splitlines()
    scan = next(i for i, line in enumerate(tree) if "Scan parquet" in line)
    assert not any("Exchange" in line for line in tree[:scan])


@pytest.mark.parametrize("name", ["similar_preview", "error_rows"])
def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, sf_dir))
