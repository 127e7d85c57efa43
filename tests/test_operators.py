"""Operators against brute force on small frames, with skewed and missing values."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.functions.labels import percent_tenths
from riskloom.functions.text import date_text
from riskloom.operators import (clean, filters, metrics, profile, ranks, review, sampling, similar,
                                unions)


@pytest.fixture(scope="module")
def scored(spark):
    """600 rows: a third share one score and one cell; some traits are missing."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        if i % 3 == 0:
            rows.append((i, "activa", "nacional", 1, 5000, 0))
        else:
            rows.append((i, rnd.choice(["activa", "bloqueada", None]),
                         rnd.choice(["nacional", "internacional", None]),
                         rnd.choice([0, 1, 2, 3, 5, None]), rnd.randrange(0, 10001),
                         rnd.randrange(2)))
    return spark.createDataFrame(rows, "tx_id long, Estado_tarjeta string, Localizacion_tarjeta"
                                 " string, Cuotas_mora int, q int, fraude int").withColumn(
        "prediccion", (F.col("q") >= 5000).cast("int"))


def _alike(a, b):
    hits = sum(a[c] is not None and a[c] == b[c] for c in ("Estado_tarjeta",
                                                           "Localizacion_tarjeta"))
    if a.Cuotas_mora is not None and b.Cuotas_mora is not None:
        hits += abs(a.Cuotas_mora - b.Cuotas_mora) <= 1
    return a.tx_id != b.tx_id and abs(a.q - b.q) <= 1000 and hits >= 2


@pytest.fixture(scope="module")
def pairs(scored):
    rows = scored.collect()
    return {(a.tx_id, b.tx_id) for a in rows for b in rows if _alike(a, b)}


def test_similar_counts(scored, pairs):
    got = {r.tx_id: r.n_similares for r in similar.similar_counts(scored).collect()}
    assert len(got) == 600
    for tx_id, n in got.items():
        assert n == sum(a == tx_id for a, _ in pairs), tx_id


@pytest.mark.parametrize("few", [10_000, 0])
def test_similar_rows_broadcast_and_salted(scored, pairs, few):
    got = [tuple(r) for r in similar.similar_rows(scored, scored, broadcast_refs=few).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


@pytest.mark.parametrize("rows", [1, 60, 200])
def test_band_join_copies_a_reference_twice_at_most(scored, pairs, rows):
    got = [tuple(r) for r in similar.similar_rows(scored, scored, broadcast_refs=0, range_rows=rows).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    cuts = similar.band_cuts(scored, rows)
    assert len(cuts) >= 1 and all(b - a >= 2 * similar.BAND for a, b in zip(cuts, cuts[1:]))
    copies = similar.on_their_bands(scored, cuts).groupBy("tx_id").count()
    assert copies.agg({"count": "max"}).first()[0] == 2


def test_similar_one_and_preview(scored, pairs):
    want = sorted(b for a, b in pairs if a == 7)
    assert sorted(r.tx_id for r in similar.similar_to(scored, 7).collect()) == want
    refs = scored.filter("tx_id = 7")
    first = similar.first_similar(similar.similar_rows(scored, refs)).collect()
    assert [r.tx_id for r in sorted(first, key=lambda r: r.orden)] == want[:5]


def test_similar_without_probability(scored):
    rows = scored.drop("q", "prediccion")
    assert similar.similar_to(rows, 0).count() > similar.similar_to(scored, 0).count()


def test_auc_and_average_precision(spark, scored):
    rows = [(r.fraude, r.q) for r in scored.collect()]
    pos = [q for y, q in rows if y == 1]
    neg = [q for y, q in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(auc, abs=1e-12)
    ap, tp, k = 0.0, 0, 0
    for s in sorted({q for _, q in rows}, reverse=True):
        here = [y for y, q in rows if q == s]
        tp, k = tp + sum(here), k + len(here)
        ap += sum(here) * tp / k
    assert metrics.average_precision(scored).first()[0] == pytest.approx(ap / len(pos), abs=1e-12)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="fraude", numBins=0)
    assert evaluator.evaluate(scored.withColumn("s", F.col("q").cast("double"))) == pytest.approx(
        auc, abs=1e-9)


def test_curve_by_buckets_is_the_same(scored):
    raw = scored.withColumn("p", F.col("q") / 10000.0)
    a = sorted((round(r.umbral * 10000), r.tp, r.fp, r.pos, r.neg)
               for r in metrics.curve(raw, score="p", buckets=7).collect())
    b = sorted((r.umbral, r.tp, r.fp, r.pos, r.neg) for r in metrics.curve(scored).collect())
    assert a == b


def test_metrics_on_one_class_only(scored):
    none = scored.filter("fraude = 0")
    assert metrics.roc_auc(none).first()[0] is None
    report = {(r.clase, r.metrica): r.valor for r in metrics.classification_report(none).collect()}
    assert report["1", "recall"] == 0.0 and report["1", "support"] == 0.0


def test_document_equals_parts(scored):
    doc = metrics.metrics_document(scored).first()
    long = {(r.clase, r.metrica): r.valor for r in metrics.classification_report(scored).collect()}
    for (clase, metrica), value in long.items():
        cell = doc.classification_report[clase]
        assert (cell if clase == "accuracy" else cell[metrica]) == pytest.approx(value)
    assert doc.roc_auc == metrics.roc_auc(scored).first()[0]


def test_quantiles_are_linear(spark):
    values = [-7.5, -7.5, -0.001, 0.0, 0.0, 3.0, 1e-9, 8.25, 1e12, 2.0, None, float("nan")]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "a double, b double")
    got = {(r.columna, r.prob): r.quantile
           for r in ranks.quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    clean_values = sorted(v for v in values if v is not None and v == v)
    for col, vs in (("a", clean_values), ("b", [float(i) for i in range(len(values))])):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            pos = p * (len(vs) - 1)
            lo = int(pos)
            hi = min(lo + 1, len(vs) - 1)
            assert got[col, p] == pytest.approx(vs[lo] + (vs[hi] - vs[lo]) * (pos - lo))


def test_outliers_with_constant_column(spark):
    df = spark.createDataFrame([(i, 1 if i == 3 else 0, None) for i in range(20)],
                               "tx_id int, f int, g double")
    got = profile.flag_outliers(df, ["f", "g"]).filter("es_outlier").collect()
    assert [r.tx_id for r in got] == [3]


def test_deep_pages_equal_shallow_ones(spark):
    df = spark.range(0, 50_000, 3).withColumnRenamed("id", "tx_id")
    for number, size in ((1, 100), (2, 100), (167, 100), (168, 100), (1, 20_000)):
        got = [r.tx_id for r in ranks.rank_page(df, number, size).collect()]
        want = list(range(0, 50_000, 3))[(number - 1) * size:number * size]
        assert got == want


def test_run_page_is_clamped(spark):
    runs = spark.createDataFrame([(f"2024-01-{d:02d} 00:00:00", f"r{d}") for d in range(1, 26)],
                                 "fecha string, archivo string")
    for asked, page, first, n in ((1, 1, "r25", 10), (3, 3, "r5", 5), (99, 3, "r5", 5),
                                  (-2, 1, "r25", 10)):
        rows = sorted(filters.run_page(runs, asked).collect(), key=lambda r: r.numero)
        assert (rows[0].pagina, rows[0].archivo, len(rows)) == (page, first, n)
        assert [r.numero for r in rows] == list(range((page - 1) * 10 + 1,
                                                      (page - 1) * 10 + 1 + n))
    assert filters.run_page(runs.filter("false"), 1).count() == 0


def test_search(spark):
    df = spark.createDataFrame([(1, "Oro", None), (2, "plata", "x.y"), (3, None, "oROx")],
                               "n int, a string, b string")
    assert [r.n for r in filters.search(df, " oro ").collect()] == [1, 3]
    assert [r.n for r in filters.search(df, "^x.y$|3").collect()] == [2, 3]
    assert filters.search(df, "nan|null").count() == 0
    assert filters.search(df, "  ").count() == 3


def test_split_and_cap_counts(spark):
    df = spark.range(290_000).select(F.col("id").alias("tx_id"),
                                     (F.col("id") < 110_000).cast("int").alias("fraude"))
    kept = sampling.stratified_cap(df, 30_000).groupBy("fraude").count().collect()
    assert {r.fraude: r["count"] for r in kept} == {0: 18_620, 1: 11_379}
    assert sampling.stratified_cap(df, 400_000).count() == 290_000
    split = sampling.stratified_split(df.limit(1001)).groupBy("es_prueba").count().collect()
    assert {r.es_prueba: r["count"] for r in split} == {0: 700, 1: 301}


def test_noise_larger_than_a_class(spark):
    df = spark.range(1000).select(F.col("id").alias("tx_id"),
                                  (F.col("id") < 50).cast("int").alias("fraude"))
    audit = {(r.fraude_true, r.es_etiqueta_ruidosa): r.n
             for r in sampling.noise_audit(sampling.label_noise(df)).collect()}
    assert audit == {(0, 1): 100, (0, 0): 850, (1, 1): 50}


def test_correction_weight(spark):
    base = spark.range(29_999)
    errors = spark.range(200).withColumnRenamed("id", "tx_id")
    assert sampling.replicate_corrections(base, errors).count() == 2_800
    assert sampling.weigh_corrections(base, errors).select("peso").distinct().first().peso == 14
    few = sampling.weigh_corrections(spark.range(100), errors).select("peso").first().peso
    assert few == 5


def test_last_mark_wins_and_unknown_ids_are_ignored(spark):
    scored = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "tx_id long, prediccion int, fraude int")
    marks = spark.createDataFrame(
        [(1, "falso_positivo", 1), (1, "verdadero_positivo", 2), (9, "falso_positivo", 3)],
        "indice long, marcacion string, seq int")
    got = {r.tx_id: (r.marcacion_usuario, r.etiqueta_usuario)
           for r in review.apply_marks(scored, marks, ["seq"]).collect()}
    assert got == {1: ("verdadero_positivo", 1), 2: (None, None)}
    with pytest.raises(ValueError):
        review.mark_one(scored, marks, 9)


def test_review_share_can_pass_one_hundred(spark):
    df = spark.createDataFrame([("a", 1, 0, 1), ("a", 1, 1, 0), ("a", 0, 0, 0), ("b", 1, 1, None)],
                               "run_id string, fraude int, prediccion int, etiqueta_usuario int")
    got = {r.run_id: r for r in review.review_state(df, ["run_id"]).collect()}
    assert (got["a"].n_errores, got["a"].n_revisadas, got["a"].n_err_revisadas) == (1, 3, 1)
    assert got["a"].pct_revision == 300.0 and got["a"].revision_completa == 1
    assert got["b"].pct_revision == 0.0 and got["b"].revision_completa == 0


def test_percent_rounds_half_up(spark):
    rows = spark.createDataFrame([(189, 200), (29, 200), (1, 2000), (0, 0)], "n int, d int")
    got = [r[0] for r in rows.select(percent_tenths(F.col("n"), F.col("d"))).collect()]
    assert got == [94.5, 14.5, 0.1, 0.0]


def test_dates(spark):
    rows = spark.createDataFrame([("2026-08-15",), ("2026-08-15 10:11:12",), ("x",), ("",),
                                  (None,), ("2026-13-01",)], "d string")
    got = [r[0] for r in rows.select(date_text(F.col("d"))).collect()]
    assert got == ["2026-08-15", "2026-08-15"] + ["desconocido"] * 4


def test_required_columns_are_named(spark):
    with pytest.raises(clean.MissingColumns, match="Estado_tarjeta"):
        clean.require(spark.range(1).withColumnRenamed("id", "Tipo_tarjeta"))


def test_unlabelled_frames_are_refused(spark):
    df = spark.range(3)
    with pytest.raises(unions.NoGroundTruth):
        unions.errors_of(df)
    good, skipped = unions.usable_extras({"a": df, "b": None,
                                          "c": df.withColumn("fraude_true", F.lit(None))})
    assert skipped == ["a", "b"] and good[0].agg(F.sum("fraude")).first()[0] == 0


def test_imputation_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None), (4.0, "b"), (None, "a")],
                               "x double, t string")
    rows = {r.columna: r for r in profile.fill_values(df, ["x"], ["t"]).collect()}
    assert rows["x"].number == 2.5 and rows["t"].text == "a"
