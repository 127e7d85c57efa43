"""Adapter, profile, projection, filter and label queries."""

from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions import labels, text
from riskloom.operators import clean, filters, profile
from riskloom.plans import reports
from riskloom.sources import adapter, files
from riskloom.session import scratch_path
from suite.base import (FEATURES, RULES, dates_as_text, hundredths, long, query, r6, tenths,
                        view)

_DATES = ("* replace (strftime(Fecha_vencimiento, '%Y-%m-%d') as Fecha_vencimiento,"
          " strftime(Fecha_ult_retiro, '%Y-%m-%d') as Fecha_ult_retiro)")
_FEATURES = ", ".join(FEATURES)
_CATEGORICAL = [c for c in schema.TEXT_FEATURES
                if c in FEATURES and c not in schema.DATE_COLUMNS]
_NUMERIC = ["Indicador_repositorio", "Acumulado_cupo", "Cuotas_mora", "Es_amparada",
            "Es_reexpedicion", "fraude"]


@query(f"select {_DATES} from card_tx", "card_tx")
def card_tx(spark, sf_dir):
    return dates_as_text(adapter.card_tx(spark, sf_dir))


# --- labels -------------------------------------------------------------------------------------
@query("select tx_id, fraude from card_tx", "card_tx")
def rule_label(spark, sf_dir):
    return adapter.card_tx(spark, sf_dir).select("tx_id", labels.rule_label().alias("fraude"))


@query(" union all ".join(f"select '{k}' as regla, count(*) filter (where {v}) as n from card_base"
                          for k, v in RULES.items()), "card_base")
def rule_hits(spark, sf_dir):
    rules = labels.fraud_rules()
    counts = adapter.card_tx(spark, sf_dir).agg(*[
        F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "regla", "n")


# --- profile ------------------------------------------------------------------------------------
@query(f"""select count(*) as total_filas, cast(14 as bigint) as total_columnas,
    count(*) filter (where Fecha_ult_retiro is null) as valores_nulos,
    count(*) filter (where fraude = 1) as fraudes, count(*) filter (where fraude = 0) as legitimas,
    {hundredths('(count(*) filter (where fraude = 1))', 'count(*)')} as pct_fraude
  from card_tx""", "card_tx")
def table_profile(spark, sf_dir):
    return profile.profile(adapter.card_tx(spark, sf_dir).drop("run_id"))


@query(f"""select fraudes, total_filas, pct_fraude, case when pct_fraude < 5 then 'desbalanceado'
    when pct_fraude > 50 then 'inusual' end as alerta from (
  select count(*) filter (where fraude = 1) as fraudes, count(*) as total_filas,
    {hundredths('(count(*) filter (where fraude = 1))', 'count(*)')} as pct_fraude
  from card_tx)""", "card_tx")
def imbalance(spark, sf_dir):
    return profile.imbalance(adapter.card_tx(spark, sf_dir))


_FENCES = " union all ".join(f"""
  select '{c}' as columna, quantile_cont({c}::double, 0.25) as q1,
    quantile_cont({c}::double, 0.75) as q3 from card_tx""" for c in _NUMERIC)


@query(f"""select columna, q1, q3, q1 - cast(1.5 as double)*(q3-q1) as lo,
    q3 + cast(1.5 as double)*(q3-q1) as hi from ({_FENCES})""", "card_tx")
def iqr_fences(spark, sf_dir):
    return profile.iqr_fences(adapter.card_tx(spark, sf_dir), _NUMERIC)


def _outside(c: str) -> str:
    fence = f"from fences where columna = '{c}'"
    return (f"{c} < (select q1 - cast(1.5 as double)*(q3-q1) {fence})"
            f" or {c} > (select q3 + cast(1.5 as double)*(q3-q1) {fence})")


view("fences", _FENCES, "card_tx")


@query("select tx_id, cast(" + " or ".join(_outside(c) for c in _NUMERIC)
       + " as int) as es_outlier from card_tx", "card_tx fences")
def iqr_outliers(spark, sf_dir):
    flagged = profile.flag_outliers(adapter.card_tx(spark, sf_dir), _NUMERIC)
    return flagged.select("tx_id", F.col("es_outlier").cast("int").alias("es_outlier"))


@query(f"""select count(*) as n_filas, count(*) filter (where prediccion = 1) as n_fraudes,
    count(*) filter (where prediccion = 0) as n_legitimas,
    {tenths('(count(*) filter (where prediccion = 1))', 'count(*)')} as pct_fraude
  from scored""", "scored")
def class_counts(spark, sf_dir):
    return profile.class_counts(adapter.scored_tx(spark, sf_dir))


@query(" union all ".join(f"select '{c}' as columna, {c} as valor, count(*) as n from card_tx"
                          f" group by {c}" for c in _CATEGORICAL), "card_tx")
def category_counts(spark, sf_dir):
    return profile.category_counts(adapter.card_tx(spark, sf_dir), _CATEGORICAL)


def _with_gaps(df):
    """Some values taken away, so that there is something to fill."""
    gap = F.col("tx_id") % 4 == 1
    return df.withColumns({c: F.when(~gap, F.col(c)) for c in (
        "Acumulado_cupo", "Cuotas_mora", "Tipo_nomina", "Ind_estado")})


_GAPS = ("select tx_id, " + ", ".join(f"case when tx_id % 4 <> 1 then {c} end as {c}" for c in (
    "Acumulado_cupo", "Cuotas_mora", "Tipo_nomina", "Ind_estado")) + " from card_tx")
_FILL_NUM = ["Acumulado_cupo", "Cuotas_mora"]
_FILL_TEXT = ["Tipo_nomina", "Ind_estado"]


def _mode(c: str) -> str:
    return (f"(select {c} from g where {c} is not null group by {c}"
            f" order by count(*) desc, {c} limit 1)")


@query(" union all ".join(
    [f"select '{c}' as columna, 'median' as method, quantile_cont({c}::double, 0.5) as number,"
     f" cast(null as varchar) as text from ({_GAPS}) g" for c in _FILL_NUM]
    + [f"select '{c}', 'mode', cast(null as double), {_mode(c).replace(' from g ', f' from ({_GAPS}) g ')}"
       for c in _FILL_TEXT]), "card_tx")
def impute_values(spark, sf_dir):
    return profile.fill_values(_with_gaps(adapter.card_tx(spark, sf_dir)), _FILL_NUM, _FILL_TEXT)


@query("select tx_id, " + ", ".join(
    [f"coalesce(cast({c} as double), (select quantile_cont({c}::double, 0.5) from ({_GAPS}) g))"
     f" as {c}" for c in _FILL_NUM]
    + [f"coalesce({c}, {_mode(c).replace(' from g ', f' from ({_GAPS}) g ')}) as {c}"
       for c in _FILL_TEXT]) + f" from ({_GAPS}) t", "card_tx")
def imputed(spark, sf_dir):
    rows = _with_gaps(adapter.card_tx(spark, sf_dir))
    return profile.impute(rows, _FILL_NUM, _FILL_TEXT).select("tx_id", *_FILL_NUM, *_FILL_TEXT)


_Z = ["Acumulado_cupo", "Cuotas_mora"]


@query("select tx_id, " + ", ".join(
    f"round(({c} - (select avg({c}) from card_tx)) / (select stddev_pop({c}) from card_tx), 6)"
    f" as {c}_z" for c in _Z) + " from card_tx", "card_tx")
def zscore(spark, sf_dir):
    scaled = profile.zscore(adapter.card_tx(spark, sf_dir), _Z)
    return scaled.select("tx_id", *[r6(f"{c}_z") for c in _Z])


@query("select tx_id, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _Z)
       + " from card_tx", "card_tx")
def zscore_inverse(spark, sf_dir):
    rows = adapter.card_tx(spark, sf_dir)
    scaled = profile.zscore(rows, _Z).drop(*_Z)
    return profile.zscore_inverse(scaled, rows, _Z).select("tx_id", *[r6(c) for c in _Z])


_DOMAINS = {"Tipo_tarjeta": ["clasica", "oro", "platinum"],
            "Tipo_nomina": ["gobierno", "independiente", "privada"]}


@query("select tx_id, " + ", ".join(f"cast({c} = '{v}' as int) as {c}_{v}"
                                    for c, vs in _DOMAINS.items() for v in vs[1:])
       + " from card_tx", "card_tx")
def dummies(spark, sf_dir):
    rows = adapter.card_tx(spark, sf_dir).select("tx_id", *_DOMAINS)
    return profile.dummies(rows, list(_DOMAINS))


# --- projections --------------------------------------------------------------------------------
@query(f"select tx_id, run_id, q, {_FEATURES} from (select {_DATES} from reviewed)", "reviewed")
def drop_control(spark, sf_dir):
    return dates_as_text(clean.drop_control(adapter.reviewed_tx(spark, sf_dir)))


@query("""select o_orderkey as tx_id, coalesce(strftime(try_cast(raw as timestamp), '%Y-%m-%d'),
    'desconocido') as fecha from (
  select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
    when 1 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 2 then 'no aplica'
    when 3 then '1999-02-30' end as raw from orders)""")
def date_canonical(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = (F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(key % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
           .when(key % 5 == 2, "no aplica").when(key % 5 == 3, "1999-02-30"))
    return adapter.table(spark, sf_dir, "orders").select(
        key.alias("tx_id"), text.date_text(raw).alias("fecha"))


_MODEL_COLUMNS = ["Cuotas_mora", "Canal", "Estado_tarjeta", "Fecha_vencimiento", "Ubicacion",
                  "Fecha_ult_retiro", "Acumulado_cupo"]


@query("""select tx_id, Cuotas_mora, cast(0 as int) as Canal, Estado_tarjeta,
    strftime(Fecha_vencimiento, '%Y-%m-%d') as Fecha_vencimiento, 'desconocido' as Ubicacion,
    coalesce(strftime(Fecha_ult_retiro, '%Y-%m-%d'), 'desconocido') as Fecha_ult_retiro,
    Acumulado_cupo from scored""", "scored")
def align_columns(spark, sf_dir):
    return clean.align(adapter.scored_tx(spark, sf_dir), _MODEL_COLUMNS, keep=["tx_id"])


@query("""select tx_id, coalesce(cast(case when tx_id % 9 <> 0 then 1 - fraude end as int), 0)
    as fraude from card_tx""", "card_tx")
def effective_label(spark, sf_dir):
    rows = adapter.card_tx(spark, sf_dir).withColumn("fraude_true", F.when(
        F.col("tx_id") % 9 != 0, (1 - F.col("fraude")).cast("double")))
    return rows.select("tx_id", labels.effective_label(rows.columns).alias("fraude"))


@query("""select tx_id, case when prediccion = 1 then '⚠️ Fraudulenta' else 'Legítima' end
    as clasificacion, probabilidad from scored""", "scored")
def class_text(spark, sf_dir):
    return adapter.scored_tx(spark, sf_dir).select(
        "tx_id", labels.class_text(F.col("prediccion")).alias("clasificacion"),
        F.round("probabilidad", 4).alias("probabilidad"))


@query("""select tx_id, case when etiqueta_usuario = 1 then '✔ Fraude (1)'
    when etiqueta_usuario = 0 then '✔ Legítima (0)' else '— sin revisar' end as etiqueta
  from reviewed""", "reviewed")
def reviewer_label(spark, sf_dir):
    return adapter.reviewed_tx(spark, sf_dir).select(
        "tx_id", labels.reviewer_text(F.col("etiqueta_usuario")).alias("etiqueta"))


@query("""select tx_id, case when fraude = 1 and prediccion = 1 then '✅ Verdadero Positivo'
    when fraude = 0 and prediccion = 1 then '❌ Falso Positivo'
    when fraude = 0 and prediccion = 0 then '✅ Verdadero Negativo'
    else '❌ Falso Negativo' end as resultado from scored""", "scored")
def outcome_text(spark, sf_dir):
    return adapter.scored_tx(spark, sf_dir).select(
        "tx_id", labels.outcome_text(F.col("fraude"), F.col("prediccion")).alias("resultado"))


@query("""select tx_id, case when fraude = 1 and prediccion = 0 then '⚠️ Falso Negativo'
    when fraude = 0 and prediccion = 1 then '❌ Falso Positivo' end as tipo_error from scored""",
       "scored")
def error_type(spark, sf_dir):
    return adapter.scored_tx(spark, sf_dir).select(
        "tx_id", labels.error_tag(F.col("fraude"), F.col("prediccion")).alias("tipo_error"))


@query("""select event_id, cast(event_type = 'click' as int) as etiqueta_usuario from events""")
def mark_label(spark, sf_dir):
    return adapter.feedback_log(spark, sf_dir).select(
        F.col("seq").alias("event_id"),
        labels.mark_label(F.col("marcacion")).alias("etiqueta_usuario"))


@query("""select Tipo_tarjeta, Estado_tarjeta, Acumulado_cupo, Cuotas_mora, Localizacion_tarjeta,
    probabilidad, clasificacion, marcacion_usuario from reviewed""", "reviewed")
def report_columns(spark, sf_dir):
    rows = adapter.reviewed_tx(spark, sf_dir).withColumn("Ubicacion", F.lit("Bogotá"))
    return clean.present(rows, schema.REPORT_COLUMNS)


@query("""select tx_id, q, cast(null as varchar) as Canal, cast(fraude as bigint) as fraude
  from scored""", "scored")
def reindex_columns(spark, sf_dir):
    like = spark.createDataFrame([], "tx_id long, q int, Canal string, fraude long")
    return clean.reindex(adapter.scored_tx(spark, sf_dir), like)


# --- filters and paging -------------------------------------------------------------------------
@query("select tx_id, q from scored where prediccion = 1", "scored")
def tab_frauds(spark, sf_dir):
    return filters.tab(adapter.scored_tx(spark, sf_dir), "otra").select("tx_id", "q")


@query("select tx_id, q from scored where prediccion = 0", "scored")
def tab_legitimate(spark, sf_dir):
    return filters.tab(adapter.scored_tx(spark, sf_dir), "legitimas").select("tx_id", "q")


@query("""select resultado, count(*) as n, cast(sum(q) as bigint) as suma_q from (
  select q, case when fraude = 1 and prediccion = 1 then '✅ Verdadero Positivo'
    when fraude = 0 and prediccion = 1 then '❌ Falso Positivo'
    when fraude = 0 and prediccion = 0 then '✅ Verdadero Negativo'
    else '❌ Falso Negativo' end as resultado from scored) group by resultado""", "scored")
def tab_analysis(spark, sf_dir):
    rows = filters.tab(adapter.scored_tx(spark, sf_dir), "analisis")
    return rows.groupBy("resultado").agg(F.count("*").alias("n"), F.sum("q").alias("suma_q"))


@query("""select tx_id, tipo_error, n_tipo from (
  select tx_id, tipo_error, count(*) over (partition by tipo_error) as n_tipo,
    row_number() over (partition by tipo_error order by tx_id) as k from (
    select tx_id, case when fraude = 1 then '⚠️ Falso Negativo' else '❌ Falso Positivo' end
      as tipo_error from scored where fraude <> prediccion)) where k <= 50""", "scored")
def error_rows(spark, sf_dir):
    rows = filters.error_rows(adapter.scored_tx(spark, sf_dir))
    return rows.select("tx_id", "tipo_error", long("n_tipo"))


_SEARCHED = [c for c in FEATURES if c != "Acumulado_cupo"]


@query("select tx_id from (select " + _DATES + " from card_tx) where " + " or ".join(
    f"coalesce(regexp_matches(cast({c} as varchar), '(?i)VENC|mora$|1997-0[12]'), false)"
    for c in _SEARCHED), "card_tx")
def text_search(spark, sf_dir):
    found = filters.search(adapter.card_tx(spark, sf_dir), "VENC|mora$|1997-0[12]", _SEARCHED)
    return found.select("tx_id")


@query("""select tx_id, q from scored where prediccion = 1 order by tx_id limit 20 offset 40""",
       "scored")
def page(spark, sf_dir):
    rows = filters.tab(adapter.scored_tx(spark, sf_dir), "fraudes")
    return filters.page(rows, 3, 20).select("tx_id", "q")


@query("select tx_id, q from scored order by tx_id limit 100 offset 12000", "scored")
def deep_page(spark, sf_dir):
    return filters.page(adapter.scored_tx(spark, sf_dir), 121, 100).select("tx_id", "q")


@query("""select count(*) as total, cast(greatest(1, (count(*) + 19) // 20) as bigint)
    as total_paginas from scored where prediccion = 1""", "scored")
def page_count(spark, sf_dir):
    rows = filters.tab(adapter.scored_tx(spark, sf_dir), "fraudes")
    return filters.page_count(rows, 20)


@query("""select Tipo_tarjeta, Estado_tarjeta, Acumulado_cupo, Cuotas_mora, Localizacion_tarjeta,
    probabilidad, clasificacion, marcacion_usuario from reviewed where prediccion = 1""",
       "reviewed")
def fraud_report(spark, sf_dir):
    return reports.fraud_report(adapter.reviewed_tx(spark, sf_dir), stamp=False)


# --- files --------------------------------------------------------------------------------------
@query(f"select {_FEATURES} from (select {_DATES} from card_tx)", "card_tx")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "cards-csv")
    kind = schema.CARD_TX[1:]
    rows = adapter.card_tx(spark, sf_dir).select(*FEATURES)
    files.write_csv(rows, path)
    return dates_as_text(files.read_csv(spark, path, type(schema.CARD_TX)(kind)))


@query(r"""select p_partkey, case when trim(raw) = '' or raw is null then 'activo.joblib'
    else regexp_replace(case when ends_with(trim(raw), '.joblib') then trim(raw)
      else trim(raw) || '.joblib' end, '[\\/:*?"<>|]', '_', 'g') end as nombre
  from (select p_partkey, case p_partkey % 5 when 0 then p_name || '/v:1?' when 1 then '  '
    when 2 then p_name || '.joblib ' when 3 then p_type || '\a|<b>*"' end as raw from part)""")
def output_name(spark, sf_dir):
    key = F.col("p_partkey") % 5
    raw = (F.when(key == 0, F.concat("p_name", F.lit("/v:1?"))).when(key == 1, "  ")
           .when(key == 2, F.concat("p_name", F.lit(".joblib ")))
           .when(key == 3, F.concat("p_type", F.lit('\\a|<b>*"'))))
    return adapter.table(spark, sf_dir, "part").select(
        "p_partkey", text.output_name(raw, "activo.joblib").alias("nombre"))
