import unicodedata

import pytest
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions.text import normalise, similarity
from riskloom.operators import matching
from riskloom.plans import workflow

HEADERS = {
    "renamed": "tipo_tarjeta,estado de tarjeta,expiry_date,repositorio,card_location,"
               "cupo_acumulado,ultimo_retiro,mora,status_indicator,amparada,reexpedida,"
               "payroll_type",
    "partial": "Tipo_tarjeta,estado_tarjeta,Fecha_vencimiento,repositorio_ind,ciudad,"
               "Acumulado_cupo,fecha_mov,Cuotas_mora,estado_cuenta,Es_amparada,"
               "col_desconocida,nomina_tipo",
    "few": "card_kind,card_state,exp_date,repo,geo,ratio,last_op,overdue,pay_stat,covered,"
           "reissued,pay_type",
    "none": "col_a,col_b,col_c,col_d,col_e,col_f",
    "exact": ",".join(schema.REQUIRED),
}


def names(spark, headers):
    rows = [(f, i, n) for f, h in headers.items() for i, n in enumerate(h.split(","))]
    return spark.createDataFrame(rows, "file_id string, pos long, name string")


@pytest.fixture(scope="module")
def verdicts(spark):
    best = matching.best_sources(names(spark, HEADERS))
    return {r.file_id: r for r in matching.mapping_verdicts(best).collect()}


@pytest.mark.parametrize("file_id, state, found, renamed", [
    ("renamed", "auto", 12, 12), ("partial", "parcial", 7, 2), ("few", "vacio", 3, 3),
    ("none", "imposible", 0, 0), ("exact", "ok", 12, 0)])
def test_verdict(verdicts, file_id, state, found, renamed):
    row = verdicts[file_id]
    assert (row.estado, row.n_encontradas, row.n_renombradas) == (state, found, renamed)
    assert len(row.faltantes) == 12 - found
    numbers = [int(w) for w in row.mensaje.replace(":", "").split() if w.isdigit()]
    assert numbers == {"auto": [renamed], "parcial": [found, 12, 12 - found],
                       "vacio": [found, 12 - found]}.get(state, [])


def test_how_names_were_found(spark):
    got = {(r.file_id, r.required): (r.name, round(r.score, 4), r.method)
           for r in matching.match_columns(names(spark, HEADERS)).collect()}
    assert got["partial", "Tipo_nomina"] == ("nomina_tipo", 0.6667, "similar")
    assert got["partial", "Estado_tarjeta"] == ("estado_tarjeta", 0.95, "sinonimo")
    assert got["few", "Indicador_repositorio"] == ("repo", 0.85, "similar")
    assert got["few", "Es_amparada"] == ("covered", 0.95, "sinonimo")
    assert ("partial", "Indicador_repositorio") not in got


def test_one_source_for_two_columns(spark):
    frame = names(spark, {"x": "estado"})
    got = {r.required for r in matching.match_columns(frame).collect()}
    assert got == {"Estado_tarjeta", "Ind_estado"}
    assert matching.mapping_verdicts(matching.best_sources(frame)).first().conflicto == 1
    df = spark.range(1).withColumnRenamed("id", "estado")
    with pytest.raises(matching.MappingConflict):
        matching.apply_mapping(df, {"Estado_tarjeta": "estado", "Ind_estado": "estado"})


def test_short_names(spark):
    frame = spark.createDataFrame([("x", 0, ""), ("x", 1, "c")],
                                  "file_id string, pos long, name string")
    assert matching.match_columns(frame).count() == 0
    strict = matching.match_columns(frame, strict=True)
    assert strict.filter("score = 0.85").count() == 12


@pytest.mark.parametrize("text, want", [
    ("Localización Tarjeta", "localizacion_tarjeta"), ("tipo-de.nómina", "tipo_de_nomina"),
    ("  Cupo \t usado ", "cupo_usado"), ("Ünï¢ode!", "uniode"), ("", ""), ("Ḁé", "ae")])
def test_normalise(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(normalise(F.col("t"))).first()
    assert row[0] == want


def test_similarity_by_brute_force(spark):
    words = ["abc", "abcd", "cuotas", "cuotas_mora", "mora_cuotas", "", "x", "xy", "estado",
             "indestado", "aaaa", "aa"]
    pairs = [(a, b) for a in words for b in words]

    def want(a, b):
        if a == b:
            return 1.0
        if a in b or b in a:
            return 0.85
        x, y = ({s[i:i + 2] for i in range(len(s) - 1)} for s in (a, b))
        return len(x & y) / len(x | y) if x and y else 0.0

    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s == want(r.a, r.b) for r in rows)


def test_accents_follow_the_unicode_rule(spark):
    letters = [chr(i) for i in range(0xC0, 0x250)]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select(
        "c", normalise(F.col("c")).alias("n")).collect()
    for r in rows:
        base = "".join(x for x in unicodedata.normalize("NFD", r.c.lower())
                       if unicodedata.category(x) != "Mn")
        assert r.n == "".join(x for x in base if x.isascii() and x.isalnum()), r.c


def test_manual_choices_fill_gaps_only(spark):
    df = spark.createDataFrame([(1,) * 12], HEADERS["partial"].split(","))
    with pytest.raises(workflow.NeedsMapping) as e:
        workflow.map_columns(df, {"Ind_estado": "__omitir__", "Tipo_tarjeta": "ciudad"})
    assert "Ind_estado" in e.value.missing and len(e.value.missing) == 5
    manual = {"Indicador_repositorio": "repositorio_ind", "Localizacion_tarjeta": "ciudad",
              "Fecha_ult_retiro": "fecha_mov", "Ind_estado": "estado_cuenta",
              "Es_reexpedicion": "col_desconocida"}
    assert set(schema.REQUIRED) == set(workflow.map_columns(df, manual).columns)
