"""Names of two tables against each other, held against every pair in plain Python."""

import random

import pytest

from riskloom import schema
from riskloom.operators import catalogues, matching
from riskloom.sources import adapter


def similarity(a, b, shortest):
    if a == b:
        return 1.0
    if (a in b or b in a) and min(len(a), len(b)) >= shortest:
        return 0.85
    ga, gb = ({s[i:i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(ga & gb) / len(ga | gb) if ga and gb else 0.0


def norms(seed, count):
    pick = random.Random(seed)
    words = ["fecha", "ult", "retiro", "estado", "tipo", "cupo", "mora", "ind", "id", "x"]
    out = {"_".join(pick.choices(words, k=pick.randint(1, 4))) for _ in range(count)}
    out |= {"".join(pick.choices("ab1_", k=pick.randint(0, 6))) for _ in range(count)}
    out |= {"".join(pick.choices(catalogues.ALPHABET, k=pick.choice([40, 200]))) for _ in range(6)}
    long = "".join(pick.choices(catalogues.ALPHABET, k=300))
    return sorted(out | {"", "a", "_", long[:250], long[20:], long[:-60] + "zz9", "q" * 90, "qr" * 45})


def pairs(spark, left, right, threshold, strict):
    a, b = (spark.createDataFrame([(x,) for x in side], "norm string").repartition(3) for side in (left, right))
    return catalogues.similar_norms(a, b, threshold, strict)


@pytest.mark.parametrize(("threshold", "strict"), [(0.6, False), (0.6, True), (0.2, False), (0.3, True), (0.85, False), (0.9, True), (1.0, False)])
def test_as_every_pair(spark, threshold, strict):
    left, right = norms(1, 60), norms(2, 60)
    shortest = 0 if strict else 2
    got = sorted(tuple(r) for r in pairs(spark, left, right, threshold, strict).collect())
    want = sorted((a, b, s) for a in left for b in right if (s := similarity(a, b, shortest)) >= threshold)
    assert got == want


def test_no_cross_join(spark):
    plan = pairs(spark, norms(1, 5), norms(2, 5), 0.6, True)._jdf.queryExecution().optimizedPlan().toString()
    physical = pairs(spark, norms(1, 5), norms(2, 5), 0.6, True)._jdf.queryExecution().executedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in physical and "NestedLoop" not in physical


def test_nothing_is_similar_to_no_names(spark):
    assert pairs(spark, [], norms(2, 5), 0.6, False).count() == 0
    assert pairs(spark, norms(2, 5), [], 0.6, True).count() == 0
    with pytest.raises(ValueError):
        pairs(spark, ["a"], ["a"], 0.0, False)


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_match_with_fixed_names(spark, sf_dir, strict):
    names = adapter.header_names(spark, sf_dir)
    extra = spark.createDataFrame([("f", 1, "Tipo Tarjeta "), ("f", 2, "tipo_tarjeta"), ("f", 3, ""), ("f", 4, "e"), ("f", 5, None),
                                   ("g", 1, "ESTADO"), ("g", 0, "estado"), ("h", 1, "zzz")], "file_id string, pos long, name string")
    names = names.unionByName(extra)
    wanted = spark.createDataFrame([(r,) for r in [*schema.REQUIRED, None]], "name string")
    synonyms = spark.createDataFrame([(r, s) for r, all_ in schema.SYNONYMS.items() for s in all_] + [("not wanted", "zzz")],
                                     "wanted string, synonym string")
    got = catalogues.match_catalogues(names, wanted, synonyms, strict=strict).withColumnRenamed("wanted", "required")
    want = matching.match_columns(names.where("name is not null"), strict=strict)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_name_in_most_files(spark):
    """Repeated names are compared once, whatever the number of files they are in."""
    names = spark.range(3000).selectExpr("concat('f', id) as file_id", "id as pos", "'Fecha retiro' as name")
    wanted = spark.createDataFrame([("fecha_retiro",), ("fecha_ult_retiro",), ("otra",)], "name string")
    got = catalogues.match_catalogues(names, wanted)
    assert got.count() == 6000 and got.where("wanted = 'fecha_retiro' and score = 1.0 and method = 'similar'").count() == 3000
