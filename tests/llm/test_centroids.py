"""Centroid clustering against a plain version in Python's whole numbers, and against its SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from riskloom.llm.centroids import LIMB, Search, clusters, limbs, whole
from riskloom.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"
WIDE = "vec_id long, embedding array<double>"


def brute(rows, width=64, k=16, rounds=3, scale=64):
    """(id, cluster, distance, cluster inertia, inertia, hash) of rows (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
    x = [[whole(a, scale) for a in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"1:{kept[r][0]}".encode()).hexdigest()
                                                    if kept[r][0] is not None else "", list(kept[r][1])))
    centres = [x[r] for r in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for v in x]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for v, (_, c) in zip(x, found) if c == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    sums = [sum(d for d, c in found if c == n) for n in range(len(centres))]
    total = sum(sums)

    def fits(v):
        return v if v < 1 << 63 else None

    return sorted(((i, c, fits(d), fits(sums[c]), fits(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, found)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd(kind):
    random = np.random.default_rng(7)
    rows = [(i, kind(random.standard_normal(64) * 10 ** (i % 3 - 1)).tolist()) for i in range(60)]
    rows += [(100 + i, [0.0] * 64) for i in range(5)] + [(100, [0.0] * 64), (None, [1.0] * 64), (None, [1.0] * 64)]
    rows += [(200, [-0.0] * 64), (201, [1 / 128] * 64), (202, [-1 / 128] * 64)]
    return rows + [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [1.0] * 63 + [None]),
                   (305, [1.0] * 63 + [float("nan")]), (306, [float("-inf")] + [1.0] * 63)]


def test_as_brute_force(spark):
    rows = odd(np.float32)
    table = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).withColumns({"id": F.lit(1), "vec": F.lit("x"), "cluster": F.lit(2)})
    got = clusters(table.repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == brute(rows)


def test_numbers_beyond_64_bits(spark):
    rows = odd(np.float64) + [(400 + i, [1.7e308 / (i + 1)] * 64) for i in range(3)] + [(410 + i, [3e9 * i] * 64) for i in range(8)]
    got = clusters(spark.createDataFrame(rows, WIDE).repartition(4))
    want = brute(rows)
    assert any(r[2] is None for r in want) or any(r[4] is None for r in want)
    assert result(got) == want


@pytest.mark.parametrize("count", [0, 1, 7])
def test_few_vectors(spark, count):
    rows = odd(np.float32)[:count]
    assert result(clusters(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))) == brute(rows)


def test_search_is_exact_on_ties_and_large_centroids():
    random = np.random.default_rng(3)
    x = random.integers(-3, 4, (400, 4))
    centres = random.integers(-3, 4, (30, 4)).tolist() + [[10 ** 30, 0, 0, 0], [1 << 29, 1, 1, 1]]
    search = Search(centres, 4)
    near, distance = search.block(x)
    for v, c, d in zip(x.tolist(), near.tolist(), distance):
        want = min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(centres))
        assert (d, c) == want and search.one(v) == (c, d)
    only = Search([[10 ** 400] * 4, [10 ** 400 + 1] * 4], 4)
    near, distance = only.block(np.zeros((2, 4), np.int64))
    assert near.tolist() == [0, 0] and distance == [4 * 10 ** 800] * 2


@pytest.mark.parametrize("value", [0, -1, 1 << 61, -(1 << 62), 1 << 62, -(1 << 63), 10 ** 40, -10 ** 310])
def test_limbs_add_up(value):
    parts = list(limbs(value))
    assert sum(v << (LIMB * p) for p, v in parts) == value
    assert all(-(1 << 63) <= v < 1 << 63 for _, v in parts)


def test_sql_on_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(*r, 0) for r in odd(np.float32)], VECTORS)
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert difference(QUERIES["op11_centroids"](spark, str(tmp_path)), con, ORACLES["op11_centroids"]) is None
