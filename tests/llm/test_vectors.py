import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm.components import forest
from riskloom.llm.cover_tree import similar_vectors
from riskloom.llm.hilbert import curve_keys, nearest, recall

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


def odd_rows():
    random = np.random.default_rng(5)
    out = [(i, random.standard_normal(6)) for i in range(40)]
    tight = random.standard_normal(6)
    out += [(100 + i, tight + 0.01 * random.standard_normal(6)) for i in range(30)]
    out += [(200 + i, tight) for i in range(12)]  # equal vectors
    out += [(300, None), (301, [0] * 6), (302, [1, None, 0, 0, 0, 0]), (303, [float("nan")] * 6), (304, [1e30] * 6),
            (305, [float("inf")] + [0] * 5), (306, []), (307, [1, 2, 3]), (None, tight), (200, tight), (400, 2 * tight)]
    out += [(308, [1, 2, 3]), (309, [3, 2, 1]), (350, [1, 2, 3.1]), (None, [1, 2, 3]), (None, [0, 0, 1]), (None, [0, 0, 2]),
            (150, -tight), (150, -tight), (None, random.standard_normal(6)), (310, [5]), (None, None), (None, [0, 0])]
    return out


def good(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v is not None and None not in list(v)
            and np.isfinite(np.array(v, float)).all() and np.array(v, float).any()]


def test_links_as_brute_force(spark, monkeypatch):
    import riskloom.llm.cover_tree as module
    monkeypatch.setattr(module, "ROWS", 16)
    rows = odd_rows()
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"])
           for r in similar_vectors(table(spark, rows).withColumns({"id": F.lit(1), "vec": F.lit(2), "same": F.lit(3)})).collect()]
    assert len(got) == len(rows)
    want = []
    for size in {len(v) for _, v in good(rows)}:
        valid = [r for r in good(rows) if len(r[1]) == size]
        x = np.stack([v / np.abs(v).max() for _, v in valid])
        x /= np.linalg.norm(x, axis=1)[:, None]
        linked = x @ x.T >= 0.95
        np.fill_diagonal(linked, False)
        node, root = forest(*np.nonzero(linked))
        of = np.arange(len(valid))
        of[node] = root
        least = {r: min((valid[i][0] for i in np.flatnonzero(of == r) if valid[i][0] is not None), default=None)
                 for r in set(of.tolist())}
        want += [(valid[i][0], int(linked[i].sum()), least[of[i]]) for i in range(len(valid))]
    want += [(i, 0, i) for i, v in rows if not good([(i, v)])]
    order = lambda row: tuple((x is None, x) for x in row)
    assert sorted((g[:3] for g in got), key=order) == sorted(want, key=order)
    assert all(g[3] == (g[0] is not None and g[0] == g[2]) for g in got)


def test_real_embeddings_as_brute_force(spark, sf_dir):
    rows = spark.read.parquet(sf_dir + "/embeddings.parquet")
    pdf = rows.toPandas().sort_values("vec_id")
    x = np.stack(pdf.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = similar_vectors(rows, cosine=0.4).toPandas().sort_values("vec_id")
    assert (got.n_links.values == (x @ x.T >= 0.4).sum(1) - 1).all()


def test_no_vectors(spark):
    assert similar_vectors(table(spark, [])).count() == 0
    only = similar_vectors(table(spark, [(1, None), (None, [1, 2])])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in only) == [(0, 0), (1, 0)]
    assert nearest(table(spark, [(1, None)]), F.lit(True)).count() == 0
    assert recall(table(spark, [(1, None)])) == 1.0


def exact(valid, queries, k):
    """Of (place, id, vector): all nearest rows of the queries but their own place."""
    out = []
    for own, q, v in queries:
        near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i is None, i) for at, i, w in valid if at != own and len(w) == len(v))
        out += [(q, n + 1, i, d) for n, (d, _, i) in enumerate(near[:k])]
    return out


def test_nearest_with_ties_copies_and_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] != 304]
    valid = [(at, i, v) for at, (i, v) in enumerate(good(rows))]
    queries = [q for q in valid if q[1] is not None and q[1] % 50 == 0]
    assert len({len(v) for _, _, v in queries}) == 2 and len({i for _, i, _ in queries}) < len(queries)
    found = nearest(table(spark, rows).withColumns({"id": F.lit(1), "class": F.lit(2), "curve": F.lit(3)}), F.col("id") % 50 == 0)
    order = lambda row: (row[0], row[1], row[3], row[2] is None, row[2])
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()), key=order)
    want = sorted(((q, n, i, round(d, 9)) for q, n, i, d in exact(valid, queries, 10)), key=order)
    assert got == want


def test_recall_of_real_embeddings(spark, sf_dir):
    rows = spark.read.parquet(sf_dir + "/embeddings.parquet")
    pdf = rows.toPandas()
    valid = [(i, i, np.asarray(v, float)) for i, v in zip(pdf.vec_id.tolist(), pdf.embedding)]
    want = {(w[0], w[2]) for w in exact(valid, [v for v in valid if v[0] % 20 == 0], 10)}
    got = {(r["query_id"], r["vec_id"]) for r in nearest(rows, F.col("id") % 20 == 0).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    assert recall(rows, queries=50) >= 0.9


def test_recall_counts_what_is_missed(spark, monkeypatch):
    import riskloom.llm.hilbert as module
    monkeypatch.setattr(module, "block_rows", lambda total: 4)
    random = np.random.default_rng(3)
    rows = table(spark, [(i, random.standard_normal(6)) for i in range(400)])
    share = recall(rows, queries=40, curves=1)
    assert 0 < share < 0.9 and recall(rows, queries=40, curves=20) > share


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [i, 1, 0, 0, 0, 0]) for i in range(1, 5)]
    got = nearest(table(spark, rows), F.col("id") == 1).collect()
    assert [(r["vec_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = curve_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(2, 60), st.integers(2, 60), st.booleans())
def test_dual_traversal_counts(seed, n, m, same):
    from riskloom.llm.cover_tree import dual, grow
    random = np.random.default_rng(seed)
    centre = random.standard_normal((3, 4))
    make = lambda k: (lambda z: z / np.linalg.norm(z, axis=1)[:, None])(
        centre[random.integers(0, 3, k)] + random.choice([0.01, 0.1, 0.5]) * random.standard_normal((k, 4)))
    x = make(n)
    y = x if same else make(m)
    cx, cy = random.integers(1, 4, len(x)), random.integers(1, 4, len(y))
    cy = cx if same else cy
    tree = grow(x)
    a, b, left, right = dual(x, tree, y, tree if same else grow(y), 0.9, cx, cy, same)
    linked = x @ y.T >= 0.9
    if same:
        np.fill_diagonal(linked, False)
        assert (a == linked @ cx).all()
    else:
        assert (a == linked @ cy).all() and (b == cx @ linked).all()
    i, j = np.nonzero(linked)
    shift = 0 if same else n
    assert set(map(tuple, np.stack(forest(i, j + shift)).T)) == set(map(tuple, np.stack(forest(left, right)).T))


def test_trees_are_written_once_however_many_they_meet(spark, monkeypatch):
    """Blocks that all meet each other, a tree or two to a round: links as brute force, and no tree is shuffled."""
    import riskloom.llm.cover_tree as module
    monkeypatch.setattr(module, "ROWS", 16)
    monkeypatch.setattr(module, "ROUND_BYTES", 8_000)
    random = np.random.default_rng(8)
    x = random.standard_normal((300, 6)).astype(np.float32)
    x[200:] = x[:100] + 0.05 * random.standard_normal((100, 6)).astype(np.float32)
    rounds = []
    monkeypatch.setattr(module, "_rounds", lambda trees, f=module._rounds: rounds.append((f(trees), trees.count())) or rounds[-1][0])
    stored = []
    monkeypatch.setattr(module, "saved", lambda df, name, f=module.saved: stored.append((name, df._jdf.queryExecution().toString())) or f(df, name))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in similar_vectors(table(spark, list(enumerate(x))), cosine=0.7).collect()}
    (ranges, blocks), = rounds
    assert blocks > 15 and 3 < len(ranges) < blocks and len(ranges) == len([n for n, _ in stored if n == "vector_links"])
    assert not any("Exchange" in plan for n, plan in stored if n == "vector_links")
    z = x.astype(float)
    z /= np.linalg.norm(z, axis=1)[:, None]
    linked = z @ z.T >= 0.7
    np.fill_diagonal(linked, False)
    node, root = forest(*np.nonzero(linked))
    of = np.arange(300)
    of[node] = root
    assert got == {i: (int(linked[i].sum()), int(of[i])) for i in range(300)}
