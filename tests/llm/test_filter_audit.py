"""The filter audit against a plain walk through every order, document by document."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from riskloom.llm import filter_audit
from riskloom.llm.filter_audit import audit, interactions, removals, shapley, text_mask, word_counts


def failed(rows):
    """Letters that each row (id, text) fails."""
    out = []
    for i, text in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
        out.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows)})
    return [{k for k, v in f.items() if v} for f in out]


def walk(sets, good, toxic, names):
    """(order, step) to all figures, by applying the filters one after the other."""
    out, total = {}, Counter()
    for order in permutations(names):
        left = list(range(len(sets)))
        for step, f in enumerate(order, 1):
            here = [r for r in left if f in sets[r]]
            fails = [r for r in range(len(sets)) if f in sets[r]]
            left = [r for r in left if f not in sets[r]]
            total[f] += len(here)
            out["".join(order), step] = [len(left), len(here), len(fails) - len(here), sum(s == {f} for s in sets),
                                         sum(r in good for r in here), sum(r in toxic for r in here)]
    return {k: tuple(v + [total[k[0][k[1] - 1]]]) for k, v in out.items()}


def rows_to_audit():
    pick = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    texts = [None, "", " \t\v\f\r\n", "x" * 50_000, "a\u00a0b\u2003c " * 99, "é" * 9 + "A", "E" + "é" * 10, "ABC def", "a|b"]
    texts += [" ".join(pick.choices(words[:pick.choice([30, 150])], k=pick.choice([50, 99, 100, 200]))) + pick.choice(["", "", " $", " QQQQQ" * 30])
              for _ in range(40)]
    texts += [" ".join(words[:100])] * 5
    ids = [*range(len(texts)), 3, None, None, 11, 11]
    texts += [texts[3], "", texts[-1], texts[0], texts[11]]
    return [(i, t, pick.choice(["en", "de", None, ""])) for i, t in zip(ids, texts)]


def test_as_a_walk_through_all_orders(spark):
    rows = rows_to_audit()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 45)] + [(5, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 7) for i, t, p in rows], "doc_id long, text string, lang string, mask int")
    marks = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    docs = docs.withColumns({"id": F.lit(1), "part": F.lit("x"), "n": F.lit(9), "key": F.lit(0)}).repartition(7)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit(docs, marks.withColumn("id", F.lit(4))).collect()}
    sets = failed([(i, t) for i, t, _ in rows])
    want = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [r for r in range(len(rows)) if (rows[r][2] or "") == part]
        good = {k for k, r in enumerate(mine) if any(q == 1 and i is not None and i == rows[r][0] for i, q, _ in labels)}
        toxic = {k for k, r in enumerate(mine) if any(x == 1 and i is not None and i == rows[r][0] for i, _, x in labels)}
        want |= {(part, *k): v for k, v in walk([sets[r] for r in mine], good, toxic, "ABCDE").items()}
    assert len(got) == 600 * 3 and got == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_least_squares_equals_the_mean_over_orders(n):
    pick = random.Random(n)
    removed = removals([pick.randrange(10 ** 15) for _ in range(1 << n)])
    want, orders = [Fraction(0)] * n, list(permutations(range(n)))
    for order in orders:
        before = 0
        for i in order:
            want[i] += Fraction(removed[before | 1 << i] - removed[before], len(orders))
            before |= 1 << i
    assert shapley(removed, n) == want


def test_fewer_filters(spark):
    table = spark.createDataFrame([("", 0, 4, 1, 0), ("", 1, 2, 0, 1), ("", 3, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = sorted(tuple(r) for r in interactions(table, "XY").collect())
    assert got == [("", "XY", 1, 4, 3, 0, 2, 1, 2, 5), ("", "XY", 2, 4, 0, 1, 0, 0, 0, 1),
                   ("", "YX", 1, 6, 1, 0, 0, 1, 1, 1), ("", "YX", 2, 4, 2, 1, 2, 0, 1, 5)]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (" ".join(f"w{k % 700}" for k in range(5000)) + " " + "x" * 300 + "\tend").encode()
    whole = word_counts(text), text_mask(text)
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    assert whole == (word_counts(text), text_mask(text)) and whole[0] == (5002, 702)
