"""The mix where many rows share one key, against a plain running sum; copies by content; odd columns."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing


def plain(rows, weight, weights=(3, 1, 2), share=1.5, most=2.0):
    """Words taken by (id, source, size), one source after the other in the order of its keys."""
    have = collections.Counter()
    for _, s, n in rows:
        have[s] += n
    order = sorted(have, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(have.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(most * have[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if level * w[s] > most * have[s]}
        if not over:
            break
        full |= over
    out = []
    for s in order:
        budget = round(most * have[s] if s in full else level * w[s])
        epochs, left = divmod(budget, have[s]) if have[s] else (0, 0)

        def key(r):
            digest = hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12]
            return (-math.log((int(digest, 16) + 0.5) / (1 << 48)) / weight, r[0] is not None, r[0] or 0, r[2])

        for r in sorted((r for r in rows if r[1] == s), key=key):
            more = max(0, min(r[2], left))
            left -= more
            out.append((r[0] or 0, s or "", r[2], epochs * r[2] + more))
    return sorted(out)


@pytest.mark.parametrize("together", [40, 100_000])
def test_many_rows_of_one_key(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    rows = [(None if i % 3 == 0 else i, "abc"[i % 2] if i % 7 else None, i % 11) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    got = mixing.mix(docs, F.col("size"), F.lit(1.0)).collect()
    assert sorted((r["doc_id"] or 0, r["source"] or "", r["size"], r["taken"]) for r in got) == plain(rows, 1.0)


def test_rows_of_one_key_are_spread(spark):
    rows = spark.range(6000).select(F.lit("a").alias("source"), F.lit(0.5).alias("key"), F.lit(None).cast("long").alias("doc_id"),
                                    F.lit(3).cast("long").alias("size"), F.lit(0).alias("tie"), F.col("id").alias("number"))
    for few in (True, False):
        out = mixing._behind(rows, 12, few)
        assert out.groupBy("range").count().agg(F.max("count")).first()[0] <= 1500
        assert [r["behind"] for r in out.orderBy("number").collect()] == [3 * k for k in range(6000)]


def test_copies_by_content_whatever_the_order_of_rows(spark):
    """Rows of one id and size but different texts: reruns over rows in another order keep the same ones."""
    rows = [(1, f"text {k:03d}", "a", k) for k in range(60)] + [(2, "w " * 50, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    docs = docs.withColumns({"size": F.lit("x"), "tag": F.lit(0), "its": F.lit(1), "mix_size": F.lit(-1), "row_size": F.lit(2),
                             "extra": F.create_map(F.lit("k"), F.col("row"))})
    kept = []
    for order in ("row", "text desc"):
        table = docs.orderBy(F.expr(order.split()[0]).desc() if "desc" in order else F.col(order)).coalesce(1)
        out = mixing.mixed(table, mixing.word_count(F.col("text")), F.lit(1.0), share=0.5)
        assert out.columns == docs.columns
        kept.append(sorted((r["doc_id"], r["text"], r["row"]) for r in out.collect()))
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 61


def test_empty_table(spark, odd):
    assert mixing.mixed(odd.where(F.lit(False)), mixing.word_count(F.col("text")), F.lit(1.0)).count() == 0
