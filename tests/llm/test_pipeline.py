"""The pipeline's stages, each held against a plain version of it on its own input."""

import collections
import re

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute

import corpus_pipeline
from riskloom.llm import quality
from riskloom.llm.scratch import saved
from riskloom.llm.secrets import RULES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    tables = [spark.read.parquet(sf_dir + "/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], sf_dir), name))
    return dict(zip(["documents", *[n for n, _ in corpus_pipeline.STAGES]], tables))


def test_columns(steps):
    assert all(t.columns == COLUMNS for n, t in steps.items() if n != "pieces")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "pieces"]


def test_quality_keeps_what_scores_high(spark, sf_dir, steps):
    model = quality.learn(steps["documents"], spark.read.parquet(sf_dir + "/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(steps["documents"], model).where(F.col("score") >= quality.THRESHOLD).collect()}
    assert sorted(r["doc_id"] for r in steps["quality"].collect()) == sorted(want)


def test_one_of_each_class_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps["quality"].collect()]
    want = sorted({c for _, _, c in brute(rows)})
    assert sorted(r["doc_id"] for r in steps["near_duplicates"].collect()) == want


def redacted(text):
    cuts = sorted((m.start(), m.end()) for r in RULES for m in re.finditer(r.pattern, text, re.I if r.any_case else 0)
                  if len(m[r.group]) >= r.least)
    out, at = "", 0
    for i, (a, b) in enumerate(cuts):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_secrets_are_gone(steps):
    want = {r["doc_id"]: redacted(r["text"]) for r in steps["near_duplicates"].collect()}
    assert {r["doc_id"]: r["text"] for r in steps["secrets"].collect()} == want


def test_sources_come_near_their_targets(steps):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    have, took, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in steps["secrets"].collect():
        have[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in steps["mixing"].collect():
        took[r["source"]] += size(r["text"])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(have))}
    target, full, left = {}, set(), 1.5 * sum(have.values())
    while True:
        rest = [s for s in have if s not in full]
        level = (left - sum(2 * have[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * have[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * have[s] if s in full else level * weight[s] for s in have}
    assert all(abs(took[s] - target[s]) <= largest[s] / 2 + 1 for s in have)


def test_pieces_of_all(spark, sf_dir, steps):
    rows = steps["pieces"].collect()
    assert len(rows) == steps["mixing"].count() and all(r["lossless"] for r in rows)
    again = collections.Counter((r["doc_id"], tuple(r["pieces"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert again == collections.Counter((r["doc_id"], tuple(r["pieces"])) for r in rows)


def test_odd_rows_come_through(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not lossless").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)), "empty")
        assert docs.count() == 0
