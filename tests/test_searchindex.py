"""Indexed search against the plain one, and what the index lets it leave out."""

import random
import re

import pytest

from riskloom.operators import searchindex
from riskloom.operators.filters import search

PATTERNS = ["token 17", "TOKEN 17$", "^token 4", "a.c", "x|y", "(abc)", "ab+cde", "abcd?e", "ab", "", " abc ", r"1\.5", r"abc\d", "zzz{2}top",
            "[a]bc", r"\x41bc", "Ünï", "ünï", "nothing here", "word.*tail", "İst", r"\\d", "aaa*bbb", "q{", "É", r"\bword"]


@pytest.fixture(scope="module")
def stored(spark):
    from riskloom.session import scratch_path
    path = scratch_path(spark, "search")
    pick = random.Random(6)
    texts = ["abc", "ABCDE", "abcde", "abbcde", "abce", "word and tail", "xyz", "Ünï code", "ÜNÏ", "İstanbul", "1.5", "abc7", "zzztop", "zztop", "\\d",
             "a\nc", "aabbb", "É", "aaaabbb", "q{", "", None]
    rows = [(k, pick.choice(texts), f"token {k // 10}", float(k), pick.choice([None, "ab"])) for k in range(400)]
    spark.createDataFrame(rows, "tx_id long, t string, u string, d double, v string").repartitionByRange(20, "tx_id").write.parquet(path)
    df = spark.read.parquet(path)
    searchindex.build_index(df, path + "-index")
    return path, df


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows(spark, stored, pattern):
    path, df = stored
    want = None
    try:
        want = sorted(r.tx_id for r in search(df, pattern).collect())
    except Exception:  # noqa: BLE001
        pytest.skip("not a pattern")
    assert sorted(r.tx_id for r in searchindex.search_indexed(spark, df, path + "-index", pattern).collect()) == want


def test_fewer_files_are_read(spark, stored):
    path, df = stored
    assert len(df.inputFiles()) == 20
    found = searchindex.matching_files(spark, df, path + "-index", "token 17")
    assert len(found) == 1
    assert searchindex.matching_files(spark, df, path + "-index", "no such text") == []
    assert len(searchindex.matching_files(spark, df, path + "-index", "to|no")) == 20
    plan = searchindex.search_indexed(spark, df, path + "-index", "token 17")
    assert len(plan.inputFiles()) == 1


def test_files_after_the_index_are_searched(spark, stored):
    path, df = stored
    more = path + "-more"
    df.write.parquet(more)
    searchindex.build_index(spark.read.parquet(more), more + "-index")
    spark.createDataFrame([(9999, "token 17", "x", 1.0, None)], df.schema).write.mode("append").parquet(more)
    grown = spark.read.parquet(more)
    got = searchindex.search_indexed(spark, grown, more + "-index", "token 17")
    assert {r.tx_id for r in got.collect()} == {*range(170, 180), 9999}


def test_certain_texts_are_in_every_match():
    pick = random.Random(1)
    for _ in range(20_000):
        pattern = "".join(pick.choices(["a", "b", "C", ".", "*", "+", "?", "{2}", "\\d", "\\.", "^", "$", "(a)", "|", "[ab]", "\\t", " "], k=pick.randint(1, 7)))
        try:
            rule = re.compile(pattern)
        except re.error:
            continue
        text = "".join(pick.choices("abC.1 \t", k=6))
        hit = rule.search(text)
        if hit:
            assert all(t in hit.group() for t in searchindex.certain_texts(pattern)), (pattern, text)


def test_texts_of_a_pattern():
    assert searchindex.certain_texts(r"ab+cd?ef.*gh\.i\dj{0,3}k") == ["ab", "c", "ef", "gh.i", "k"]
    assert searchindex.pieces("VENCida") == ["cid", "enc", "ida", "nci", "ven"]
