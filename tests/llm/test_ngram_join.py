import collections
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import riskloom.llm.ngram_join as module
from riskloom.llm.ngram_join import keep_one, similar_classes
from riskloom.llm.prefix_tree import similar_links

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(a, b):
    both = len(a & b)
    return both and 100 * both >= 80 * (len(a) + len(b) - both)


def brute(rows):
    """(id, size, component) of each row; null ids link with nothing."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def as_rows(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_all_documents_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(similar_classes(docs)) == brute(rows)


def test_odd_rows_and_clashing_columns(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    more = odd.withColumns({c: F.lit(1) for c in ("id", "tag", "n", "sig", "row", "root", "kind")})
    assert as_rows(similar_classes(more)) == brute(rows)


def test_groups_larger_than_a_block_and_near_the_threshold(documents, monkeypatch):
    import riskloom.llm.ngram_join as module
    monkeypatch.setattr(module, "GROUP", 8)
    monkeypatch.setattr(module, "SIFTED", 4)
    random = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in random.choice(60, int(random.integers(0, 4)), replace=False):
            own[k] = f"v{int(random.integers(3))}"
        rows.append((i, " ".join(own), "s"))
    assert as_rows(similar_classes(documents(rows))) == brute([r[:2] for r in rows])


def test_a_hot_shingle_deals_few_sets_of_a_task():
    """Copies and near copies that share their first shingles leave the reading task as a few sets."""
    texts = [" ".join(f"w{k}" for k in range(60 + i % 12)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "text": texts})
    rows = [r for out in module._deal(SimpleNamespace(value=np.zeros(16, np.uint8)), 5, 80, 4)(iter([batch]))
            for r in out.to_pylist()]
    dealt = collections.Counter(x for r in rows if r["size"] for x in np.frombuffer(r["token"], np.uint64).tolist())
    assert dealt and max(dealt.values()) <= 3
    ends = [np.frombuffer(r[c], np.int64) for r in rows if not r["size"] for c in ("token", "sig")]
    assert len(np.unique(np.concatenate(ends))) == 12


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60)), min_size=1, max_size=30), st.integers(1, 5))
def test_sets_that_stand_for_others_lose_no_candidate(rows, chunks):
    """Joining in chunks, then what is left of them, gives the components of all pairs under the bound."""
    token, size = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32)
    sig = np.arange(len(rows)) % 20
    size = size[sig]  # equal sets have equal sizes
    links, left = [(i, i) for i in sig.tolist()], []
    for k in range(chunks):
        *kept, a, b = module._joined(token[k::chunks], sig[k::chunks], size[k::chunks], 80)
        left.append(kept)
        links += zip(a.tolist(), b.tolist())
    *_, a, b = module._joined(*(np.concatenate(x) for x in zip(*left)), 80)
    links += zip(a.tolist(), b.tolist())
    wanted = [(sig[i], sig[j]) for i in range(len(rows)) for j in range(i)
              if token[i] == token[j] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])]

    def classes(pairs):
        root = list(range(20))
        for _ in range(20):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root
    assert classes(links) == classes(wanted)


def test_empty_table(documents):
    assert similar_classes(documents([])).count() == 0


def test_keep_one_row_of_each_class(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert max(left.values()) == 1
    # Both rows without an id stay; of the two equal rows of document 5, and of 9 and 10, one each.
    assert sorted((d or 0) for d, _ in left) == [0, 0, 1, 2, 3, 5, 5, 7, 8, 9, 11]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30), min_size=1, max_size=20), min_size=2, max_size=12, unique_by=tuple))
def test_prefix_tree_connects_what_brute_force_does(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    a, b = similar_links(arrays, 80)

    def classes(pairs):
        root = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root
    wanted = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    assert classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(wanted) or \
        classes(list(zip(a.tolist(), b.tolist(), strict=True))) == classes(wanted)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(3, 1), (1, 3), (3, 1)], [(i, i + 1) for i in range(300)] + [(900, 1000)]])
def test_components(spark, links):
    from riskloom.llm.components import components
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = {n: 900 if n >= 900 else 0 if len(links) > 5 else 1 for n in nodes}
    assert got == want


def test_long_texts_that_share_a_phrase_form_no_group(spark, documents):
    """Each text shares a phrase with the next one: one candidate group of all, if a shared shingle were enough."""
    texts = [" ".join([f"p{i}x{k}" for k in range(14)] + [f"t{i}x{k}" for k in range(400)] +
                      [f"p{i + 1}x{k}" for k in range(14)]) for i in range(60)]
    texts += [texts[7] + " once more", "and " + texts[7], texts[9]]
    docs = documents([(i, t, "s") for i, t in enumerate(texts)]).withColumnRenamed("doc_id", "id").select("id", "text")
    sizes = similar_classes(docs, ident="id").select(F.col("n_shingles").alias("n"))
    ranks = spark.sparkContext.broadcast(np.zeros(16, np.uint8))
    groups = module.candidate_groups(docs, sizes, ranks, 5, 80).groupBy("root").count().collect()
    assert [r["count"] for r in groups] == [3]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 4), st.integers(1, 4), st.sampled_from([2, 8, 32]), st.sampled_from([3, 1024]))
def test_similar_sets_are_always_candidates(seed, few_read, few, extra, crowd):
    """Near copies whose shingles are held by few, by many or by both stay in one candidate group."""
    random = np.random.default_rng(seed)
    base = [random.integers(1, 400, int(random.integers(1, 90))) for _ in range(6)]
    sets = []
    for _ in range(50):
        own = base[int(random.integers(6))].copy()
        change = random.random(len(own)) < random.choice([0, 0.03, 0.1])
        own[change] = random.integers(1, 10 ** 6, change.sum())
        sets.append(np.unique(own))
    sets = [np.array(s, np.uint64) for s in {tuple(s.tolist()) for s in sets}]
    before = {k: getattr(module, k) for k in ("FEW_READ", "FEW", "EXTRA", "CROWD", "HELD", "PACKED")}
    try:
        module.FEW_READ, module.FEW, module.EXTRA, module.CROWD, module.HELD, module.PACKED = few_read, few, extra, crowd, 100, 50
        links, rows = [], []
        for part in range(3):
            n = np.array([len(s) for s in sets[part::3]])
            first = n - (n * 80 + 99) // 100 + module._extra(n, 80)
            left, (a, b), (hot, times, prone) = module._linked(
                np.concatenate([s[:k] for s, k in zip(sets[part::3], first)]),
                np.repeat(np.arange(part, len(sets), 3), first), np.repeat(n, first), 80, few_read)
            links += zip(a.tolist(), b.tolist())
            cuts = range(0, len(left[0]), 60)  # as batches, so that a task holds too much now and then
            rows += [[x[i:i + 60].astype(t).tobytes() for x, t in zip(left, (np.uint64, np.int64, np.int32))] + [b""] for i in cuts]
            rows.append([hot.astype(np.uint64).tobytes(), hot.astype(np.int64).tobytes(), b"",
                         np.stack([times, prone], 1).astype(np.int32).tobytes()])
        batches = [pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in r], ["token", "sig", "size", "times"]) for r in rows]
        met = pa.Table.from_batches(list(module._meet(80)(iter(batches)))).to_pylist()
        pairs, hot = collections.Counter(), collections.Counter()
        links += [(r["a"], r["b"]) for r in met if r["kind"] == module.LINK]
        for r in met:
            pairs[r["a"], r["b"], r["m"]] += r["n"] if r["kind"] == module.PAIR else 0
            hot[r["a"], r["m"]] += r["n"] if r["kind"] == module.HOT_COUNT else 0
        links += [(a, b) for (a, b, m), n in pairs.items() if m is not None and n >= m]
        bits = np.zeros(1 << module.FILTER_BITS, bool)
        bits[module._bits(np.array([a for (a, m), n in hot.items() if m is not None and n >= m], np.int64))] = True
        for r in met:
            if r["kind"] == module.HOT:
                one = pa.RecordBatch.from_arrays([pa.array([r[c]], pa.binary()) for c in ("token", "sig", "size")], ["token", "sig", "size"])
                for found in module._hot_links(SimpleNamespace(value=np.packbits(bits)), 80)(iter([one])):
                    links += zip(found.column("a").to_pylist(), found.column("b").to_pylist())
    finally:
        for k, v in before.items():
            setattr(module, k, v)
    node, root = module.forest(np.array([x[0] for x in links] + [0]), np.array([x[1] for x in links] + [0]))
    of = dict(zip(node.tolist(), root.tolist()))
    for i in range(len(sets)):
        for j in range(i):
            if similar(set(sets[i].tolist()), set(sets[j].tolist())):
                assert of.get(i, i) == of.get(j, j)
