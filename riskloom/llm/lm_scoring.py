"""Scores of texts by a context-mixing model, next to those of a smoothed count of words.

Training gathers three things from every training text: the bit counters of ``context_mixing``, the
number of times each word occurs, and which passage follows which (``passages``). The bits of each
passage of a text are mixed with what the table of passages expects there; that table is joined, so
the model grows with the corpus. Words at least as frequent as one in ``COMMON`` are broadcast (so
there are at most ``COMMON`` of them); the rest stays a table, and the rare words of each text find
their counts there by a join, in which no key can be frequent.

Words are told apart by 64-bit hashes. The end of a text counts as one word.

Defined cases: as in ``context_mixing``; without any training text the count score is 0, as then
every token has one chance in one.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import context_mixing, passages
from riskloom.llm.scratch import saved
from riskloom.llm.textblocks import LOWER, blocks, texts_of, word_hashes, word_spans

COMMON = 1_000_000
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 1 << 20
#: The hash that stands for the end of a text; the words with it (one in 2 ** 64) count as ends.
END = np.uint64(0)


def _words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ends of the words of lower-case texts, and for each text the number of words before it."""
    starts, ends, words = word_spans(low, offsets)
    return word_hashes(low, starts, ends), ends, words


def _counts(batches):
    """Rows of kind 0 for each word with its number, of kind 1 for each pair of passages."""
    kept, held = [], 0

    def rows(kind, context, what, count):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(what), kind, np.int32)), context, what, count],
                                          ["kind", "context", "passage", "times"])

    def out():
        word, at = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
        count = np.bincount(at, np.concatenate([c for _, c in kept])).astype(np.int64)
        return rows(0, pa.nulls(len(word), pa.int64()), pa.array(word.view(np.int64)), pa.array(count))

    for batch in batches:
        for low, high, data, offsets in blocks(texts_of(batch.column("text"))):
            data = LOWER[data]
            h, ends, words = _words(data, offsets)
            text, _, passage = passages.cut(data, offsets, h, ends, words)
            after = passages.steps(text)
            yield rows(1, *passages.counted(passage[after - 1], passage[after]).columns)
            word, count = np.unique(h, return_counts=True)
            kept.append((np.append(word, END), np.append(count, high - low)))
            held += len(word)
            if held > HELD_WORDS:
                yield out()
                kept, held = [], 0
    if kept:
        yield out()


class Scorer:
    """A trained model: bit odds, common words with their counts, rare ones and passages as tables."""

    def __init__(self, model, common_words, common_counts, rare: DataFrame, follows: DataFrame, tokens: int, kinds: int):
        self.model, self.words, self.counts = model, common_words, common_counts
        self.rare, self.follows, self.tokens, self.kinds = rare, follows, tokens, kinds


def train(docs: DataFrame, text: str = "text") -> Scorer:
    """Learns from every row of ``docs``."""
    texts = docs.select(F.col(text).alias("text"))
    gathered = saved(texts.mapInArrow(_counts, "kind int, context long, passage long, times long")
                     .groupBy("kind", "context", "passage").agg(F.sum("times").alias("times")), "lm_counts", "kind")
    counts = gathered.where("kind = 0").select(F.col("passage").alias("word"), F.col("times").alias("count"))
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    is_common = F.col("count") * COMMON >= tokens
    common = counts.where(is_common).orderBy("word").toArrow()
    words = common.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Scorer(context_mixing.train(docs, text), words[order], common.column("count").to_numpy()[order],
                  counts.where(~is_common), passages.table(gathered.where("kind = 1")), int(tokens), int(kinds))


def _parts(shared):
    """Rows of kind 0 for each text, of kind 1 for each rare word and of kind 2 for each passage of it."""
    def work(batches):
        tables, words, counts = shared.value
        model = context_mixing.Model(tables)
        logs = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, data, offsets in blocks(texts_of(batch.column("text")), 16 << 20):
                costs = context_mixing.all_costs(model, data, offsets)
                n = high - low
                ids, learnt = batch.column("id")[low:high], batch.column("learnt")[low:high].to_numpy(False).astype(bool)
                for a in range(0, n, 1000):
                    b = min(n, a + 1000)
                    part = offsets[a:b + 1] - offsets[a]
                    yield from _rows(words, logs, row + a, ids[a:b], learnt[a:b], costs[offsets[a] + a:offsets[b] + b],
                                     LOWER[data[offsets[a]:offsets[b]]], part)
                row += n
    return work


NAMES = ["kind", "row", "id", "n_tokens", "n_known", "logs", "bits", "n_bytes", "word", "times", "passage", "own"]


def _rows(words, logs, row, ids, learnt, costs, data, offsets):
    n = len(offsets) - 1
    h, ends, bounds = _words(data, offsets)
    where, start, passage = passages.cut(data, offsets, h, ends, bounds)
    bits = np.add.reduceat(costs, start + where, dtype=np.float64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    h, text = np.concatenate([h, np.full(n, END)]), np.concatenate([text, np.arange(n)])
    at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    known = words[at] == h if len(words) else np.zeros(len(h), bool)
    total = np.bincount(text[known], logs[at[known]], n) if known.any() else np.zeros(n)

    def batch(kind, its_row, **more):
        k = len(its_row)
        types = {"id": ids.type, "logs": pa.float64(), "bits": pa.float64()}
        columns = {"kind": np.full(k, kind, np.int32), "row": row + its_row, **more}
        return pa.RecordBatch.from_arrays([
            pa.nulls(k, types.get(c, pa.int64())) if c not in columns
            else columns[c] if c == "id" else pa.array(columns[c]) for c in NAMES], NAMES)

    yield batch(0, np.arange(n), id=ids, n_tokens=np.diff(bounds) + 1, n_known=np.bincount(text[known], minlength=n),
                logs=total, bits=np.bincount(where, bits, n), n_bytes=np.diff(offsets) + 1)
    after = passages.steps(where)
    where, context, passage, bits = where[after], passage[after - 1], passage[after], bits[after]
    yield batch(2, where, word=context.view(np.int64), passage=passage.view(np.int64), bits=bits,
                times=passages.own(where, context) * learnt[where], own=passages.own(where, context, passage) * learnt[where])
    h, text = h[~known], text[~known]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    yield batch(1, text[first], word=h[first].view(np.int64), times=np.diff(np.append(first, len(h))))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", ident: str = "doc_id",
          learnt: Column | None = None) -> DataFrame:
    """One row per document: (doc_id, n_tokens, n_known, base_score, score, bits, bits_per_byte).

    ``score`` and ``base_score`` are log10 probabilities of the whole text; ``bits`` is the length of
    its code, spread over its UTF-8 bytes and its end in ``bits_per_byte``. ``learnt`` is true for rows
    that the scorer learnt from; their own passages don't count.
    """
    shared = docs.sparkSession.sparkContext.broadcast((scorer.model.tables, scorer.words, scorer.counts))
    kind = dict(docs.dtypes)[ident]
    learnt = F.lit(False) if learnt is None else F.coalesce(learnt, F.lit(False))
    texts = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), learnt.alias("learnt"))
    rows = saved(texts.mapInArrow(
        _parts(shared), f"kind int, row long, id {kind}, n_tokens long, n_known long, logs double, bits double,"
                        " n_bytes long, word long, times long, passage long, own long"), "lm_parts", "kind")
    counted = scorer.rare.select(F.col("word").alias("its_word"), "count")
    rare = (rows.where("kind = 1").select("row", "word", "times")
            .join(counted, F.col("word") == F.col("its_word"))
            .select("row", "times", (F.col("times") * F.log10(F.col("count") + 1)).alias("logs"), F.lit(0.0).alias("gain")))
    met = passages.gains(rows.where("kind = 2").select("row", F.col("word").alias("context"), "passage", "bits",
                                                          F.col("times").alias("own_seen"), F.col("own").alias("own_times")),
                         scorer.follows)
    more = (rare.unionByName(met.select("row", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("logs"), "gain"))
            .groupBy(F.col("row").alias("its_row"))
            .agg(F.sum("times").alias("more_known"), F.sum("logs").alias("more_logs"), F.sum("gain").alias("gain")))
    whole = float(np.log10(scorer.tokens + scorer.kinds + 1))
    bits = F.col("bits") - F.coalesce("gain", F.lit(0.0))
    return (rows.where("kind = 0").select("row", "id", "n_tokens", "n_known", "logs", "bits", "n_bytes")
            .join(more, F.col("row") == F.col("its_row"), "left")
            .select(F.col("id").alias("doc_id"), "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
                    (bits * -float(np.log10(2.0))).alias("score"), bits.alias("bits"),
                    (bits / F.col("n_bytes")).alias("bits_per_byte")))
