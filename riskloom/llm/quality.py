"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document is counted as hashed words, pairs of neighbouring characters (letters by class) and
repeated words. Counts are damped, weighted by rarity among the labelled documents and projected on
the leading singular vectors of their matrix. The labelled vectors are broadcast (``SAMPLE`` rows of
``RANK`` numbers at most, whatever the input) and every document is compared with all of them in
blocks of exact cosine products; its ``NEIGHBOURS`` nearest vote with their labels.

Only the text is an input. Learning uses at most ``SAMPLE`` labelled rows, the first ones in the
order of the md5 of their id.

Defined cases: a null text is empty; a text without words has no direction, so all labelled rows
vote alike; without any labelled row the score is 1 (nothing is known against the text); repeated
ids are rows of their own; several labels of an id count as its highest one; null labels are left
out; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.scratch import lean
from riskloom.llm.textblocks import LOWER, SPACE, blocks, texts_of, word_hashes, word_spans

#: Labelled documents to learn from, at most; these bound what is broadcast.
SAMPLE = 4000
RANK = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Votes weigh as the similarity to this power.
SHARPNESS = 4

WORD_BINS = 2048
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[SPACE] = 3
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(4, 4 + len(_MARKS))
_CLASS[:9] = _CLASS[14:32] = 4 + len(_MARKS)
N_CLASS = 5 + len(_MARKS)
REPEAT_BINS = 24
WIDTH = WORD_BINS + N_CLASS * N_CLASS + REPEAT_BINS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of every text of a block, a row of ``WIDTH`` numbers each."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, words = word_spans(low, offsets)
    h = word_hashes(low, starts, ends)
    of = np.repeat(np.arange(n), np.diff(words))
    bags = np.bincount(of * WORD_BINS + (h % np.uint64(WORD_BINS)).astype(np.int64),
                       minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    kinds = _CLASS[data]
    pair = kinds[:-1] * N_CLASS + kinds[1:]
    text = np.repeat(np.arange(n), np.diff(offsets))
    inside = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    wide = N_CLASS * N_CLASS
    pairs = np.bincount((text[:-1] * wide + pair)[inside], minlength=n * wide).reshape(n, wide)
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n)
    count = np.diff(words)
    share = again / np.maximum(count, 1)
    repeats = np.zeros((n, REPEAT_BINS))
    repeats[np.arange(n), np.minimum((share * 8).astype(int), 7)] = 1
    repeats[np.arange(n), 8 + np.minimum(np.log2(count + 1).astype(int), 15)] = 1
    return np.concatenate([_damped(bags), _damped(pairs), 0.5 * repeats * (count > 0)[:, None]],
                          axis=1, dtype=np.float32)


def _damped(counts: np.ndarray) -> np.ndarray:
    damped = np.log1p(counts.astype(np.float32))
    return damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Neighbours:
    """Labelled vectors, and the projection that makes them."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        own = _unit((counts * self.rarity) @ self.axes)
        near = own @ self.vectors.T
        k = min(neighbours, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 1e-3).astype(np.float64) ** SHARPNESS
        votes = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.where(np.abs(own).sum(1) > 0, votes, self.labels.mean())


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Neighbours:
    """Weights and axes of the rows of ``counts``, which is weighted in place to save the driver's memory."""
    rarity = (1 + np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0)))).astype(np.float32)
    counts *= rarity
    random = np.random.default_rng(7).standard_normal((counts.shape[1], min(rank + 16, len(counts))), dtype=np.float32)
    span = np.linalg.qr(counts @ random)[0]
    for _ in range(3):
        span = np.linalg.qr(counts @ (counts.T @ span))[0]
    axes = np.linalg.svd(span.T @ counts, full_matrices=False)[2][:rank].T.astype(np.float32)
    return Neighbours(rarity, axes, _unit(counts @ axes).astype(np.float32), labels.astype(np.float64))


def _sent(spark: SparkSession, model: Neighbours | None):
    """A broadcast of the model's arrays, and the function that makes the model of them in a task."""
    shared = spark.sparkContext.broadcast(model and (model.rarity, model.axes, model.vectors, model.labels))
    return lambda: Neighbours(*shared.value) if shared.value else None


def is_held_out(ident: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text",
          ident: str = "doc_id", label: str = "quality") -> Neighbours | None:
    """Fits on at most ``sample`` labelled rows that aren't held out; their counts come to the driver."""
    chosen = (labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(ident)))
              .groupBy(F.col(ident).alias("chosen")).agg(F.max(label).alias("label"))
              .orderBy(F.md5(F.col("chosen").cast("string")), "chosen").limit(sample))
    rows = (docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), F.col("id") == F.col("chosen")))

    def count(batches):
        for batch in batches:
            for low, high, data, offsets in blocks(texts_of(batch.column("text"))):
                rows = features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], batch.column("label")[low:high],
                     pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())],
                    ["id", "label", "counts"])

    kind = dict(docs.dtypes)[ident]
    # Repeated ids are few only by luck, so the limit holds for rows as well.
    found = (rows.select("id", F.col("label").cast("int").alias("label"), "text")
             .mapInArrow(lean(count), f"id {kind}, label int, counts binary").orderBy("id", "counts").limit(sample).toArrow())
    if not found.num_rows:
        return None
    labels, counts = found.column("label").to_numpy(), np.empty((found.num_rows, WIDTH), np.float32)
    for i, row in enumerate(found.column("counts")):
        counts[i] = np.frombuffer(row.as_buffer(), np.float16)
    del found, row
    return fit(counts, labels)


def score(docs: DataFrame, model: Neighbours | None, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, score)."""
    received = _sent(docs.sparkSession, model)

    def judge(batches):
        its = received()
        for batch in batches:
            for low, high, data, offsets in blocks(texts_of(batch.column("text"))):
                values = its.score(features(data, offsets)) if its else np.ones(high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], pa.array(values)], ["doc_id", "score"])

    kind = dict(docs.dtypes)[ident]
    return (docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(lean(judge), f"doc_id {kind}, score double"))


def keep_good(docs: DataFrame, model: Neighbours | None, text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``, all columns as they were."""
    received = _sent(docs.sparkSession, model)
    at = docs.columns.index(text)

    def judge(batches):
        its = received()
        for batch in batches:
            if its is None or not batch.num_rows:
                yield batch
                continue
            values = np.concatenate([its.score(features(data, offsets))
                                     for _, _, data, offsets in blocks(texts_of(batch.column(at)))])
            yield batch.filter(pa.array(values >= threshold))

    return docs.mapInArrow(lean(judge), docs.schema)
