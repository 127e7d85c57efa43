"""How document filters overlap, in every order they could be applied in.

Each document fails any of ``n`` filters, so it has one of 2^n failure masks. What a coalition of filters
removes is the number of documents whose mask meets it; all 2^n removals follow from the counts of the
masks. From them come, exactly,

* the figures of every step of every order, as differences of coalition removals, and
* the Shapley value of every filter, as the solution of a least-squares problem: over all coalitions S
  that are neither empty nor full, with the kernel weight (n - 1) / (C(n, |S|) |S| (n - |S|)), additive
  values come as near as they can to the removals, under the constraint that they add up to what all
  filters remove. The normal equations with that constraint are solved in rational numbers.

Spark counts the masks of each part; a part then is at most 2^n rows, and parts are worked on apart from
each other, however many there are.

``failures`` judges documents by five filters of their texts, A to E. A null text is an empty one, a null
language the part ``''``. E asks whether the same text has a smaller id anywhere in the table, known by
SHA-256; a document without an id has no smaller one and isn't a smaller one to others. Equal rows count
once each. A document counts as good or toxic if any label row of its id says so. Copies are collapsed
inside each task before they meet, and the first of each text is found by joining on text and id together,
so that neither a text nor an id that fills a third of the table makes one task large.

Empty table: an empty result.
"""

import hashlib
import re
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved
from riskloom.llm.textblocks import texts_of

#: Letters of the filters; the k-th one is bit k of a failure mask.
NAMES = "ABCDE"
#: Least words, least distinct words and most capitals in 100, signs that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"

CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
PIECE = 4 << 20


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text; a long one is read piece by piece."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    count, known, at = 0, set(), 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        count, at = count + len(words), end
        known.update(words)
    return count, len(known)


def text_mask(text: bytes) -> int:
    """Failures A to D of a text in UTF-8."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return ((words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def failures(docs: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, n): how many documents of an id and part have each failure mask."""
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            mask, key = [], []
            for value in texts:
                body = value.as_buffer()
                body = body.to_pybytes() if body is not None else b""
                mask.append(text_mask(body))
                key.append(hashlib.sha256(body).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(mask, pa.int32()),
                                              pa.array(key, pa.binary())], ["id", "part", "mask", "key"])

    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).alias("text"))
    facts = saved(rows.mapInArrow(work, f"id {kind}, part string, mask int, key binary")
                  .groupBy("id", "part", "mask", "key").agg(F.count("*").alias("n")), "facts")
    first = facts.where(F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(1))
    again = F.col("id").isNotNull() & F.col("is_first").isNull()
    return (facts.join(first, ["key", "id"], "left")
            .withColumn("mask", F.col("mask") + F.when(again, 16).otherwise(0))
            .groupBy("id", "part", "mask").agg(F.sum("n").alias("n")))


def tabulate(failed: DataFrame, labels: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): counts of each failure mask in each part."""
    known = labels.select(F.col(ident).alias("id"), F.col("quality"), F.col("toxic")).where(F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                    F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))

    def lost(flag: str):
        return F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0))).alias(flag)

    return (failed.join(known, "id", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), lost("good"), lost("toxic")))


def removals(counts: list[int]) -> list[int]:
    """What each coalition removes, from the number of documents of each mask."""
    return [sum(c for mask, c in enumerate(counts) if mask & coalition) for coalition in range(len(counts))]


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Solution of a regular system of equations by elimination in rationals."""
    rows = [[*a, b] for a, b in zip(matrix, right)]
    n = len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [a / rows[k][k] for a in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [a - rows[i][k] * b for a, b in zip(rows[i], rows[k])]
    return [row[n] for row in rows]


def shapley(removed: list[int], n: int) -> list[Fraction]:
    """Values of the filters: kernel-weighted least squares under the efficiency constraint."""
    normal = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * n + [Fraction(removed[-1])]
    for coalition in range(1, (1 << n) - 1):
        inside = [i for i in range(n) if coalition >> i & 1]
        weight = Fraction(n - 1, comb(n, len(inside)) * len(inside) * (n - len(inside)))
        for i in inside:
            right[i] += weight * removed[coalition]
            for j in inside:
                normal[i][j] += weight
    for i in range(n):
        normal[i][n] = normal[n][i] = Fraction(1)
    return solve(normal, right)[:n]


def steps(counts: dict[str, list[int]], names: str = NAMES):
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counts`` has documents by mask under n, good and toxic. The last figure is what the filter removes
    in all orders together, at whatever step: the number of orders times its Shapley value.
    """
    n, total = len(names), sum(counts["n"])
    removed, good, toxic = (removals(counts[k]) for k in ("n", "good", "toxic"))
    value = [v * factorial(n) for v in shapley(removed, n)]
    everything = (1 << n) - 1
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            bit = 1 << i
            now = before | bit
            here = removed[now] - removed[before]
            yield ("".join(names[j] for j in order), step, total - removed[now], here, removed[bit] - here,
                   removed[everything] - removed[everything ^ bit], good[now] - good[before],
                   toxic[now] - toxic[before], int(value[i]))
            before = now


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def interactions(table: DataFrame, names: str = NAMES) -> DataFrame:
    """Every step of every order for each part of ``tabulate``'s counts."""
    parts = table.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def work(batches):
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                counts = {k: [0] * (1 << len(names)) for k in ("n", "good", "toxic")}
                for m in masks:
                    for k in counts:
                        counts[k][m["mask"]] = m[k]
                columns = zip(*((part, *row) for row in steps(counts, names)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    return parts.mapInArrow(work, RESULT)


def audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    return interactions(tabulate(failures(docs, ident, text, part), labels, ident))
