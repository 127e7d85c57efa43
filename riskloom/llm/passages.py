"""Passages of a corpus, and which one follows which: the longest contexts of the language model.

A text is cut behind every word whose hash is a multiple of ``WORDS``, so equal runs of words are cut
alike wherever they stand. A passage is all bytes between two cuts, white space and (for the last one)
the end of the text included, and is told by a 64-bit hash. The context of a passage is the whole
passage before it; the first of a text has none.

For each context the table holds how often training texts went on from it and the passage that came
most often. It has a row for every context of the corpus, so it grows with the corpus; it is never
broadcast, but for its contexts at least as frequent as one in ``FREQUENT``, of which there are at
most ``FREQUENT``.

A passage is coded as the one expected with chance q = its count / (count of the context + ``DOUBT``),
else by the bits of the context-mixing model: its probability is q (if it is the expected one) plus
(1 - q) times that of its bits. Each part adds up to at most one over all passages, so the mixture
does too. A text that was learnt from doesn't count its own passages (``own``), else each would be
cheap for being in the table itself: what it gains is known from other texts, as for held-out ones.
The expected passage stays that of all texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved
from riskloom.llm.textblocks import mix

WORDS = 16
DOUBT = 1.0
FREQUENT = 100_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent modulo 2 ** 64, by squaring."""
    out = np.ones(len(exponents), np.uint64)
    rest = exponents.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * np.uint64(base), out)
        base = base * base % (1 << 64)
        rest = rest >> np.uint64(1)
    return out


def cut(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, ends: np.ndarray, words: np.ndarray):
    """Passages of a block of lower-case texts: (text, start, hash) in order; the first of each text too.

    ``hashes``, ``ends`` and ``words`` are those of its words, as ``textblocks`` has them.
    """
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(words))
    here = (mix(hashes) % np.uint64(WORDS) == 0) & (ends < offsets[1:][of])
    text = np.concatenate([np.arange(n), of[here]])
    start = np.concatenate([offsets[:-1], ends[here]])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.where(last, offsets[text + 1], np.append(start[1:], 0))
    sums = np.zeros(len(data) + 1, np.uint64)
    power = np.full(len(data), _BASE, np.uint64)
    np.cumprod(power, out=power)
    power *= _LETTER[data]
    np.cumsum(power, out=sums[1:])
    content = (sums[end] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), start)
    return text, start, mix(content + ((end - start) * 2 + last).astype(np.uint64) * _GOLD)


def steps(text: np.ndarray) -> np.ndarray:
    """Places of the passages that have another one of their text before them."""
    inner = np.zeros(len(text), bool)
    inner[1:] = text[1:] == text[:-1]
    return np.flatnonzero(inner)


def counted(context: np.ndarray, passage: np.ndarray) -> pa.RecordBatch:
    """Each pair (context, passage) of a block once, with its number."""
    _, first, times = np.unique(mix(context * _GOLD) + passage, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(context[first].view(np.int64)), pa.array(passage[first].view(np.int64)),
                                       pa.array(times)], ["context", "passage", "times"])


def table(pairs: DataFrame) -> DataFrame:
    """(context, seen, expected, times) of each context, from rows (context, passage, times)."""
    whole = pairs.groupBy("context", "passage").agg(F.sum("times").alias("times"))
    most = F.max(F.struct("times", "passage"))
    return saved(whole.groupBy("context").agg(F.sum("times").alias("seen"), most.alias("most"))
                 .select("context", "seen", F.col("most.passage").alias("expected"), F.col("most.times").alias("times")),
                 "passages")


def own(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How often each row's keys occur in its text."""
    whole = mix(text.astype(np.uint64) + _GOLD)
    for key in keys:
        whole = mix(whole * _GOLD + key)
    _, at, times = np.unique(whole, return_inverse=True, return_counts=True)
    return times[at]


def gains(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(row, gain): bits that a passage costs less, from rows (row, context, passage, bits, own_seen, own_times).

    ``own_seen`` and ``own_times`` are what the text itself gave to the context and to the pair.

    Passages whose context the table doesn't know are left out, as they gain nothing. Rows of frequent
    contexts meet them by broadcast, so no context gathers many rows in one task.
    """
    total = known.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    its = known.withColumnRenamed("context", "its_context")
    frequent = F.col("seen") * FREQUENT >= total
    first = rows.join(F.broadcast(its.where(frequent)), F.col("context") == F.col("its_context"), "left")
    rest = first.where("seen is null").select(*rows.columns)
    met = rest.join(its.where(~frequent), F.col("context") == F.col("its_context"))
    both = first.where("seen is not null").unionByName(met)
    as_expected = F.col("passage") == F.col("expected")
    seen = F.col("seen") - F.col("own_seen")
    times = F.greatest(F.lit(0), F.least(seen, F.col("times") - F.when(as_expected, F.col("own_times")).otherwise(0)))
    sure = times / (seen + F.lit(DOUBT))
    as_bits = (1 - sure) * F.pow(F.lit(2.0), -F.col("bits"))  # 0 if the bits are too many, which is near enough
    gain = F.when(as_expected & (times > 0), F.col("bits") + F.log2(sure + as_bits)).otherwise(F.log2(1 - sure))
    return both.select("row", gain.alias("gain"))
