"""Words and word shingles of whole blocks of texts as numpy arrays.

A block is the UTF-8 of several texts, one after the other, and their offsets. Words are runs of
bytes other than the six ASCII white-space characters. Hashes are 64 bits wide; they are the same on
every machine and in every run.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words beyond this many bytes are hashed by a library function.
LONG_WORD = 64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLD = 0x9E3779B97F4A7C15
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range; a bijection."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _odd(n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD))) | np.uint64(1)


_PLACE = _odd(16)


def texts_of(column) -> pa.Array:
    """One large-string array without nulls: a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        yield low, high, data[ends[low]:ends[high]], ends[low:high + 1] - ends[low]
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = solid[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(_GOLD) + (eight[starts] & _KEEP[np.minimum(length, 8)]))
    rest = np.flatnonzero(length > 8)
    done = 8
    while len(rest) and done < LONG_WORD:
        left = length[rest] - done
        h[rest] = mix(h[rest] * np.uint64(_GOLD) ^ (eight[starts[rest] + done] & _KEEP[np.minimum(left, 8)]))
        rest, done = rest[left > 8], done + 8
    for i in rest:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(hashes: np.ndarray, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, and their bounds by text.

    A text of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    count = np.diff(words)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(count)), many)
    at = np.arange(bounds[-1]) - bounds[text] + words[text]
    h = np.minimum(count, size)[text].astype(np.uint64) * np.uint64(_GOLD)
    for k in range(size):
        inside = at + k < words[text + 1]
        h += np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)] * _PLACE[k], np.uint64(0)) if len(hashes) else h
    return mix(h), bounds


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    if len(values):
        fresh[1:] = values[1:] != values[:-1]
        fresh[bounds[:-1][bounds[:-1] < len(values)]] = True
    sums = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], sums[bounds]
