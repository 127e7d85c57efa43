"""Exact n-gram Jaccard join by prefix trees: groups of documents linked by similar shingle sets.

All sets are ordered by one global order: shingles that look rare in a count sketch of the whole
corpus come first, ties by hash. Two sets that reach the threshold share at least ``k`` of the first
``n - ceil(t n) + k`` shingles of each, where ``k`` grows with the smaller one (``_extra``), so

1. a pass over the texts fills the sketch (a fixed number of slots, whatever the input) and gives
   each text the size and signature of its set;
2. a second pass deals those first shingles over tasks. Of a shingle that at most ``FEW`` sets hold, the
   pairs under the length bound are counted, and a pair that meets in half of its ``k`` is a
   candidate; so long texts that share a phrase or two by chance don't grow into one huge group.
   What else a pair shares are hot shingles, held by more sets: those of them with
   enough hot ones for that are linked along each hot shingle. The task that reads the texts links
   at once the sets of a shingle that more than ``FEW_READ`` of its own hold, copies and near copies alike, and
   deals of these only a few, of sizes that any further candidate passes the bound with: at most two
   for each growth by 1 / threshold. So what a hot shingle brings to one task grows with the number
   of reading tasks and not with its rows, and pairs are kept of a bounded number of sets a shingle;
   texts with equal sets are one set from here on;
3. components of the candidate graph are the groups that can hold links. Parity maps of the sets (a
   bit or two for each item) split small groups by a bound on how much two sets differ, which loses
   no link. The sets of the members that remain, and of no others, are sent to the group's task,
   which stores them in a prefix tree and traverses it for all members at once, sharing the overlap
   of a common path and cutting subtrees whose remaining length can't reach the threshold;
4. components of the true links give every document its class.

A group of more than ``GROUP`` sets is split into blocks, and all pairs of blocks are tasks of their
own, so one hot group is spread and still compared in full.

Defined cases: a null text, an empty one, or one without words has an empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as its one shingle; a null id
stays in the result with a null component and links with nothing; repeated ids are rows of their
own and linked by their texts; an empty table gives an empty result; other columns aren't read.
"""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components, forest
from riskloom.llm.prefix_tree import similar_links
from riskloom.llm.scratch import lean, numbered, saved
from riskloom.llm.stripes import STRIPE, add, first_sums, group, row, split
from riskloom.llm.textblocks import LOWER, blocks, mix, shingles, sorted_sets, texts_of, word_hashes, word_spans

SLOT_BITS = 22
#: Steps of the code of a count for each doubling.
CODES = 1500
#: Sets of a candidate group that one task compares with each other, at most two blocks of this.
GROUP = 4096
#: Candidate groups of up to this many sets are sifted by parity maps first; larger ones go on whole.
SIFTED = 64
#: First shingles that one task gathers, about.
TASK_SHINGLES = 1_000_000
#: Bits of the filter that spares most sets outside any group the way; a full filter costs time only.
FILTER_BITS = 24
#: First shingles that are held at once, before those that stand for others are left.
HELD = 2_000_000
#: A set has one more first shingle for each of so many in it, which two similar sets share as well.
EXTRA = 32
#: Sets of a shingle whose pairs are counted, at most; in the task that reads the texts, and where all meet.
FEW_READ, FEW = 3, 8
#: Sets of a shingle that are linked at once where all meet, to bound what a task holds.
CROWD = 1024
#: Entries of hot shingles in a stored row, about.
PACKED = 200_000


def _sets(texts: pa.Array, size: int):
    """(first row, end row, distinct shingle hashes, bounds) of each block."""
    for low, high, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, ends, words = word_spans(data, offsets)
        values, bounds = sorted_sets(*shingles(word_hashes(data, starts, ends), words, size))
        yield low, high, values, bounds


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of a parity map: the next power of two from the size of the set, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _parities(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a map with a bit flipped for every item, at a place that the item's hash names.

    Items in both of two sets flip the same bits, so the maps differ in no more bits than there are
    items in just one of the sets.
    """
    width = _widths(np.diff(bounds))
    starts = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(width)), np.diff(bounds))
    at = starts[owner] + ((values >> np.uint64(30)).astype(np.int64) & (width[owner] - 1))
    packed = np.packbits((np.bincount(at, minlength=starts[-1]) & 1).astype(np.uint8))
    return [packed[a // 8:b // 8].tobytes() for a, b in zip(starts[:-1], starts[1:])]


def _folded(bits: bytes, width: int) -> np.ndarray:
    whole = np.frombuffer(bits, np.uint8).reshape(-1, width // 8)
    return np.bitwise_xor.reduce(whole, axis=0)


def _sift(threshold: int):
    """Splits the candidate groups in the sorted rows (root, sig, rep, n, body) by their parity maps.

    Two sets can only be similar if the sizes pass the length bound and the maps differ in at most as
    many bits as the threshold leaves items to just one of the sets. Sets without such a partner leave.
    """
    def sift(group):
        n = np.array([g[2] for g in group], np.int64)
        width = int(_widths(n.min(keepdims=True))[0])
        maps = np.stack([_folded(g[3], width) for g in group])
        a, b = np.triu_indices(len(group), 1)
        fits = 100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        differ = np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)
        may = differ * (100 + threshold) <= (100 - threshold) * (n[a] + n[b])
        sig = np.array([g[0] for g in group], np.int64)
        node, root = forest(sig[a[may]], sig[b[may]])
        of = dict(zip(node.tolist(), root.tolist()))
        of.update({r: r for r in set(root.tolist())})
        kept = [(g[0], g[1], g[2], of[g[0]]) for g in group if g[0] in of]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept)],
                                          ["sig", "rep", "n", "root"]) if kept else None

    def work(batches):
        key, group = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "sig", "rep", "n", "body")]
            for root, *rest in zip(*columns):
                if root != key:
                    out = sift(group) if group else None
                    if out is not None:
                        yield out
                    key, group = root, []
                group.append(rest)
        out = sift(group) if group else None
        if out is not None:
            yield out
    return work


def _ordered(values: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The sets as ascending numbers in the global order: rarity of the slot, then the hash."""
    rank = ranks[(values & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    return sorted_sets((rank << np.uint64(56)) | (values >> np.uint64(8)), bounds)[0]


def _first_pass(size: int):
    def work(batches):
        names = ["kind", "id", "tag", "n", "sig", "body"]
        sketch = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for low, high, values, bounds in _sets(texts_of(batch.column("text")), size):
                slots = (values & np.uint64(len(sketch) - 1)).astype(np.int64)
                sketch += np.bincount(slots, minlength=len(sketch)).astype(np.uint32) if len(slots) > 200_000 else 0
                if len(slots) <= 200_000:
                    np.add.at(sketch, slots, np.uint32(1))
                count = high - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(count, np.int32)), batch.column("id")[low:high],
                     batch.column("tag")[low:high], pa.array(np.diff(bounds)), pa.array(_signatures(values, bounds)),
                     pa.array(_parities(values, bounds), pa.binary())], names)
        for k, packed in split(sketch):
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([group()], pa.int64()),
                 pa.array([k], pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary())], names)
    return work


def _add_stripes(batches):
    """Summed counts as two-byte codes, ascending with the count: all that the order needs."""
    for k, total in add(batches, "number", "packed").items():
        codes = np.minimum(np.log2(total + 1.0) * CODES, 65535).astype(np.uint16)
        yield row(k, codes.tobytes(), ["n", "body"])


def _ranks(sketch_rows: DataFrame, tasks: int = 16) -> np.ndarray:
    """A byte for each slot, ascending with its count: quantiles of the shingles of the corpus.

    The driver holds three bytes for each slot, whatever the corpus.
    """
    sent = sketch_rows.select(F.col("n").alias("number"), F.col("tag").alias("task_group"), F.col("body").alias("packed"))
    sums = first_sums(sent, max(tasks, sent.rdd.getNumPartitions() // 2))
    found = sums.repartition(tasks, "number").mapInArrow(lean(_add_stripes), "n long, body binary").toArrow()
    codes = {k: np.frombuffer(body.as_buffer(), np.uint16)
             for k, body in zip(found.column("n").to_pylist(), found.column("body"))}
    slots = np.zeros(65536, np.int64)
    for part in codes.values():
        slots += np.bincount(part, minlength=65536)
    shingles_of = slots * (2 ** (np.arange(65536) / CODES) - 1)
    below = np.concatenate([[0], np.cumsum(shingles_of)[:-1]])
    level = (below / max(1, shingles_of.sum()) * 255).astype(np.uint8)
    ranks = np.zeros(1 << SLOT_BITS, np.uint8)
    for k, part in codes.items():
        ranks[k * STRIPE:(k + 1) * STRIPE] = level[part]
    return ranks


def _joined(token: np.ndarray, sig: np.ndarray, size: np.ndarray, threshold: int):
    """(token, sig, size) that stand for all given, and a spanning forest (a, b) of the candidates.

    Within a shingle the sets are put in order of size, and neighbours that pass the length bound are
    joined: any two sets that pass it are then joined by those between them. Of joined neighbours one
    is left out while those beside it pass the bound with each other, as whatever passes it with the
    one left out and lies between these passes it with them too.
    """
    order = np.argsort(token, kind="stable")
    token, sig, size = token[order], sig[order], size[order].astype(np.int64)
    shared = np.zeros(len(token), bool)
    shared[1:] |= token[1:] == token[:-1]
    shared[:-1] |= token[1:] == token[:-1]
    alone = [x[~shared] for x in (token, sig, size)]
    token, sig, size = token[shared], sig[shared], size[shared]
    order = np.lexsort((sig, size, token))
    token, sig, size = token[order], sig[order], size[order]
    linked = (token[1:] == token[:-1]) & (sig[1:] != sig[:-1]) & (100 * size[:-1] >= threshold * size[1:])
    links = forest(sig[1:][linked], sig[:-1][linked])
    stays = np.ones(len(token), bool)
    stays[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1])
    while True:
        token, sig, size = token[stays], sig[stays], size[stays]
        at = np.arange(len(token))
        fresh = np.ones(len(token), bool)
        fresh[1:] = token[1:] != token[:-1]
        odd = ((at - np.maximum.accumulate(np.where(fresh, at, 0))) & 1).astype(bool)
        stays = np.ones(len(token), bool)
        stays[1:-1] = ~(odd[1:-1] & (token[2:] == token[:-2]) & (100 * size[:-2] >= threshold * size[2:]))
        if stays.all():
            break
    return (*(np.concatenate(x) for x in zip(alone, (token, sig, size))), *links)


def _extra(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many of their first shingles a set of ``n`` shares with any similar set that is no smaller."""
    return np.minimum(1 + n // EXTRA, (n * threshold + 99) // 100)


def _needed(n: np.ndarray, threshold: int) -> np.ndarray:
    """Shared shingles held by few that make a pair a candidate; ``n`` is the size of the smaller set."""
    return (_extra(n, threshold) + 1) // 2


def _prone(n: np.ndarray, threshold: int) -> np.ndarray:
    """Hot shingles from which on a set may have a similar one that it shares too few others with."""
    return _extra((n * threshold + 99) // 100, threshold) // 2 + 1


def _gathered(token: np.ndarray, sig: np.ndarray, size: np.ndarray):
    """The entries that are alone with their token, and the others by token, each set once, with the sets of each token.

    A size below zero marks a token that a task has linked sets of; of equal entries the marked one stays.
    """
    order = np.argsort(token, kind="stable")
    token, sig, size = token[order], sig[order], size[order]
    shared = np.zeros(len(token), bool)
    shared[1:] |= token[1:] == token[:-1]
    shared[:-1] |= token[1:] == token[:-1]
    alone = [x[~shared] for x in (token, sig, size)]
    token, sig, size = token[shared], sig[shared], size[shared]
    order = np.lexsort((size, sig, token))
    token, sig, size = token[order], sig[order], size[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, size = token[fresh], sig[fresh], size[fresh]
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return alone, (token, sig, size), group


def _linked(token: np.ndarray, sig: np.ndarray, size: np.ndarray, threshold: int, few: int):
    """(token, sig, size) that stand for all given, links (a, b), and (set, hot shingles, those it is prone from).

    Only sets of shingles that more than ``few`` sets hold are linked; what stands for them is marked by
    its size, and all of them are counted as having that hot shingle, but for those marked before.
    """
    alone, (token, sig, size), group = _gathered(token, sig, size)
    hot = (np.bincount(group) > few)[group] if len(group) else np.zeros(0, bool)
    cold = [x[~hot] for x in (token, sig, size)]
    token, sig, size = token[hot], sig[hot], size[hot]
    counted = _hot_counts(sig[size > 0], size[size > 0], threshold)
    token, sig, size, a, b = _joined(token, sig, np.abs(size), threshold)
    left = [np.concatenate(x) for x in zip(alone, cold, (token, sig, -size))]
    return left, (a, b), counted


def _hot_counts(sig: np.ndarray, size: np.ndarray, threshold: int):
    sets, first, times = np.unique(sig, return_index=True, return_counts=True)
    return sets, times, _prone(size[first].astype(np.int64), threshold)


def _deal(ranks, size: int, threshold: int, parts: int):
    """Packs the first shingles of each set by part: shingle, signature and set size.

    Only those that stand for all sets of the task are sent. Rows without sizes are links found here,
    the ends in place of shingle and signature; with ``times`` they are sets with the number of their
    hot shingles, and the one they are prone from.
    """
    def packed(first, second, third, fourth):
        part = (mix(first.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        columns = [x[order] if len(x) else x for x in (first, second, third, fourth)]
        return pa.RecordBatch.from_arrays(
            [pa.array(full), *[pa.array([x[cuts[p]:cuts[p + 1]].tobytes() for p in full], pa.binary())
                               for x in columns]], ["part", "token", "sig", "size", "times"])

    def out(held):
        none = np.zeros(0, np.int32)
        (token, sig, length), (a, b), (sets, times, prone) = _linked(
            *(np.concatenate(x) for x in zip(*held)), threshold, FEW_READ)
        yield packed(token, sig, length.astype(np.int32), none)
        yield packed(a, b, none, none)
        yield packed(sets, sets, none, np.stack([times, prone], 1).astype(np.int32))

    def work(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for low, high, values, bounds in _sets(texts_of(batch.column("text")), size):
                n = np.diff(bounds)
                sig = _signatures(values, bounds)
                values = _ordered(values, bounds, ranks.value)
                first = np.where(ids[low:high] & (n > 0), n - (n * threshold + 99) // 100 + _extra(n, threshold), 0)
                doc = np.repeat(np.arange(high - low), first)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(first) - first, first) + bounds[doc]
                held.append((values[at], sig[doc], n[doc]))
                count += len(at)
                if count > HELD:
                    yield from out(held)
                    held, count = [], 0
        if count:
            yield from out(held)
    return work


#: Rows where the shingles meet: links, pairs with how often they met and have to, sets with their hot
#: shingles and those they are prone from, and the entries of hot shingles, packed.
LINK, PAIR, HOT_COUNT, HOT = range(4)
MET = "kind int, a long, b long, n int, m int, token binary, sig binary, size binary"


def _met(kind: int, a=None, b=None, n=None, m=None, token=None, sig=None, size=None) -> pa.RecordBatch:
    given = {"a": (a, pa.int64()), "b": (b, pa.int64()), "n": (n, pa.int32()), "m": (m, pa.int32()),
             "token": (token, pa.binary()), "sig": (sig, pa.binary()), "size": (size, pa.binary())}
    rows = len(a if a is not None else token)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, kind, np.int32)),
         *[pa.nulls(rows, t) if x is None else pa.array(x, t) for x, t in given.values()]], ["kind", *given])


def _pairs(token: np.ndarray, sig: np.ndarray, size: np.ndarray, threshold: int):
    """(a, b, times, needed) of the pairs of sets that share a token and pass the length bound; sorted by token."""
    found = []
    for k in range(1, FEW):
        i = np.flatnonzero(token[k:] == token[:-k])
        if not len(i):
            break
        low, high = np.minimum(size[i], size[i + k]), np.maximum(size[i], size[i + k])
        fits = 100 * low >= threshold * high
        i, low = i[fits], low[fits]
        found.append((np.minimum(sig[i], sig[i + k]), np.maximum(sig[i], sig[i + k]), low))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    a, b, low = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b, low = a[order], b[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.append(first, len(a))), _needed(low[first], threshold)


def _meet(threshold: int):
    """What the sets of a task that share first shingles tell of candidates, in rows of the kinds above."""
    def counted(sets, times, prone):
        return _met(HOT_COUNT, a=sets, n=times, m=prone)

    def out(token, sig, size):
        _, (token, sig, size), group = _gathered(token, sig, size)
        if not len(token):
            return
        hot = ((np.bincount(group) > FEW) | (np.bincount(group, size < 0) > 0))[group]
        a, b, times, needed = _pairs(token[~hot], sig[~hot], size[~hot], threshold)
        enough = times >= needed
        yield _met(LINK, *forest(a[enough], b[enough]))
        yield _met(PAIR, *(x[~enough] for x in (a, b, times, needed)))
        token, sig, size = token[hot], sig[hot], size[hot]
        yield counted(*_hot_counts(sig[size > 0], size[size > 0], threshold))
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        low = 0
        while low < len(token):
            after = starts[starts >= low + PACKED]
            high = int(after[0]) if len(after) else len(token)
            yield _met(HOT, token=[token[low:high].tobytes()], sig=[sig[low:high].tobytes()],
                       size=[size[low:high].astype(np.int32).tobytes()])
            low = high

    def work(batches):
        held, count, limit = [], 0, 2 * HELD
        for batch in batches:
            for token, sig, size, times in zip(*(batch.column(c) for c in ("token", "sig", "size", "times"))):
                size = np.frombuffer(size.as_buffer(), np.int32)
                sig = np.frombuffer(sig.as_buffer(), np.int64)
                times = np.frombuffer(times.as_buffer(), np.int32).reshape(-1, 2)
                if len(times):
                    yield counted(sig, times[:, 0], times[:, 1])
                elif not len(size):
                    yield _met(LINK, a=np.frombuffer(token.as_buffer(), np.int64), b=sig)
                else:
                    held.append((np.frombuffer(token.as_buffer(), np.uint64), sig, size.astype(np.int64)))
                    count += len(size)
            if count > limit:
                left, (a, b), found = _linked(*(np.concatenate(x) for x in zip(*held)), threshold, CROWD)
                yield _met(LINK, a=a, b=b)
                yield counted(*found)
                held, count = [tuple(left)], len(left[0])
                limit = 2 * max(HELD, count)
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held)))
    return work


def _hot_links(prone, threshold: int):
    """Links along the hot shingles of whole stored rows, between sets that are prone or stand for linked ones."""
    def work(batches):
        for batch in batches:
            for token, sig, size in zip(*(batch.column(c) for c in ("token", "sig", "size"))):
                token = np.frombuffer(token.as_buffer(), np.uint64)
                sig, size = np.frombuffer(sig.as_buffer(), np.int64), np.frombuffer(size.as_buffer(), np.int32)
                at = _bits(sig)
                some = (size < 0) | (prone.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                *_, a, b = _joined(token[some], sig[some], np.abs(size[some]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return work


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """Packed, a bit for each hash of an id that occurs; ids whose bit is unset surely don't."""
    def mark(batches):
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            seen[_bits(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    seen = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for bits in ids.coalesce(16).mapInArrow(lean(mark), "bits binary").toArrow().column(0).to_pylist():
        seen |= np.frombuffer(bits, np.uint8)
    return seen


def _send(ranks, wanted, size: int):
    """The whole sets of the texts that may be members of a candidate group."""
    def work(batches):
        for batch in batches:
            null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            at = _bits(ids)
            takes = (wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & ~null
            if not takes.any():
                continue
            few = batch.filter(pa.array(takes))
            for low, high, values, bounds in _sets(texts_of(few.column("text")), size):
                sig = _signatures(values, bounds)
                values = _ordered(values, bounds, ranks.value)
                yield pa.RecordBatch.from_arrays(
                    [few.column("id")[low:high], pa.array(sig), pa.array(
                        [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    ["id", "sig", "tokens"])
    return work


def _compare(threshold: int):
    """Links within each group of the sorted rows (key, sig, tokens), as spanning forests."""
    def links(group):
        sigs, at = np.unique(np.array([s for s, _ in group], np.int64), return_index=True)
        if len(sigs) < 2:
            return None
        a, b = similar_links([np.frombuffer(group[i][1], np.uint64) for i in at], threshold)
        return pa.RecordBatch.from_arrays([pa.array(sigs[a]), pa.array(sigs[b])], ["a", "b"]) if len(a) else None

    def work(batches):
        key, group = None, []
        for batch in batches:
            for k, sig, tokens in zip(batch.column("key").to_pylist(), batch.column("sig").to_pylist(),
                                      batch.column("tokens").to_pylist()):
                if k != key:
                    found = links(group)
                    if found is not None:
                        yield found
                    key, group = k, []
                group.append((sig, tokens))
        found = links(group)
        if found is not None:
            yield found
    return work


def candidate_groups(docs: DataFrame, sizes: DataFrame, ranks, size: int, threshold: int) -> DataFrame:
    """(node, root) over signatures: the components of sets that share enough first shingles."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(4, ceil(total * (100 - threshold) / 100 / TASK_SHINGLES))
    dealt = docs.mapInArrow(lean(_deal(ranks, size, threshold, 8 * tasks)),
                            "part long, token binary, sig binary, size binary, times binary")
    met = saved(dealt.repartition(tasks, "part").mapInArrow(lean(_meet(threshold)), MET), "met")
    pairs = (met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
             .where("n >= m").select("a", "b"))
    prone = (met.where(F.col("kind") == HOT_COUNT).groupBy("a").agg(F.sum("n").alias("n"), F.min("m").alias("m"))
             .where("n >= m").select("a"))
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(prone))
    hot = (met.where(F.col("kind") == HOT).select("token", "sig", "size")
           .mapInArrow(lean(_hot_links(wanted, threshold)), "a long, b long"))
    return components(met.where(F.col("kind") == LINK).select("a", "b").union(pairs).union(hot))


def similar_classes(docs: DataFrame, size: int = 5, threshold: int = 80, text: str = "text",
                    ident: str = "doc_id", tag: str | None = None) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, tag, class_no).

    ``tag`` names a long column to hand through, to find the rows again. ``class_no`` tells classes
    apart even where ids repeat; it is null for rows that can't link.

    Documents link when 100 times the intersection of their sets is at least ``threshold`` times the
    union; a component's id is the least document id in it.
    """
    spark = docs.sparkSession
    tagged = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"),
                         (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"))
    docs = tagged.select("id", "text")
    first = saved(tagged.mapInArrow(lean(_first_pass(size)), "kind int, id long, tag long, n long, sig long, body binary"),
                  "shingles", "kind")
    ranks = spark.sparkContext.broadcast(_ranks(first.where("kind = 1")))
    sizes = first.where("kind = 0").select("id", "n", "sig", "tag")
    groups = saved(candidate_groups(docs, sizes, ranks, size, threshold), "groups")
    reps = sizes.where("id is not null and n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    count = groups.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("sets"))
    members = saved(groups.join(reps, F.col("node") == F.col("sig")).join(count, F.col("root") == F.col("group"))
                    .select("sig", "rep", "n", "root", "sets"), "members")
    maps = first.where("kind = 0 and id is not null and n > 0").select(F.col("id").alias("its_id"), F.col("sig").alias("its_sig"), "body")
    small = (members.where(F.col("sets") <= SIFTED)
             .join(maps, (F.col("sig") == F.col("its_sig")) & (F.col("rep") == F.col("its_id")))
             .dropDuplicates(["sig"]).select("root", "sig", "rep", "n", "body"))
    sifted = (small.repartition("root").sortWithinPartitions("root", "sig")
              .mapInArrow(lean(_sift(threshold)), "sig long, rep long, n long, root long"))
    members = saved(members.where(F.col("sets") > SIFTED).select("sig", "rep", "n", "root").unionByName(sifted), "members")
    crowd = (members.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("sets"))
             .withColumn("blocks", F.ceil(F.col("sets") / GROUP).cast("int")))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))
    sent = (members.join(crowd, F.col("root") == F.col("group")).withColumn("own", own)
            .select("sig", "rep", "n", F.explode(F.transform(others, lambda k: F.struct(
                F.col("group"), F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))).alias("key")))
    sent = saved(sent.withColumnRenamed("sig", "member"), "sent")
    tasks = max(4, ceil((sent.agg(F.sum("n")).first()[0] or 0) / (4 * TASK_SHINGLES)))
    wanted = spark.sparkContext.broadcast(_filter(members.select("rep")))
    sets = docs.mapInArrow(lean(_send(ranks, wanted, size)), "id long, sig long, tokens binary")
    rows = (sets.join(sent, (F.col("sig") == F.col("member")) & (F.col("id") == F.col("rep")))
            .select(F.xxhash64("key.group", "key.i", "key.j").alias("key"), "sig", "tokens")
            .repartition(tasks, "key").sortWithinPartitions("key"))
    classes = components(rows.mapInArrow(lean(_compare(threshold)), "a long, b long"))
    classes = saved(classes, "classes")
    named = classes.join(reps, F.col("node") == F.col("sig"))
    least = named.groupBy(F.col("root").alias("its_root")).agg(F.min("rep").alias("least"))
    of_sig = (classes.join(least, F.col("root") == F.col("its_root")).select("node", "root", "least"))
    rep_of = reps.select(F.col("sig").alias("its_sig"), "rep")
    return (sizes.withColumn("sig", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("sig")))
            .join(rep_of, F.col("sig") == F.col("its_sig"), "left")
            .join(of_sig, F.col("sig") == F.col("node"), "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("least", "rep", "id").alias("component_id"), "tag",
                    F.coalesce("root", "sig").alias("class_no")))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows that can't link all stay."""
    rows, row = numbered(docs, "documents")
    classes = saved(similar_classes(rows, ident=ident, text=text, tag=row, **more), "kept")
    kept = (classes.where("class_no is not null").groupBy("class_no")
            .agg(F.min_by("tag", F.struct("doc_id", "tag")).alias("its_row")).select("its_row")
            .union(classes.where("class_no is null").select("tag")))
    body = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body"), F.col(row).alias("own_row"))
    return (body.join(kept.hint("shuffle_hash"), F.col("own_row") == F.col("its_row"), "left_semi")
            .select(*[F.col("body")[c].alias(c) for c in docs.columns]))
