"""SentencePiece encoding with seeded merge dropout, and decoding.

The vocabulary of a byte-fallback BPE model is read once on the driver and broadcast as arrays (it
is as large as the vocabulary, whatever the input). Text is cut before each run of spaces; no piece
crosses such a cut, so each unit is encoded on its own.

A unit starts as its characters. The agenda holds every neighbouring pair whose joint text is a
piece; the pair of the best piece, leftmost first, is taken off. With the chance ``dropout`` it is
skipped for good, else merged, and the pairs with its new neighbours go on the agenda. Whether a
candidate is skipped is a keyed hash of the seed, the document's id, the unit's number in it and its
text, the candidate's place and its piece. So a unit may be cut anew wherever it occurs, and any run
gives the same cuts. Without dropout the pieces are the library's own.

All units of a block take their turns of the agenda together as arrays. Units of the same text share
an agenda as long as their hashes decide alike: where some skip a candidate and others merge it, the
agenda parts in two. A unit of more than ``LONG_UNIT`` characters has an agenda of its own.

Characters outside the vocabulary become byte pieces, and so does the mark that stands for a space
where a text itself holds it; thus decoding gives back every text exactly.

Defined cases: a null text stays null with null pieces; an empty text has no pieces; an id that isn't
a whole number counts by its hash, a null one as 0; repeated rows get the same pieces; an empty table
gives an empty result.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import lean
from riskloom.llm.textblocks import blocks, mix, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
LONG_UNIT = 200
_GOLD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_NO_RANK = np.int64(1 << 30)


def load(path: str = MODEL) -> dict:
    """Arrays of the vocabulary: pairs that merge, ids of characters, bytes of pieces."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    size = library.get_piece_size()
    pieces = [library.id_to_piece(i) for i in range(size)]
    normal = [i for i in range(size) if not (
        library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
    if any(SPACE_MARK in pieces[i].lstrip(SPACE_MARK) for i in normal):
        raise ValueError("a piece holds a space after other characters, so units can't be cut at spaces")
    by_text = {pieces[i]: i for i in normal}
    order = sorted(normal, key=lambda i: -library.get_score(i))
    rank = np.full(size, _NO_RANK)
    rank[order] = np.arange(len(order))
    # A part of a piece that is a character outside the vocabulary has an id above it.
    part = lambda text: by_text.get(text, size + ord(text) if len(text) == 1 else -1)
    pairs = sorted((a << 32 | b, i) for i in normal for k in range(1, len(pieces[i]))
                   if (a := part(pieces[i][:k])) >= 0 and (b := part(pieces[i][k:])) >= 0)
    characters = np.arange(0x110000, dtype=np.int64) + size
    for text, i in by_text.items():
        if len(text) == 1:
            characters[ord(text)] = i
    characters[0x20], characters[ord(SPACE_MARK)] = characters[ord(SPACE_MARK)], size + ord(SPACE_MARK)
    byte_ids = np.zeros(256, np.int64)
    shown = [pieces[i].replace(SPACE_MARK, " ").encode() for i in range(size)]
    for i in range(size):
        if library.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
            shown[i] = bytes([int(pieces[i][3:5], 16)])
        elif library.is_control(i) or library.is_unknown(i):
            shown[i] = b""
    return {"size": size, "rank": rank, "pair_keys": np.array([k for k, _ in pairs], np.int64),
            "pair_ids": np.array([i for _, i in pairs], np.int64), "characters": characters, "bytes": byte_ids,
            "shown": np.frombuffer(b"".join(shown), np.uint8),
            "shown_ends": np.concatenate([[0], np.cumsum([len(x) for x in shown])])}


def _merged(vocabulary: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pieces of pairs, -1 where there is none."""
    keys = vocabulary["pair_keys"]
    wanted = left << 32 | right
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, vocabulary["pair_ids"][at], -1)


def _skips(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: np.uint64) -> np.ndarray:
    return mix(key + place.astype(np.uint64) * np.uint64(_GOLD) + piece.astype(np.uint64)) >> np.uint64(1) < limit


def _skips_one(key: int, place: int, piece: int, limit: int) -> bool:
    x = (key + place * _GOLD + piece) & _ALL
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _ALL
    return (x ^ (x >> 32)) >> 1 < limit


def encode_unit(vocabulary: dict, symbols: list[int], key: int, limit: int) -> list[int]:
    """One unit with an agenda of its own; ``symbols`` are ids of its characters."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    rank, agenda = vocabulary["rank"], []
    if "pairs" not in vocabulary:
        vocabulary["pairs"] = dict(zip(vocabulary["pair_keys"].tolist(), vocabulary["pair_ids"].tolist()))
    pairs = vocabulary["pairs"]

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            piece = pairs.get(symbols[i] << 32 | symbols[after[i]])
            if piece is not None:
                heapq.heappush(agenda, (int(rank[piece]), i, piece, symbols[i], symbols[after[i]]))

    for i in range(n):
        offer(i)
    while agenda:
        _, i, piece, left, right = heapq.heappop(agenda)
        if symbols[i] != left or after[i] >= n or symbols[after[i]] != right:
            continue
        if _skips_one(key, i, piece, limit):
            continue
        gone = after[i]
        symbols[i], symbols[gone], after[i] = piece, -1, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def encode_units(vocabulary: dict, symbols: np.ndarray, bounds: np.ndarray, text: np.ndarray, keys: np.ndarray,
                 limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of all units, each given by its text (a number) and its key.

    ``symbols`` and ``bounds`` are the characters of the texts. Returned are the pieces of all ways in
    which texts were cut, the bounds of each way, and the way of every unit.
    """
    count = np.diff(bounds)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    way = text.copy()  # of each unit; the first way of a text has the text's number
    ways = len(count)
    known: dict = {}
    for u in np.flatnonzero((count > LONG_UNIT)[text]):
        alike = int(text[u]), int(keys[u]) if limit else 0
        if alike not in known:
            own = encode_unit(vocabulary, symbols[bounds[text[u]]:bounds[text[u] + 1]].tolist(), int(keys[u]), limit)
            done.append((np.full(len(own), ways), np.array(own, np.int64)))
            known[alike], ways = ways, ways + 1
        way[u] = known[alike]
    live = np.flatnonzero((count <= LONG_UNIT)[text])  # units whose way goes on
    unit = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(symbols)) - bounds[unit]
    short = (count <= LONG_UNIT)[unit]
    symbol, unit, place = symbols[short], unit[short], place[short]
    edge = np.uint64(limit)

    def pieces_at(at: np.ndarray) -> np.ndarray:
        """Candidates at symbols that aren't the last of their way."""
        return _merged(vocabulary, symbol[at], symbol[at + 1])

    piece = np.full(len(symbol), -1)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    piece[inner] = pieces_at(inner)
    while len(symbol):
        # Here ``unit`` is the way that a symbol belongs to; ways lie one after the other in ascending order.
        fresh = np.ones(len(unit), bool)
        fresh[1:] = unit[1:] != unit[:-1]
        first = np.flatnonzero(fresh)
        order = np.where(piece >= 0, vocabulary["rank"][piece], _NO_RANK) << 32 | np.arange(len(symbol))
        best = np.minimum.reduceat(order, first)
        going = best >> 32 < _NO_RANK
        if not going.all():
            stays = np.repeat(going, np.diff(np.append(first, len(symbol))))
            done.append((unit[~stays], symbol[~stays]))
            moved = np.cumsum(stays) - 1
            best = moved[best[going] & 0xFFFFFFFF]
            symbol, unit, place, piece = symbol[stays], unit[stays], place[stays], piece[stays]
            ended = np.ones(ways, bool)
            ended[unit] = False
            live = live[~ended[way[live]]]
        else:
            best = best & 0xFFFFFFFF
        if not len(symbol):
            break
        skipped = np.zeros(len(best), bool)
        if limit:
            # Every unit decides on its way's candidate; where they differ, those that skip it part.
            row = np.zeros(ways, np.int64)
            row[unit[best]] = np.arange(len(best))
            at = row[way[live]]
            skips = _skips(keys[live], place[best[at]], piece[best[at]], edge)
            some = np.bincount(at, skips, len(best)) > 0
            merges = np.bincount(at, ~skips, len(best)) > 0
            skipped = some & ~merges
            parting = np.flatnonzero(some & merges)
            if len(parting):
                size = np.bincount(row[unit], minlength=len(best))
                low = np.cumsum(size) - size
                copied = _ranges(low[parting], size[parting])
                gone = best[parting] - low[parting] + np.cumsum(size[parting]) - size[parting] + len(symbol)
                new = np.full(len(best), -1)
                new[parting] = ways + np.arange(len(parting))
                leaving = live[skips & (new[at] >= 0)]
                way[leaving] = new[row[way[leaving]]]
                ways += len(parting)
                symbol = np.concatenate([symbol, symbol[copied]])
                place = np.concatenate([place, place[copied]])
                piece = np.concatenate([piece, piece[copied]])
                unit = np.concatenate([unit, np.repeat(new[parting], size[parting])])
                piece[gone] = -1
        piece[best[skipped]] = -1
        best = best[~skipped]
        symbol[best] = piece[best]
        keep = np.ones(len(symbol), bool)
        keep[best + 1] = False
        moved = np.cumsum(keep) - 1
        best = moved[best]
        symbol, unit, place, piece = symbol[keep], unit[keep], place[keep], piece[keep]
        piece[best] = -1
        again = np.concatenate([best, best - 1])
        again = again[(again >= 0) & (again + 1 < len(symbol))]
        again = again[unit[again] == unit[again + 1]]
        piece[again] = pieces_at(again)
    if not done:
        return np.zeros(0, np.int64), np.zeros(ways + 1, np.int64), way
    unit, symbol = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(unit, kind="stable")
    return symbol[order], np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=ways))]), way


def _with_bytes(vocabulary: dict, symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces in place of characters outside the vocabulary; ``text`` follows."""
    size = vocabulary["size"]
    out = np.flatnonzero(symbol >= size)
    if not len(out):
        return symbol, text
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbol[out] - size).tolist()]
    many = np.ones(len(symbol), np.int64)
    many[out] = [len(r) for r in raw]
    at = np.cumsum(many) - many
    longer = np.repeat(symbol, many)
    where = np.repeat(at[out], many[out]) + np.concatenate([np.arange(len(r)) for r in raw])
    longer[where] = vocabulary["bytes"][np.frombuffer(b"".join(raw), np.uint8)]
    return longer, np.repeat(text, many)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, starts[1] .., one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def encode(vocabulary: dict, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, dropout: float,
           seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of a block, and their bounds; ``ids`` key the hashes."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    filled = np.diff(leads) > 0
    # A space goes before each text that isn't empty.
    bounds = leads + np.concatenate([[0], np.cumsum(filled)])
    text = np.repeat(np.arange(n), np.diff(bounds))
    all_points = np.full(bounds[-1], 0x20)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[:-1][filled]] = False
    all_points[inside] = points
    space = all_points == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[bounds[:-1][filled]] = True
    starts = np.flatnonzero(starts)
    unit_bounds = np.append(starts, len(all_points))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    symbols = vocabulary["characters"][all_points]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(
        all_points.astype(np.uint64) * np.uint64(_GOLD) + _ranges(np.zeros(len(starts), np.int64),
                                                                   np.diff(unit_bounds)).astype(np.uint64)))])
    content = mix(sums[unit_bounds[1:]] - sums[unit_bounds[:-1]])
    of = text[starts]
    nth = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[of]
    own = mix(ids.astype(np.int64).view(np.uint64)[of] * np.uint64(_GOLD) + np.uint64(seed))
    key = mix(content + mix(own + nth.astype(np.uint64)))
    _, first, same = np.unique(content, return_index=True, return_inverse=True)
    count = np.diff(unit_bounds)[first]
    symbol, cuts, same = encode_units(vocabulary, symbols[_ranges(starts[first], count)],
                                      np.concatenate([[0], np.cumsum(count)]), same, key, int(dropout * (1 << 63)))
    many = np.diff(cuts)[same]
    symbol = symbol[_ranges(cuts[:-1][same], many)]
    symbol, of = _with_bytes(vocabulary, symbol, np.repeat(of, many))
    return symbol, np.searchsorted(of, np.arange(n + 1))


def decode(vocabulary: dict, pieces: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of each text and its offsets: the bytes of its pieces without the first space."""
    ends = vocabulary["shown_ends"]
    count = ends[pieces + 1] - ends[pieces]
    data = vocabulary["shown"][_ranges(ends[pieces], count)]
    at = np.concatenate([[0], np.cumsum(count)])[bounds]
    keep = np.ones(len(data), bool)
    keep[at[:-1][np.diff(at) > 0]] = False
    return data[keep], at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


def tokenize(docs: DataFrame, vocabulary: dict | None = None, dropout: float = 0.1, seed: int = 17,
             text: str = "text", ident: str = "doc_id", out: str = "pieces") -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless): ``lossless`` if decoding gave the very text back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load())
    kind = dict(docs.dtypes)[ident]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col(ident).cast("long") if whole else F.when(F.col(ident).isNotNull(), F.xxhash64(ident)), F.lit(0))

    def work(batches):
        for batch in batches:
            column = texts_of(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("id")
            keys = batch.column("key").to_numpy()
            for low, high, data, offsets in blocks(column, 2 << 20):
                pieces, bounds = encode(shared.value, data, offsets, keys[low:high], dropout, seed)
                back, at = decode(shared.value, pieces, bounds)
                same = np.diff(at) == np.diff(offsets)
                if same.all():
                    differ = np.concatenate([[0], np.cumsum(back != data)])
                    same = differ[offsets[1:]] == differ[offsets[:-1]]
                else:
                    same = np.array([back[at[i]:at[i + 1]].tobytes() == data[offsets[i]:offsets[i + 1]].tobytes()
                                     for i in range(high - low)])
                gone = pa.array(null[low:high])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pieces, pa.int32()), mask=gone)
                yield pa.RecordBatch.from_arrays(
                    [ids[low:high], lists, pa.array(np.diff(bounds), mask=null[low:high]),
                     pa.array(same, mask=null[low:high])], ["doc_id", out, "n_pieces", "lossless"])

    return (docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), key.alias("key"))
            .mapInArrow(lean(work), f"doc_id {kind}, {out} array<int>, n_pieces long, lossless boolean"))
