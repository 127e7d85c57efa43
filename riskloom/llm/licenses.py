"""Licence notices found by a trained paragraph classifier and confirmed by templates.

Texts are read twice: by lines, and by paragraphs, which only blank lines part, so that a notice may be
wrapped. Longer ones are read in overlapping pieces of ``PIECE`` words, so none is read in part only,
and paragraphs also in pieces of ``SHORT`` words, in which prose around a short notice weighs less.
A piece is a sparse bag of hashed word n-grams of one to three words. A multinomial
logistic regression over the licence families and an unknown class is trained on variations of the
templates below, and for the unknown class on pieces of the lines of all texts (at most ``SAMPLE``, the
first by hash, without those close to a template or of more than ``PIECE_CHARACTERS``) and on sentences
about licences that license nothing. A temperature fitted on variations and paragraphs that training didn't see calibrates its
probabilities. Every
family is tested for itself: it is reported if its probability against the unknown class is at least
``SURE`` and the piece holds enough of the words and word pairs of one of the family's templates, also
of those that no better covered family of the piece has (so notices may stand side by side, and one
isn't taken for a like one).

Defined cases: a null or empty text has no paragraphs and no licence; null and repeated ids are rows
of their own; ties of coverage take the likelier family first; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.textblocks import LOWER, blocks, mix, texts_of, word_hashes

SAMPLE = 1500
PIECE = 64
#: Longer pieces, whose words have sixty characters and more, don't train the unknown class.
PIECE_CHARACTERS = 4000
#: Words of the shorter pieces that find a short notice wrapped amid prose.
SHORT = 24
BINS = 1 << 15
SURE = 0.5
#: Share of a template's words and word pairs that confirms it.
CONFIRMED = 0.6
SEED = 11

#: Short public notices of common licences, by family.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files",
            "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            " General Public License as published by the Free Software Foundation",
            "Licensed under the GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it under the terms of the GNU Lesser General"
             " Public License", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.",
             "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "CC-BY": ("Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "Released under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without permission.",
                    "Confidential and proprietary. All rights reserved."),
}
#: Sentences about licences that license nothing.
NEAR = (
    "He lost his driving license last year.", "The license plate of the car was hidden.",
    "A license is needed to sell food in the city.", "The public library opens at nine.",
    "The city issued a new fishing license to the club.", "Version 3.0 of the program adds a new menu.",
    "The software was released in May.", "The general public was invited to the event.",
    "The work is free of charge for all members.", "The Apache helicopter landed near the river.",
    "All seats are reserved.", "The commons were open to all.", "Students of MIT won the prize.",
    "The terms of the contract are confidential.", "A copy of the document was obtained by the press.",
)
#: Words of which a notice of the family holds one, where others share its wording.
NAMES = {"GPL": ("gnu general", "gpl", "gplv2", "gplv3", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-2.0-or-later",
                 "gpl-3.0-only", "gpl-3.0-or-later"),
         "LGPL": ("lesser", "lgpl", "lgpl-2.1-only"), "AGPL": ("affero", "agpl", "agpl-3.0-only")}
FAMILIES = (*TEMPLATES, "unknown")
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,;:!?\"'()[]{}<>*#$%&|/\\"]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of a block, the line feeds before it, and its text."""
    low = LOWER[data]
    # Punctuation parts words.
    blank = _STRIP[low] | (low == 32) | ((low >= 9) & (low <= 13))
    solid = ~blank
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    if len(low):
        first[1:] &= blank[:-1] | edge[1:-1]
        last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = word_hashes(low, starts, ends)
    return h, np.cumsum(low == 10)[starts], np.searchsorted(offsets, starts, "right") - 1


def _fresh(above: np.ndarray, text: np.ndarray, feeds: int) -> np.ndarray:
    """Whether a word is the first one of its line, where ``feeds`` line feeds end a line."""
    fresh = np.ones(len(text), bool)
    fresh[1:] = (above[1:] - above[:-1] >= feeds) | (text[1:] != text[:-1])
    return fresh


def _gram(h: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    g = np.full(len(rows), k, np.uint64)
    for j in range(k):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[rows + j])
    return g


def _grams(data: np.ndarray, offsets: np.ndarray, feeds: int = 1, size: int = PIECE):
    """Word n-grams of every line of a block, in pieces; lines end where ``feeds`` line feeds meet.

    Returns the text of each piece, the piece of each n-gram, its 64-bit hash and its length, and the
    line of each word with the first word of each piece.
    """
    h, above, text = _words(data, offsets)
    n = len(h)
    fresh = _fresh(above, text, feeds)
    line = np.cumsum(fresh)
    begin = np.flatnonzero(fresh)
    nth = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n))) if n else np.zeros(0, np.int64)
    # Pieces start at every half piece of a line; a word is in its own piece and in the one before.
    half = nth // (size // 2)
    key = line * (1 << 20) + half
    pieces, leads, piece = np.unique(key, return_index=True, return_inverse=True)
    at, of, length = [], [], []
    for k in (1, 2, 3):
        rows = np.arange(n - k + 1) if n >= k else np.zeros(0, np.int64)
        rows = rows[line[rows] == line[rows + k - 1]] if len(rows) else rows
        g = _gram(h, rows, k)
        before = piece[rows] - 1
        also = (half[rows] > 0) & (before >= 0)
        at += [g, g[also]]
        of += [piece[rows], before[also]]
        length += [np.full(len(rows), k), np.full(int(also.sum()), k)]
    of_text = np.zeros(len(pieces), np.int64)
    of_text[piece] = text
    return of_text, np.concatenate(of), np.concatenate(at), np.concatenate(length), (line, leads)


def _bags(lines: list[str]):
    """(piece, bin) of the n-grams of separate lines, one piece each."""
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    sizes = np.array([len(x.encode()) + 1 for x in lines])
    sizes[-1] -= 1
    text, of, gram, length, _ = _grams(data, np.concatenate([[0], np.cumsum(sizes)]))
    return text[of], gram, length


def _bins(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - 15)).astype(np.int64)


def _variations(random, words: list[str], fillers: list[str], count: int) -> list[str]:
    """A notice with words lost, changed or added, and sometimes with other text around it."""
    out = []
    for _ in range(count):
        own = [w for w in words if random.random() > 0.04 or len(words) < 5]
        if random.random() < 0.3:
            own.insert(int(random.integers(len(own) + 1)), str(random.choice(fillers)))
        if random.random() < 0.3:
            own = [*random.choice(fillers, int(random.integers(1, 10))), *own]
        if random.random() < 0.3:
            own = [*own, *random.choice(fillers, int(random.integers(1, 10)))]
        out.append(" ".join(own))
    return out


def _fit(of, gram, label, n, turns=120, rate=0.5, decay=1e-4):
    """Weights (bins, families) and bias by full gradient steps; rows are scaled by their length."""
    bins = _bins(gram)
    size = np.bincount(of, minlength=n)
    share = (1 / np.sqrt(np.maximum(size, 1)))[of]
    used, column = np.unique(bins, return_inverse=True)
    weight, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    wanted = np.eye(len(FAMILIES))[label]
    balance = (1 / np.bincount(label, minlength=len(FAMILIES)).clip(1))[label][:, None] / len(FAMILIES)
    order = np.argsort(of, kind="stable")
    of, column, share = of[order], column[order], share[order]
    cuts = np.searchsorted(of, np.arange(n))
    speed_w, speed_b = np.zeros_like(weight), np.zeros_like(bias)
    filled = np.flatnonzero(np.bincount(of, minlength=n))
    by_column = np.argsort(column, kind="stable")
    column_cuts = np.searchsorted(column[by_column], np.arange(len(used)))
    for _ in range(turns):
        score = np.tile(bias, (n, 1))
        score[filled] += np.add.reduceat(weight[column] * share[:, None], cuts[filled], axis=0)
        off = (_softmax(score) - wanted) * balance * n
        slope = np.add.reduceat((off[of] * share[:, None])[by_column], column_cuts, axis=0) / n + decay * weight
        speed_w = 0.9 * speed_w - rate * 20 * slope
        speed_b = 0.9 * speed_b - rate * off.mean(0)
        weight, bias = weight + speed_w, bias + speed_b
    whole = np.zeros((BINS, len(FAMILIES)), np.float32)
    whole[used] = weight
    return whole, bias.astype(np.float32)


def _softmax(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def _scores(weight, bias, of, gram, n):
    size = np.bincount(of, minlength=n)
    score = np.tile(bias, (n, 1)).astype(np.float32)
    bins = _bins(gram)
    known = weight[bins].any(1) if len(bins) else np.zeros(0, bool)
    order = np.argsort(of[known], kind="stable")
    of, bins = of[known][order], bins[known][order]
    if len(of):
        filled, cuts = np.unique(of, return_index=True)
        score[filled] += np.add.reduceat(weight[bins], cuts, axis=0) / np.sqrt(size[filled])[:, None]
    return score


def learn(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> tuple:
    """(weights, bias, temperature, template n-grams) fitted on the driver from bounded samples."""
    return fit([r["piece"] for r in sample_pieces(docs, sample, text).collect()])


def sample_pieces(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """At most ``sample`` different pieces of all lines of all texts: those of least hash.

    Their number, as counted roughly, tells how low a hash has to be, so only few of them are shuffled.
    """
    line = docs.select(F.explode(F.split(F.col(text), r"[\n\r]+")).alias("line"))
    pieces = (line.select(F.explode(F.regexp_extract_all("line", F.lit(rf"(?:\S++\s*+){{1,{PIECE}}}"), F.lit(0))).alias("piece"))
              .select(F.rtrim("piece").alias("piece")).where(F.length("piece") <= PIECE_CHARACTERS)
              .withColumn("hash", F.xxhash64("piece")))
    kinds = pieces.agg(F.approx_count_distinct("hash")).first()[0]
    low = min(1.0, (2 * sample + 100) / max(1, kinds))
    most = int(-(1 << 63) + low * ((1 << 64) - 1))
    rows = pieces if low == 1.0 else pieces.where(F.col("hash") <= F.lit(min(most, (1 << 63) - 1)))
    return rows.distinct().orderBy("hash", "piece").limit(sample).select("piece")


def fit(lines: list[str]) -> tuple:
    random = np.random.default_rng(SEED)
    templates = [(f, t) for f, family in enumerate(TEMPLATES) for t in TEMPLATES[family]]
    owner, gram, length = _bags([t for _, t in templates])
    short = length < 3
    # The n-grams of templates, sorted, with the template that each belongs to.
    order = np.lexsort((owner[short], gram[short]))
    pairs = (gram[short][order], owner[short][order])
    needed = np.bincount(owner[short], minlength=len(templates))
    family_of = np.array([f for f, _ in templates])
    if lines:
        share = _coverage(pairs, needed, *_bags(lines)[:2], len(lines)).max(1)
        lines = [x for x, s in zip(lines, share) if s < 0.5]
    fillers = sorted({w for x in lines[:500] for w in x.split()}) or ["text"]
    texts, label = [], []
    for f, t in templates:
        made = _variations(random, t.split(), fillers, 40)
        texts += made
        label += [f] * len(made)
    unknown = [*lines, *NEAR, *[x for t in NEAR for x in _variations(random, t.split(), fillers, 10)]]
    texts += unknown
    label = np.array(label + [len(FAMILIES) - 1] * len(unknown))
    kept_out = np.arange(len(texts)) % 5 == 0
    of, gram, _ = _bags(texts)
    seen = ~kept_out[of]
    number = np.cumsum(~kept_out) - 1
    weight, bias = _fit(number[of[seen]], gram[seen], label[~kept_out], int((~kept_out).sum()))
    score = _scores(weight, bias, of, gram, len(texts))[kept_out]
    loss = lambda t: -np.log(_softmax(score / t)[np.arange(len(score)), label[kept_out]] + 1e-9).mean()
    heat = min(np.geomspace(0.1, 10, 41), key=loss)
    return weight, bias, float(heat), pairs, needed, family_of


def _coverage(pairs, needed, of, gram, n) -> np.ndarray:
    """Share of each template's words and word pairs that each piece holds."""
    grams, owner = pairs
    low, high = np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right")
    hit = np.flatnonzero(high > low)
    many = (high - low)[hit]
    at = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    cell = np.unique(np.stack([np.repeat(of[hit], many), at]), axis=1)
    share = np.zeros((n, len(needed)))
    np.add.at(share, (cell[0], owner[cell[1]]), 1)
    return share / needed


def _may_hold(model: tuple, h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The texts of ``n`` that hold, anywhere, enough words and word pairs to confirm a template.

    No piece of another text can be a notice, whatever the classifier says of it.
    """
    pairs, needed = model[3], model[4]
    marked = np.zeros(1 << 16, bool)
    marked[pairs[0] >> np.uint64(48)] = True
    of, gram = [], []
    for k in (1, 2):
        rows = np.arange(max(0, len(h) - k + 1))
        g = _gram(h, rows, k)
        keep = marked[g >> np.uint64(48)] & (text[rows] == text[rows + k - 1])
        of, gram = [*of, text[rows[keep]]], [*gram, g[keep]]
    share = _coverage(pairs, needed, np.concatenate(of), np.concatenate(gram), n)
    return np.flatnonzero((share >= CONFIRMED).any(1))


def _phrases(phrases: tuple) -> set[int]:
    """The n-gram of each phrase as a whole."""
    of, gram, length = _bags(list(phrases))
    words = np.array([len(x.split()) for x in phrases])
    return set(gram[length == words[of]].tolist())


def _notices(model: tuple, of: np.ndarray, gram: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """(piece, family, calibrated probability against the unknown class) of the notices of ``n`` pieces."""
    weight, bias, heat, pairs, needed, family_of = model
    score = _scores(weight, bias, of, gram, n) / heat
    chance = 1 / (1 + np.exp(np.clip(score[:, -1:] - score[:, :-1], -50, 50)))
    some = np.flatnonzero((chance >= SURE).any(1))
    if not len(some):
        return []
    among = np.full(n, -1)
    among[some] = np.arange(len(some))
    mine = among[of] >= 0
    of, gram = among[of[mine]], gram[mine]
    share = _coverage(pairs, needed, of, gram, len(some))
    fits = (share >= CONFIRMED) & (chance[some][:, family_of] >= SURE)
    rows = np.flatnonzero(fits.any(1))
    order = np.argsort(of, kind="stable")
    of, gram = of[order], gram[order]
    grams_of = [set(pairs[0][pairs[1] == t].tolist()) for t in range(len(needed))]
    named = {f: _phrases(NAMES[x]) for f, x in enumerate(TEMPLATES) if x in NAMES}
    out = []
    for k in rows:
        held = set(gram[np.searchsorted(of, k):np.searchsorted(of, k, "right")].tolist())
        others: set = set()
        taken: set = set()
        for t in sorted(np.flatnonzero(fits[k]), key=lambda t: (-share[k, t], -chance[some[k], family_of[t]])):
            f = int(family_of[t])
            own = grams_of[t] - others
            if f in taken or (f in named and not held & named[f]) or len(own & held) < CONFIRMED * max(1, len(own)):
                continue
            taken.add(f)
            others |= set().union(*(grams_of[x] for x in np.flatnonzero(family_of == f)))
            out.append((int(some[k]), f, float(chance[some[k], f])))
    return out


def scan(docs: DataFrame, model: tuple, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, licenses, n_paragraphs, n_licensed, sureness).

    ``licenses`` names the families in order of the alphabet, ``n_licensed`` counts the paragraphs that
    hold a notice, and ``sureness`` is the least calibrated probability among them.
    """
    kind = dict(docs.dtypes)[ident]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for low, high, data, offsets in blocks(texts_of(batch.column("text")), 1 << 20):
                n = high - low
                names: list[set] = [set() for _ in range(n)]
                held: list[set] = [set() for _ in range(n)]
                sure = np.full(n, np.nan)
                h, above, text_of = _words(data, offsets)
                paragraphs = np.bincount(text_of[_fresh(above, text_of, 2)], minlength=n)
                some = _may_hold(shared.value, h, text_of, n)
                sizes = np.diff(offsets)[some]
                data = np.concatenate([data[:0], *[data[offsets[t]:offsets[t + 1]] for t in some]])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                paragraph = np.zeros(0, np.int64)
                for feeds, size in ((2, PIECE), (2, SHORT), (1, PIECE)) if len(some) else ():
                    of_text, of, gram, _, (line, leads) = _grams(data, offsets, feeds, size)
                    if not len(paragraph):
                        paragraph = line
                    for p, f, chance in _notices(shared.value, of, gram, len(of_text)):
                        t = some[of_text[p]]
                        names[t].add(FAMILIES[f])
                        held[t].add(int(paragraph[leads[p]]))
                        sure[t] = np.nanmin([sure[t], chance])
                count = np.array([len(x) for x in held], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], pa.array([",".join(sorted(x)) for x in names]),
                     pa.array(paragraphs), pa.array(count), pa.array(sure, mask=count == 0)],
                    ["doc_id", "licenses", "n_paragraphs", "n_licensed", "sureness"])

    return (docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
            .mapInArrow(work, f"doc_id {kind}, licenses string, n_paragraphs long, n_licensed long, sureness double"))
