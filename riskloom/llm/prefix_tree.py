"""Sets of one group in a prefix tree, and all pairs of them over a Jaccard threshold.

The tree's levels are slices of the globally ordered items of the group; a node is one distinct
beginning of a set up to the end of a slice. Many sets go down the tree together: the overlap of a
set with a node is that with the node's parent plus the items of one slice, so sets with a common
beginning share the work, and a node leaves the traversal with all below it once no set can reach
the threshold there with the items still to come.
"""

import numpy as np

from riskloom.llm.textblocks import mix

#: Items of a slice, and sets that traverse the tree together.
SLICE = 1024
TOGETHER = 512


def _peel(item: np.ndarray, owner: np.ndarray, size: np.ndarray, threshold: int) -> np.ndarray:
    """Marks the entries whose item another set has too, of sets that enough of these entries remain to.

    A set linked to another shares at least ``threshold`` percent of its own items with it, so sets
    below that leave the group, which can leave further items without a second owner.
    """
    live = np.ones(len(item), bool)
    while True:
        times = np.bincount(item[live], minlength=item.max() + 1)
        stays = live & (times[item] > 1)
        shared = np.bincount(owner[stays], minlength=len(size))
        stays &= (100 * shared >= threshold * size)[owner]
        if stays.sum() == live.sum():
            return live
        live = stays
        if not live.any():
            return live


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _join(root: np.ndarray, linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Unites the components of all linked pairs; each turn every set names one it isn't united with."""
    while True:
        apart = linked & (root[rows][:, None] != root[cols][None, :])
        some = apart.any(1)
        if not some.any():
            return
        _union(root, rows[some], cols[apart[some].argmax(1)])
        also = apart.any(0)
        _union(root, rows[apart[:, also].argmax(0)], cols[also])


def similar_links(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect exactly the sets which chains of similar pairs connect.

    ``sets`` are ascending arrays of distinct items. Two sets are similar if 100 times their
    intersection is at least ``threshold`` times their union.
    """
    size = np.array([len(s) for s in sets], np.int64)
    items, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    live = _peel(item, owner, size, threshold)
    none = np.zeros(0, np.int64)
    if not live.any():
        return none, none
    owner, item = owner[live], item[live]
    ids, owner = np.unique(owner, return_inverse=True)
    kept, item = np.unique(item, return_inverse=True)
    size = size[ids]
    root = _traverse(item, owner, size, mix(items[kept]), threshold)
    child = np.flatnonzero(root != np.arange(len(root)))
    return ids[child], ids[root[child]]


def _traverse(item: np.ndarray, owner: np.ndarray, size: np.ndarray, code: np.ndarray, threshold: int) -> np.ndarray:
    m, width = len(size), len(code)
    depth = max(2, -(-width // SLICE))
    level = (np.arange(width) * depth // width)[item]
    cell = owner * depth + level
    content = np.zeros(m * depth, np.uint64)
    np.add.at(content, cell, code[item])
    content = content.reshape(m, depth)
    inside = np.bincount(cell, minlength=m * depth).reshape(m, depth)
    to_come = inside.sum(1)[:, None] - np.cumsum(inside, axis=1)
    order = np.lexsort((item, level))
    item, owner_at, level_at = item[order], owner[order], level[order]
    cuts = np.searchsorted(level_at, np.arange(depth + 1))

    node, tree = np.zeros(m, np.int64), []
    for k in range(depth):
        key = mix(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + content[:, k])
        _, first, own = np.unique(key, return_index=True, return_inverse=True)
        rest, least, last = np.zeros(len(first), np.int64), np.full(len(first), 1 << 60), np.zeros(len(first), np.int64)
        np.maximum.at(rest, own, to_come[:, k])
        np.minimum.at(least, own, size)
        np.maximum.at(last, own, np.arange(m))
        tree.append((node[first], first, rest, least, last))
        node = own

    root = np.arange(m)
    for low in range(0, m, TOGETHER):
        rows = np.arange(low, min(m, low + TOGETHER))
        alive, overlap = np.zeros(1, np.int64), np.zeros((len(rows), 1), np.float32)
        for k, (parent, first, rest, least, last) in enumerate(tree):
            place = np.full(parent.max() + 1, -1)
            place[alive[alive <= parent.max()]] = np.flatnonzero(alive <= parent.max())
            nodes = np.flatnonzero((place[parent] >= 0) & (last > low))
            if not len(nodes):
                alive = nodes
                break
            base = item[cuts[k]] if cuts[k] < cuts[k + 1] else 0
            here = slice(cuts[k], cuts[k + 1])
            span = (item[here].max() - base + 1) if cuts[k] < cuts[k + 1] else 1
            column = item[here] - base
            dense = np.zeros((m, span), np.float32) if m * span <= 1 << 22 else None
            if dense is None:
                mine = _rows(rows, owner_at[here], column, m, span)
                theirs = _rows(first[nodes], owner_at[here], column, m, span)
            else:
                dense[owner_at[here], column] = 1
                mine, theirs = dense[rows], dense[first[nodes]]
            overlap = overlap[:, place[parent[nodes]]] + mine @ theirs.T
            reach = overlap + np.minimum(to_come[rows, k][:, None], rest[nodes][None, :])
            may = reach * (100 + threshold) >= threshold * (size[rows][:, None] + least[nodes][None, :])
            may &= rows[:, None] < last[nodes][None, :]
            some = may.any(0)
            alive, overlap = nodes[some], overlap[:, some]
        if not len(alive):
            continue
        place = np.full(len(tree[-1][1]), -1)
        place[alive] = np.arange(len(alive))
        cols = np.flatnonzero(place[node] >= 0)
        cols = cols[cols > low]
        both = overlap[:, place[node[cols]]].astype(np.float64)
        linked = both * (100 + threshold) >= threshold * (size[rows][:, None] + size[cols][None, :])
        linked &= rows[:, None] < cols[None, :]
        _join(root, linked, rows, cols)
    return root


def _rows(wanted: np.ndarray, owner: np.ndarray, column: np.ndarray, m: int, span: int) -> np.ndarray:
    """Rows of the membership matrix for the sets ``wanted``, each named once."""
    at = np.full(m, -1)
    at[wanted] = np.arange(len(wanted))
    mine = at[owner] >= 0
    out = np.zeros((len(wanted), span), np.float32)
    out[at[owner[mine]], column[mine]] = 1
    return out
