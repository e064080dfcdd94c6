"""Deep-shallow string sorting: multikey quicksort to a shallow depth, blind tries for what is still equal there.

Strings are the rows of a byte matrix, padded with zeros, with their lengths; each belongs to a group, and groups are
sorted one beside the other. The quicksort works on words of eight bytes: in a round every open segment of all groups
takes a pivot and splits into less, equal and greater rows; equal rows go on at the next word. Segments still equal at
the shallow depth go into a blind trie each, which keeps branching places only, so that long common prefixes are
compared once per string.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def _words(rows: np.ndarray) -> np.ndarray:
    width = -rows.shape[1] % 8
    padded = np.pad(rows, ((0, 0), (0, width))) if width else np.ascontiguousarray(rows)
    return padded.view(">u8").astype(np.uint64)


def common(rows: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j, element by element."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 8192):
        a, b = i[k : k + 8192], j[k : k + 8192]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[k : k + 8192] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return out


class _Blind:
    """A blind trie of some strings; a node is [depth, {byte or -1 at the end: node or list of equal strings}]."""

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.root: list = [0, {}]

    def byte(self, i: int, depth: int) -> int:
        return self.s[i][depth] if depth < len(self.s[i]) else -1

    def add(self, i: int) -> None:
        node, path = self.root, []
        while True:  # down by branching bytes only, to any leaf below
            path.append(node)
            nxt = node[1].get(self.byte(i, node[0]))
            if nxt is None:
                nxt = next(iter(node[1].values()), None)
            if nxt is None:
                node[1][self.byte(i, node[0])] = (i,)
                return
            if isinstance(nxt, tuple):
                break
            node = nxt
        a, b = self.s[i], self.s[nxt[0]]
        d, top = 0, min(len(a), len(b))
        if a[:top] == b[:top]:
            d = top
        else:
            step = top
            while step:  # the common prefix by halving steps
                if d + step <= top and a[d : d + step] == b[d : d + step]:
                    d += step
                else:
                    step >>= 1
        k = len(path) - 1
        while path[k][0] > d:
            k -= 1
        node = path[k]
        key = self.byte(i, node[0])
        if node[0] == d or key not in node[1]:
            old = node[1].get(key)
            node[1][key] = (*old, i) if isinstance(old, tuple) else (i,)
            return
        below = node[1][key]
        if isinstance(below, tuple) and d == len(a) == len(b):
            node[1][key] = (*below, i)
        else:
            node[1][key] = [d, {self.byte(nxt[0], d): below, self.byte(i, d): (i,)}]

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out += node
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def sort(rows: np.ndarray, lengths: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The rows' numbers, by group and string (a prefix before what it begins)."""
    n = len(rows)
    order = np.argsort(groups, kind="stable")
    if n < 2:
        return order
    words, last = _words(rows), (min(shallow, rows.shape[1]) + 7) // 8
    segment = np.cumsum(np.r_[True, groups[order][1:] != groups[order][:-1]]) - 1  # of each place
    depth = np.zeros(n, np.int64)  # in words, of each place
    rng = np.random.default_rng(5)
    while True:
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[starts, n])
        many = np.repeat(sizes, sizes)
        open_places = np.flatnonzero((many > 1) & (depth < last))
        if not len(open_places):
            break
        pivot_place = starts + (rng.random(len(starts)) * sizes).astype(np.int64)
        pivot_row = np.repeat(order[pivot_place], sizes)[open_places]
        d = depth[open_places]
        mine, pivot = words[order[open_places], d], words[pivot_row, d]
        side = np.where(mine < pivot, 0, np.where(mine == pivot, 1, 2))
        at = np.lexsort((side, segment[open_places]))
        order[open_places] = order[open_places][at]
        side, d = side[at], d[at]
        depth[open_places] = d + (side == 1)
        key = segment * 3
        key[open_places] += side
        segment = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size > 1:
            at = order[start : start + size]
            trie = _Blind([rows[i, : lengths[i]].tobytes() for i in at])
            for i in range(size):
                trie.add(i)
            order[start : start + size] = at[trie.order()]
    return order
