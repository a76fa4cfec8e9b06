"""Deep-shallow suffix sorting.

Suffixes are first ordered by multikey quicksort to a shallow depth, eight bytes a symbol: all groups that agree so far are
partitioned by their next symbol in one numpy call. Groups that still agree at the shallow depth have long common
prefixes; where all members agree to the full depth they are one run, else a blind trie orders them: its inner nodes
hold only the position of the byte that tells their branches apart, so an insertion compares one text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SYMBOL = 8


def symbols(raw: np.ndarray, pad: int) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number; zeros follow the end."""
    held = np.zeros(len(raw) + pad + 2 * SYMBOL, np.uint8)
    held[: len(raw)] = raw
    return np.ndarray(len(raw) + pad + SYMBOL, ">u8", held, strides=(1,))  # a view; only what is looked up is read


class BlindTrie:
    """Strings of one length, in order. A node is [position of the telling byte, {byte: child}, any leaf below]; a
    leaf is (string, members)."""

    def __init__(self) -> None:
        self.root: object = None

    def insert(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = (string, [member])
            return
        node = self.root
        while isinstance(node, list):  # blind descent to some leaf
            node = node[1].get(string[node[0]], node[2])
        other = node[0]
        if other == string:
            node[1].append(member)
            return
        at = next(k for k, (x, y) in enumerate(zip(string, other, strict=True)) if x != y)
        parent, key, node = None, 0, self.root
        while isinstance(node, list) and node[0] < at:
            parent, key = node, string[node[0]]
            node = node[1][key]
        leaf = (string, [member])
        if isinstance(node, list) and node[0] == at:
            node[1][string[at]] = leaf
            return
        new = [at, {string[at]: leaf, other[at]: node}, leaf]
        if parent is None:
            self.root = new
        else:
            parent[1][key] = new

    def runs(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def sort_suffixes(words: np.ndarray, at: np.ndarray, depth: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The order of the positions ``at`` by their first ``depth`` bytes, and for each in that order the number of its run
    of equal ones. ``words`` are the text's ``symbols``, padded by ``depth`` at least."""
    n = len(at)
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)  # places in ``order`` whose group has other members
    shallow = min(shallow, depth)

    def symbol(places: np.ndarray, d: int) -> np.ndarray:
        w = words[at[order[places]] + d].astype(np.uint64)
        left = depth - d
        return w if left >= SYMBOL else w & np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * left)) - 1))

    d = 0
    while d < shallow and len(live) > 1:
        key, g = symbol(live, d), group[live]
        if d:
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(first, len(live)))
            # Groups whose members all agree stay as they are.
            part = np.flatnonzero(np.repeat(~np.logical_and.reduceat(key == np.repeat(key[first], size), first), size))
            s = part[np.lexsort((key[part], g[part]))]
        else:
            part, s = slice(None), np.argsort(key)
        order[live[part]], key[part] = order[live[s]], key[s]
        new = np.empty(len(live), bool)
        new[0] = True
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        # A group is named by the place of its first member, so names follow the order.
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(size > 1, size)]
        d += SYMBOL
    if len(live) and d < depth:
        g = group[live]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(live)))
        same = np.ones(len(live), bool)
        tails = [symbol(live, k) for k in range(d, depth, SYMBOL)]
        for t in tails:
            same &= t == np.repeat(t[first], size)
        mixed = np.flatnonzero(~np.logical_and.reduceat(same, first))
        # Two that differ need no trie: all such pairs are compared at once.
        x = first[mixed[size[mixed] == 2]]
        swap, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
        for t in tails:
            swap |= open_ & (t[x] > t[x + 1])
            open_ &= t[x] == t[x + 1]
        group[live[x + 1]] = live[x + 1]
        x = x[swap]
        order[live[x]], order[live[x + 1]] = order[live[x + 1]], order[live[x]]
        mixed = mixed[size[mixed] > 2]
        if len(mixed):
            flat = np.stack(tails, 1).astype(">u8")
            for m in mixed.tolist():
                a, b = int(first[m]), int(first[m] + size[m])
                rows = flat[a:b]
                found, inverse = np.unique(rows.view(f"V{rows.shape[1] * SYMBOL}").ravel(), return_inverse=True) if b - a > 64 else (None, None)
                trie = BlindTrie()
                if found is None:
                    for k in range(b - a):
                        trie.insert(rows[k].tobytes(), k)
                    runs = list(trie.runs())
                else:  # equal strings are put in one leaf at once
                    members = np.split(np.argsort(inverse, kind="stable"), np.cumsum(np.bincount(inverse))[:-1])
                    for k, x in enumerate(found):
                        trie.insert(x.tobytes(), k)
                    runs = [members[k].tolist() for leaf in trie.runs() for k in leaf]
                places, old, put = live[a:b], order[live[a:b]].copy(), 0
                for run in runs:
                    order[places[put : put + len(run)]] = old[run]
                    group[places[put : put + len(run)]] = places[put]
                    put += len(run)
    return order, group


def suffix_array(raw: bytes, shallow: int = 32) -> np.ndarray:
    """The suffix array of a short text; where one suffix is a prefix of another, the shorter one is first."""
    k = np.frombuffer(raw, np.uint8)
    # Bytes are spread over two, so that the padding after the end is below every byte.
    wide = np.stack([np.ones(len(k), np.uint8), k], 1).ravel()
    words = symbols(wide, 2 * len(k) + 16)
    order, _ = sort_suffixes(words, np.arange(0, 2 * len(k), 2), 2 * len(k) + 2, shallow)
    return order
