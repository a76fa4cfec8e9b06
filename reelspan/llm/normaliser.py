"""The normaliser of a SentencePiece model as a deterministic transducer.

A model's rule table is a double-array trie of UTF-8 keys, each with a text that replaces it. It compiles to the states
of a prefix tree: an arc reads a character, a final state writes the text of its rule. User-defined pieces are rules
that write themselves and go before all longer rules that begin with them. Where no rule matches, a character writes
itself; else the longest rule does. The last arc writes a space as the mark U+2581; with ``squeeze`` a space after a space, or at
either end, writes nothing. The transducer is functional, so its composition with an input is one chain, which ``apply`` returns.

Stretches without any character that begins a rule are passed over as a whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

MARK = "▁"


def rules(table: bytes) -> Iterator[tuple[str, str]]:
    """(key, text) of a precompiled rule table: the trie's size, its 32-bit units, the texts, each ended by a zero byte.
    Of a unit, bits 10 and up are the offset to its children (shifted by 8 more where bit 9 is set), bit 8 tells that
    a key ends there, the low byte is its label; a key's value stands at label 0."""
    if not table:
        return
    size = struct.unpack_from("<I", table)[0]
    units = np.frombuffer(table, "<u4", size // 4, 4)
    texts = table[4 + size :]
    labels = np.arange(1, 256, dtype=np.int64)

    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    todo = [(children(int(units[0])), b"")]
    while todo:
        base, key = todo.pop()
        at = base ^ labels
        inside = at < len(units)
        found = units[np.where(inside, at, 0)]
        for label in labels[inside & ((found & 0x800000FF) == labels)].tolist():
            unit, name = int(units[base ^ label]), key + bytes([label])
            below = (base ^ label) ^ children(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                yield name.decode(), texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, name))


class Normaliser:
    def __init__(self, pairs: Iterable[tuple[str, str]] = (), users: Iterable[str] = (), squeeze: bool = True, dummy_prefix: bool = True):
        self.squeeze, self.dummy_prefix = squeeze, dummy_prefix
        own = {u for u in users if u}
        mine = {k: v for k, v in pairs if not any(k[:n] in own for n in range(1, len(k) + 1))} | {u: u for u in own}
        if all(k == v for k, v in mine.items()) and not any(" " in k for k in mine):
            mine = {}  # the identity
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: list[str | None] = [None]
        for key, text in mine.items():
            state = 0
            for c in key:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.writes.append(None)
                state = self.arcs[state][c]
            self.writes[state] = text
        self.begins = re.compile("[" + "".join(map(re.escape, sorted(self.arcs[0]))) + "]") if mine else None

    def longest(self, text: str, at: int) -> tuple[str, int]:
        """What the longest rule at a place writes, and where it ends."""
        state, out, end, k = 0, text[at], at + 1, at
        while k < len(text):
            state = self.arcs[state].get(text[k], 0)
            k += 1
            if not state:
                break
            if self.writes[state] is not None:
                out, end = self.writes[state], k
        return out, end

    def written(self, text: str) -> Iterator[tuple[str, bool]]:
        """The outputs in order, and whether each is one rule's (or one character's)."""
        at = 0
        while at < len(text):
            m = self.begins.search(text, at)
            stop = m.start() if m else len(text)
            if stop > at:
                yield text[at:stop], False
            if m:
                out, at = self.longest(text, stop)
                yield out, True
            else:
                at = stop

    def apply(self, text: str) -> str:
        if self.begins is None:
            s = re.sub(" +", " ", text).lstrip(" ") if self.squeeze else text
        elif not self.squeeze:
            s = "".join(out for out, _ in self.written(text))
        else:
            parts, after_space = [], True
            for out, single in self.written(text):
                out = out.lstrip(" ") if after_space else out
                if out:
                    parts.append(out if single else re.sub(" +", " ", out))
                    after_space = out.endswith(" ")
                # what is empty leaves the state as it is
            s = "".join(parts)
        s = s.replace(" ", MARK)
        s = MARK + s if self.dummy_prefix and s else s
        return s.rstrip(MARK) if self.squeeze else s
