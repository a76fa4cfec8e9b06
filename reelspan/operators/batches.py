"""Signals of windows over whole batches of segments, by numpy.

Rows are segments, dealt and sorted by video and chunk. Texts are read as bytes, since all patterns are of ASCII characters: what a
segment adds to the signals is found for all segments of a batch at once. ``\\b`` is Java's, so letters, digits and marks of other
alphabets are looked up by code point. The segments of an anchor's longest window are a list, its windows prefixes of it, whose counts are
differences of running sums. What is rare (phrases, openers and first sentences over several segments) is searched in the joined texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reelspan import settings as S

SPACE, STOP, DIGIT, UPPER, LOWER, APOSTROPHE, WORD, EDGE = (1 << k for k in range(8))
#: Stands before the first text and after each; no UTF-8 text has it.
MARK = 0xFF
PAD = 16
SLICE = 4 << 20
STRIPPED = " \t\n\r\x0b\x0c"
TAIL = np.isin(np.arange(256), list(b".,!?;:"))
CLASSES = np.array([
    SPACE * (chr(k) in STRIPPED) + STOP * (chr(k) in ".?!") + DIGIT * (48 <= k < 58) + UPPER * (65 <= k < 91) + LOWER * (97 <= k < 123) + APOSTROPHE * (k == 39)
    + WORD * (48 <= k < 58 or 65 <= k < 91 or 97 <= k < 123 or k == 95) + EDGE * (k == MARK) for k in range(256)
], np.uint8)
LOWERED = np.array([k + 32 * (65 <= k < 91) for k in range(256)], np.uint8)
#: Characters whose lower case has an ASCII letter.
FOLDED = (("\u212a", "k"), ("\u0130", "i\u0307"))
OPENED = re.compile(rf"(?:^|{S.AFTER_END_PATTERN}|\n)\s*(?:{'|'.join(S.QUESTION_OPENERS)})".encode())
ODD_ENDS = sorted({" ".join(o.split(" ")[:k]).encode() for o in S.QUESTION_OPENERS for k in range(1, o.count(" ") + 1)})
REACTION = re.compile(S.REACTION_PATTERN.encode())
HOOK = re.compile(S.HOOK_PATTERN.replace("(?i)", "").replace(r"\b", ""), re.IGNORECASE | re.ASCII)
#: Each match of the hook pattern that doesn't begin with an amount or a percentage has one of these.
HOOK_PARTS = (b"talks", b"knows", b"truth", b"reason", b"problem", b"lost", b"made", b"quit", b"failed", b"heres", b"here's", b"people", b"thinks")


@lru_cache(1)
def kinds() -> np.ndarray:
    """By code point: 1 for letters and digits, 2 for non-spacing marks."""
    sort = {"Lu": 1, "Ll": 1, "Lt": 1, "Lm": 1, "Lo": 1, "Nd": 1, "Mn": 2}
    return np.fromiter((sort.get(unicodedata.category(chr(k)), 0) for k in range(0x110000)), np.uint8, 0x110000)


def _in_word(text: str, at: int) -> bool:
    """Whether Java takes the character for one of a word: marks count if a letter or digit stands before them."""
    if not 0 <= at < len(text):
        return False
    while at > 0 and kinds()[ord(text[at])] == 2:
        at -= 1
        if kinds()[ord(text[at])] == 0:
            return False
    return text[at] == "_" or kinds()[ord(text[at])] == 1


def places(blob: bytes, part: bytes) -> list[int]:
    """Where a part stands."""
    found, at = [], blob.find(part)
    while at >= 0:
        found.append(at)
        at = blob.find(part, at + 1)
    return found


def hook_matches(text: str) -> int:
    n = at = 0
    while m := HOOK.search(text, at):
        edge = lambda i: _in_word(text, i - 1) != _in_word(text, i)
        if m[0][0] in "$0123456789" or edge(m.start()) and edge(m.end()):
            n, at = n + 1, m.end()
        else:
            at = m.start() + 1
    return n


def head_values(text: str) -> tuple[float, float]:
    """Hook and coherence of a first sentence that isn't stripped yet."""
    head = text.strip(STRIPPED).rstrip(".?!")
    words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", head.lower()) if w]
    low = head.lower().strip(STRIPPED)
    first = words[0].rstrip(".,!?;:") if words else ""
    hook = max(0.0, min(1.0, 1.0 - 0.5 * (first in S.BAD_STARTERS) - 0.2 * (len(words) > 20) + min(hook_matches(head) * 0.2, 0.4))) if words else 0.0
    if low.startswith(S.CONTEXT_PHRASES):
        return hook, 0.1
    return hook, 0.6 if not low else 0.1 if first in S.NEEDS_CONTEXT else 0.8 if first in S.CLEAN_OPENERS else 0.6


class Texts:
    """The texts of a batch as one run of bytes, each followed by MARK: row i is buf[a[i]:b[i]]."""

    def __init__(self, column: pa.Array) -> None:
        marked = pc.binary_join_element_wise(column.cast(pa.binary()), pa.scalar(b"", pa.binary()), pa.scalar(bytes([MARK]), pa.binary()))
        off = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
        data = np.frombuffer(marked.buffers()[2], np.uint8)[off[0] : off[-1]]
        self.buf = np.concatenate([np.full(1, MARK, np.uint8), data, np.full(PAD, MARK, np.uint8)])
        self.edges = off - off[0] + 1
        self.a, self.b = self.edges[:-1], self.edges[1:] - 1
        self.c = CLASSES[self.buf]
        self.low = LOWERED[self.buf]
        ink = (self.c & (SPACE | EDGE)) == 0
        self.ts, self.te = self.runs(ink)
        self.first = np.searchsorted(self.ts, self.a)
        self.n_tokens = np.diff(np.append(self.first, np.searchsorted(self.ts, self.edges[-1])))
        self.said = self.n_tokens > 0

    @staticmethod
    def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the runs of a flag."""
        return np.flatnonzero(flag[1:] & ~flag[:-1]) + 1, np.flatnonzero(flag[:-1] & ~flag[1:]) + 1

    def count(self, at: np.ndarray) -> np.ndarray:
        """How many of ascending positions lie in each row."""
        return np.diff(np.searchsorted(at, self.edges)) if len(at) else np.zeros(len(self.a), np.int64)

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, at, "right") - 1

    def eight(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Up to eight lower-case bytes from each position on, as a number."""
        view = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        size = np.minimum(length, 8).astype(np.uint64)
        return view[np.minimum(at, len(view) - 1)] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * size)) if len(at) else np.zeros(0, np.uint64)

    def is_one(self, at: np.ndarray, length: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
        """Whether the bytes are one of the words, in lower case."""
        found, first, each = np.zeros(len(at), bool), self.eight(at, np.maximum(length, 1)), sorted({(int.from_bytes(w.encode()[:8], "little"), w.encode()) for w in words if w})
        if not each:
            return found
        keys = np.array([k for k, _ in each], np.uint64)
        near = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, first), len(keys) - 1)] == first)
        for key, w in each:
            hit = near[(first[near] == np.uint64(key)) & (length[near] == len(w))]
            found[hit if len(w) <= 8 else [k for k in hit.tolist() if self.low[at[k] : at[k] + len(w)].tobytes() == w]] = True
        return found

    def begins(self, at: np.ndarray, until: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
        """Whether one of some short words stands at the positions, before ``until``."""
        found = np.zeros(len(at), bool)
        for w in words:
            w = w.encode()
            hit = self.eight(at, min(len(w), 8)) == np.uint64(int.from_bytes(w[:8], "little"))
            for k in range(8, len(w)):
                hit &= self.low[np.minimum(at + k, len(self.low) - 1)] == w[k]
            found |= hit & (at + len(w) <= until)
        return found

    def lowered(self, lexicon: tuple[str, ...]) -> dict[str, np.ndarray]:
        """What depends on the lower-case text. Questions are asked by openers after an end or a new line (asked), or at the begin of the
        text (asks); opens: what follows begins one; odd: an opener of several words may go on in the next text, or a blank one has a new line."""
        c, buf, a, b, ts, te, first = self.c, self.buf, self.a, self.b, self.ts, self.te, self.first
        begin, end = self.runs((c & (UPPER | LOWER | APOSTROPHE)) != 0)
        out = {"words": self.count(begin), "hits": self.count(begin[self.is_one(begin, end - begin, lexicon)])}
        lines = np.flatnonzero(buf == 10)
        after_line = np.zeros(len(ts) + 1, bool)
        after_line[np.searchsorted(ts, lines)] = True
        after_line = after_line[:-1]
        if len(lines):  # a new line at a row's end says nothing of the next row's first token
            own = first[self.said]
            after_line[own] = np.searchsorted(lines, ts[own]) > np.searchsorted(lines, a[self.said])
        is_first = np.zeros(len(ts), bool)
        is_first[first[self.said]] = True
        ended = np.zeros(len(ts), bool)
        ended[1:] = (c[te[:-1] - 1] & STOP) != 0
        near = np.flatnonzero(after_line | (ended & ~is_first))
        row = self.row(ts[near])
        out["asked"] = self.count(ts[near][self.begins(ts[near], b[row], S.QUESTION_OPENERS)])
        asks, said = np.zeros(len(a), bool), np.flatnonzero(self.said)
        asks[said] = self.begins(ts[first[said]], b[said], S.QUESTION_OPENERS) & ~after_line[first[said]]
        last = te[first[said] + self.n_tokens[said] - 1]
        opens = np.zeros(len(a), bool)
        opens[said] = ((c[last - 1] & STOP) != 0) | (np.searchsorted(lines, b[said]) > np.searchsorted(lines, last))
        odd = ~self.said & (self.count(lines) > 0)
        for w in ODD_ENDS:
            hit = b - a >= len(w)
            for k in range(len(w)):
                hit &= self.low[np.maximum(b - len(w) + k, 0)] == w[k]
            odd |= hit
        return out | {"asks": asks, "opens": opens, "odd": odd}

    def in_words(self) -> np.ndarray:
        """For each byte whether Java takes its character for one of a word."""
        buf, word = self.buf, (self.c & WORD) != 0
        lead = np.flatnonzero((buf >= 0xC0) & (buf < 0xF8))
        if not len(lead):
            return word
        b0, b1, b2, b3 = (buf[lead + k].astype(np.int64) & m for k, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
        size = 2 + (b0 >= 0xE0).astype(int) + (b0 >= 0xF0)
        point = np.select([size == 2, size == 3], [(b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2], (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)
        kind = kinds()[np.minimum(point, 0x10FFFF)]
        word[lead] = kind == 1
        for k in (1, 2, 3):
            word[lead[size > k] + k] = kind[size > k] == 1
        for p, n in zip(lead[kind == 2].tolist(), size[kind == 2].tolist(), strict=True):
            word[p : p + n] = word[p - 1] and buf[p - 1] != 95
        return word

    def cased(self) -> dict[str, np.ndarray]:
        """What depends on the text as it is: figures, marks, reactions, capitalised words (begin, end, row; whether one begins a
        sentence within the text or the text itself), ended, and the first sentence's hook and coherence. ``stops``: it ends in this text."""
        c, buf, low, a, b, ts, te, first = self.c, self.buf, self.low, self.a, self.b, self.ts, self.te, self.first
        n, word, out = len(a), self.in_words(), {}
        amounts, shares = np.flatnonzero(buf == 36), np.flatnonzero(buf == 37)
        amounts = amounts[((c[amounts + 1] & DIGIT) != 0) | (buf[amounts + 1] == 44)]
        shares = shares[(c[shares - 1] & DIGIT) != 0]
        begin, end = self.runs((c & DIGIT) != 0)
        out["figures"] = self.count(amounts) + self.count(shares) + self.count(begin[~word[begin - 1] & ~word[end]])
        out["marks"] = self.count(np.flatnonzero(buf == 63))
        tags = [p for p in np.flatnonzero(buf == 91).tolist() if REACTION.match(low[p : p + 16].tobytes())]
        out["reactions"] = self.count(np.array(tags, np.int64))
        small = (c & LOWER) != 0
        begin = np.flatnonzero((c[1:-1] & UPPER).astype(bool) & ~word[:-2] & small[2:]) + 1
        ends = np.flatnonzero(small[:-1] & ~small[1:]) + 1
        end = ends[np.searchsorted(ends, begin + 1, "right")] if len(begin) else begin
        begin, end = begin[~word[end]], end[~word[end]]
        row = self.row(begin)
        pure = ((c[begin - 1] & (SPACE | EDGE)) != 0) & ((c[end] & (SPACE | EDGE)) != 0)
        token = np.minimum(np.searchsorted(ts, begin), max(0, len(ts) - 1))
        leads = pure & (token == first[row])
        out |= {"cap_begin": begin, "cap_end": end, "cap_row": row, "leads": leads, "starts": pure & ~leads & ((c[te[token - 1] - 1] & STOP) != 0)}

        said = np.flatnonzero(self.said)
        head_at, head_end = ts[first[said]], te[first[said] + self.n_tokens[said] - 1]
        ended = np.zeros(n, bool)
        ended[said] = (c[head_end - 1] & STOP) != 0
        stop = np.flatnonzero((c[:-1] & STOP).astype(bool) & (c[1:] & SPACE).astype(bool))
        cut = np.append(stop, len(buf))[np.searchsorted(stop, a)]
        inner = cut < b
        out |= {"ended": ended, "stops": inner | ((c[b - 1] & STOP) != 0), "cut": np.where(inner, cut + 1, b)}
        head_end = self.trimmed(head_at, np.where(inner[said], cut[said] + 1, head_end), (CLASSES & STOP) != 0)
        size = np.searchsorted(ts, head_end) - first[said]
        word_end = self.trimmed(head_at, np.minimum(te[first[said]], head_end), TAIL)
        one = lambda words: self.is_one(head_at, word_end - head_at, words)
        hook, coherence = np.zeros(n), np.full(n, 0.6)
        hook[said] = np.where(size > 0, 1.0 - 0.5 * one(S.BAD_STARTERS) - 0.2 * (size > 20), 0.0)
        coherence[said] = np.where(size == 0, 0.6, np.where(one(S.NEEDS_CONTEXT), 0.1, np.where(one(S.CLEAN_OPENERS), 0.8, 0.6)))
        rare = np.zeros(n, bool)
        rare[said] = self.begins(head_at, b[said], S.CONTEXT_PHRASES)
        blob = low.tobytes()
        for part in (*HOOK_PARTS, *(x.encode() for x, _ in FOLDED)):
            rare[self.row(np.array(places(blob, part), np.int64))] = True
        for at in (amounts, shares):
            rare[self.row(at)] = True
        for k in np.flatnonzero(rare & self.said).tolist():
            hook[k], coherence[k] = head_values(buf[a[k] : out["cut"][k]].tobytes().decode("utf-8", "replace"))
        return out | {"hook": hook, "coherence": coherence}

    def trimmed(self, begin: np.ndarray, end: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ends without the bytes that ``off`` names."""
        end = end.copy()
        left = np.flatnonzero((end > begin) & off[self.buf[end - 1]])
        while len(left):
            end[left] -= 1
            left = left[(end[left] > begin[left]) & off[self.buf[end[left] - 1]]]
        return end

    def text(self, k: int, end: int | None = None) -> bytes:
        return self.buf[self.a[k] : self.b[k] if end is None else end].tobytes()


def _codes(t: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each distinct word."""
    size = end - begin
    off = np.append(0, np.cumsum(size))
    data = t.buf[np.repeat(begin - off[:-1], size) + np.arange(off[-1])]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy()


def _spread(entries: np.ndarray, rows: np.ndarray, n_rows: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry whose row (of[entry]) is among the ascending ``rows``, with each place of it in ``rows``."""
    each = np.bincount(rows, minlength=n_rows)
    at = np.append(0, np.cumsum(each))
    entries = entries[each[of[entries]] > 0]
    times = each[of[entries]]
    off = np.append(0, np.cumsum(times))
    return np.repeat(entries, times), np.repeat(at[of[entries]] - off[:-1], times) + np.arange(off[-1])


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: half up by the shortest decimal form."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3).tolist():
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Each:
    """Each row as a list of its own, with one window."""

    def __init__(self, n: int) -> None:
        self.anchor = self.rows = self.of = self.begin = np.arange(n)
        self.ptr, self.count, self.apart = np.arange(n + 1), np.ones(n, np.int64), np.zeros(n, bool)
        self.window = (self.rows, np.zeros(n, np.int64))

    def total(self, values: np.ndarray) -> np.ndarray:
        return values


class Lists(Each):
    """For each anchor (a row) of whole groups of segments the rows that its longest window overlaps, and how many of them each window has."""

    def __init__(self, group: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray, last: np.ndarray, lengths: list[float]) -> None:
        """group: where each group begins, and the number of rows. Where segments follow one another the rows of a list do, too."""
        spans = np.array(lengths)
        until = start[:, None] + spans
        fits = (until <= (last + 1e-9)[:, None]) & own[:, None]
        self.anchor = np.flatnonzero(fits.any(1))
        self.until, self.fits = until[self.anchor], fits[self.anchor]
        longest = np.where(self.fits, self.until, -np.inf).max(1) if len(self.anchor) else np.zeros(0)
        self.n, size, odd = np.zeros(self.until.shape, np.int64), np.zeros(len(self.anchor), np.int64), {}
        bad = ~(end > start)
        within = np.ones(len(start), bool)
        within[group[1:] - 1] = False
        bad[:-1] |= (end[:-1] > start[1:]) & within[:-1]
        messy = np.add.reduceat(bad.astype(int), group[:-1]) > 0
        cuts = np.searchsorted(self.anchor, group)
        for g in range(len(group) - 1):
            k, m = cuts[g], cuts[g + 1]
            if k == m:
                continue
            i, j = group[g], group[g + 1]
            begun = i + np.searchsorted(start[i:j], self.until[k:m])
            if not messy[g]:
                self.n[k:m] = begun - self.anchor[k:m, None]
                continue
            reached = np.maximum.accumulate(end[i:j])
            for x in range(k, m):
                at = start[self.anchor[x]]
                lo, hi = i + np.searchsorted(reached, at, "right"), i + np.searchsorted(start[i:j], longest[x])
                odd[x] = rows = lo + np.flatnonzero(end[lo:hi] > at)
                self.n[x] = np.searchsorted(start[rows], self.until[x])
        size = np.where(self.fits, self.n, 0).max(1) if len(self.anchor) else size
        self.ptr = np.append(0, np.cumsum(size))
        self.rows = np.repeat(self.anchor - self.ptr[:-1], size) + np.arange(self.ptr[-1])
        for x, rows in odd.items():
            self.rows[self.ptr[x] : self.ptr[x + 1]] = rows
        self.of = np.repeat(np.arange(len(self.anchor)), size)
        self.apart = np.zeros(len(self.anchor), bool)  # lists of rows that don't follow one another
        self.apart[list(odd)] = True
        self.window = np.nonzero(self.fits)
        self.count = self.n[self.window]
        self.begin = self.ptr[self.window[0]]

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum over each window of values by entry."""
        run = np.append(0, np.cumsum(values))
        return run[self.begin + self.count] - run[self.begin]


def window_values(texts: pa.Array, lists: Each, lexicon: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The signals of each window of ``lists``."""
    t = Texts(texts)
    low = t
    if any(x.encode() in t.buf.tobytes() for x, _ in FOLDED):
        for x, y in FOLDED:
            texts = pc.replace_substring(texts, x, y)
        low = Texts(texts)
    f, g, rows, n_rows = t.cased(), low.lowered(lexicon), lists.rows, len(t.a)
    # Of the entries said (not blank): whether it is the list's first or what was said before it ended a sentence, or opened a question.
    entries = np.arange(len(rows)) if t.said.all() else np.flatnonzero(t.said[rows])
    own = rows[entries]
    begins = np.ones(len(entries), bool)
    begins[1:] = lists.of[entries[1:]] != lists.of[entries[:-1]]
    leading, asking = begins.copy(), begins.copy()
    leading[1:] |= f["ended"][own[:-1]]
    asking[1:] |= g["opens"][own[:-1]]
    asked = np.zeros(len(rows), np.int64)
    asked[entries] = g["asked"][own] + (asking & g["asks"][own])

    # A capitalised word counts from the entry that has it until one begins a sentence with it.
    terms = np.zeros(len(rows) + 1, np.int64)
    starter = f["starts"] | f["leads"]
    free = np.flatnonzero(~starter)
    first_cap = np.full(n_rows, -1)
    first_cap[f["cap_row"][f["leads"]]] = np.flatnonzero(f["leads"])
    loose = entries[~leading & (first_cap[own] >= 0)]
    if len(free) or len(loose):
        code = _codes(t, f["cap_begin"], f["cap_end"])
        at, place = _spread(entries, f["cap_row"][free], n_rows, rows)
        at, place = np.append(at, loose), np.append(free[place], first_cap[rows[loose]])
        wanted = np.zeros(int(code.max()) + 1, bool)
        wanted[code[place]] = True
        able = np.flatnonzero(starter & wanted[code])
        by, which = _spread(entries, f["cap_row"][able], n_rows, rows)
        leads = np.zeros(len(rows), bool)
        leads[entries] = leading
        kept = f["starts"][able[which]] | leads[by]
        by, which = by[kept], able[which[kept]]
        key, back = np.unique(lists.of[at] * len(wanted) + code[place], return_inverse=True)
        until = np.full(len(key), len(rows))
        if len(by) and len(key):
            theirs = lists.of[by] * len(wanted) + code[which]
            k = np.minimum(np.searchsorted(key, theirs), len(key) - 1)
            same = key[k] == theirs
            np.minimum.at(until, k[same], by[same])
        np.add.at(terms, at, 1)
        np.add.at(terms, np.maximum(at, until[back]), -1)
    out = {m: lists.total(v[rows]) for m, v in (("words", g["words"]), ("hits", g["hits"]), ("figures", f["figures"]), ("marks", f["marks"]), ("reactions", f["reactions"]))}
    out |= {"asked": lists.total(asked), "terms": lists.total(terms[:-1]), "phrases": lists.total(_phrases(low, lists))}

    # In odd cases openers are searched in the joined text.
    first_window = np.searchsorted(lists.window[0], np.arange(len(lists.anchor) + 1))
    windows = lambda k: range(first_window[k], first_window[k + 1])
    for k in np.unique(lists.of[g["odd"][rows]]).tolist():
        parts = [LOWERED[low.buf[low.a[r] : low.b[r]]].tobytes() for r in rows[lists.ptr[k] : lists.ptr[k + 1]].tolist()]
        met = np.array([m.end() for m in OPENED.finditer(b" ".join(parts))], np.int64)
        ends = np.append(0, np.cumsum([len(p) + 1 for p in parts]) - 1)
        for w in windows(k):
            out["asked"][w] = np.searchsorted(met, ends[lists.count[w]], "right")

    # First sentences: mostly that of the list's first row.
    some = lists.count > 0
    head = rows[np.minimum(lists.begin, max(0, len(rows) - 1))] if len(rows) else np.zeros(len(some), np.int64)
    hook, coherence = (np.where(some, f[m][head] if n_rows else 0.0, e) for m, e in (("hook", 0.0), ("coherence", 0.6)))
    for k in np.unique(lists.window[0][some & (lists.count > 1) & ~f["stops"][head]]).tolist() if n_rows else ():
        mine, known = rows[lists.ptr[k] : lists.ptr[k + 1]], {}
        stop = np.flatnonzero(f["stops"][mine])
        most = int(stop[0]) + 1 if len(stop) else len(mine)
        for w in windows(k):
            n = min(int(lists.count[w]), most)
            if n > 1:
                if n not in known:
                    known[n] = head_values(b" ".join([*(t.text(r) for r in mine[: n - 1].tolist()), t.text(mine[n - 1], f["cut"][mine[n - 1]])]).decode("utf-8", "replace"))
                hook[w], coherence[w] = known[n]
    words, figures = out["words"], out["figures"] + out["terms"]
    sentiment = np.where(words == 0, 0.0, np.minimum(1.0, out["hits"] / np.maximum(1.0, words / 8.0)))
    curiosity = np.clip((np.minimum(1.0, (out["marks"] + out["asked"]) / 3.0) + np.minimum(1.0, out["phrases"] / 2.0)) / 2, 0.0, 1.0)
    return {"hook": hook, "coherence": coherence, "sentiment": sentiment, "specificity": np.minimum(1.0, figures / 3.0), "curiosity": curiosity, "laughter": np.minimum(1.0, out["reactions"] / 2.0)}


def _phrases(t: Texts, lists: Each) -> np.ndarray:
    """For each entry how many phrases end there for the first time in the list's joined text."""
    found = np.zeros(len(lists.rows), np.int64)
    blob, held = np.where(t.buf == MARK, 32, t.low).astype(np.uint8).tobytes(), []
    for p in S.HOOK_PHRASES:
        held += [(at, at + len(p.encode()) - 1, p) for at in places(blob, p.encode())]
    if held:
        begin, end = (t.row(np.array([h[k] for h in held], np.int64)) for k in (0, 1))
        order = np.argsort(end, kind="stable")
        at, which = _spread(np.flatnonzero(~lists.apart[lists.of]), end[order], len(t.a), lists.rows)
        seen = set()
        for e, k in zip(at.tolist(), order[which].tolist(), strict=True):
            x = int(lists.of[e])
            if begin[k] >= lists.anchor[x] and (x, held[k][2]) not in seen:
                seen.add((x, held[k][2]))
                found[e] += 1
    for x in np.flatnonzero(lists.apart).tolist():
        parts = [t.low[t.a[r] : t.b[r]].tobytes() for r in lists.rows[lists.ptr[x] : lists.ptr[x + 1]].tolist()]
        joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]) - 1
        for p in S.HOOK_PHRASES:
            if (at := joined.find(p.encode())) >= 0:
                found[lists.ptr[x] + int(np.searchsorted(ends, at + len(p.encode())))] += 1
    return found


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that agree in ``keys`` (they follow one another), with where each group begins, and the number of rows."""
    held: list[pa.RecordBatch] = []

    def changed(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            null = x.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        return new

    def grouped(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return table, np.append(np.flatnonzero(changed(table)), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        tail = held[-1:] and pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
        begin = np.flatnonzero(changed(tail)[1:]) if tail else np.flatnonzero(changed(pa.Table.from_batches([batch])))
        if len(begin) and (held or begin[-1] > 0):
            yield grouped(pa.Table.from_batches([*held, batch.slice(0, begin[-1])]))
            held = [batch.slice(begin[-1])]
        else:
            held.append(batch)
    if held:
        yield grouped(pa.Table.from_batches(held))


def contenders(group: np.ndarray, start: np.ndarray, end: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int, longest: float) -> np.ndarray:
    """Of windows in order of group and rank those that the greedy walk may keep, as ``select.contenders`` finds them for one chunk;
    begins and ends: of each window's chunk, infinite where no chunk lies beside it."""
    kept = []
    off = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
    for i, j in zip(off[:-1], off[1:], strict=True):
        a, b, left, sure, held = start[i:j], end[i:j], np.arange(j - i), 0, []
        edge = (a - longest < begins[i]) | (b > ends[i])
        while len(left) and sure < k:
            c = int(left[0])
            kept.append(i + c)
            left = left[1:]
            if edge[c] or any(a[c] < b[h] and b[c] > a[h] for h in held):
                held.append(c)
                left = left[(a[left] > a[c]) | (b[left] < b[c])]
            else:
                sure += 1
                left = left[(a[left] >= b[c]) | (b[left] <= a[c])]
    return np.array(kept, np.int64)


#: Kinds of rows beside segments: start and the values a and b.
FRAME, PAUSE, CLUSTER, SECOND, PAIR = range(1, 6)  # energy, laughter; none; count; comments, sponsored ones; the same, of start and end


def beside(table: pa.Table, group: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray, pause_s: float, reach_s: float) -> dict[str, np.ndarray]:
    """For windows in order of their groups (of) what the rows of a kind in their group say: frames in [start, end), pauses from ``pause_s``
    before the start on, the share of the largest cluster, confidence, and the share of sponsored comments up to ``reach_s`` beside the window."""
    names = ("audio_energy", "audio_laughter", "audio_pause", "social", "confidence", "sponsored")
    out = {n: np.zeros(len(of)) for n in names}
    is_one = table.column("kind").is_valid().to_numpy()
    rows = table.select(["kind", "start", "end", "a", "b"]).filter(pa.array(is_one))
    off = np.append(0, np.cumsum(np.add.reduceat(is_one.astype(np.int64), group[:-1])))
    kind, at, to, a, b = (pc.fill_null(rows.column(n), 0).to_numpy() for n in rows.column_names)
    heads = table.take(group[:-1])
    most, sure = (pc.fill_null(heads.column(n), 0).to_numpy() for n in ("max_count", "confidence"))
    out["confidence"] = sure[of]
    groups = np.flatnonzero(np.diff(off) > 0)
    for g, i, j in zip(groups.tolist(), np.searchsorted(of, groups).tolist(), np.searchsorted(of, groups, "right").tolist(), strict=True):
        if i == j:
            continue
        s, e, own = start[i:j], end[i:j], slice(off[g], off[g + 1])
        some = lambda k, own=own: tuple(x[own][kind[own] == k] for x in (at, to, a, b))
        t, _, energy, laughter = some(FRAME)
        lo, hi = np.searchsorted(t, s), np.searchsorted(t, e)
        for n, v in (("audio_energy", energy), ("audio_laughter", laughter)):
            run = np.append(0.0, np.cumsum(v))
            out[n][i:j] = np.clip(np.where(hi > lo, rounded((run[hi] - run[lo]) / np.maximum(hi - lo, 1), 12), 0.0), 0.0, 1.0)
        t = some(PAUSE)[0]
        out["audio_pause"][i:j] = np.minimum(1.0, (np.searchsorted(t, e) - np.searchsorted(t, s - pause_s)) / 3.0)
        t, _, count, _ = some(CLUSTER)
        if len(t) and most[g] > 0:
            best = np.zeros(j - i)
            for centre, n in zip(t.tolist(), count.tolist(), strict=True):
                best = np.where((centre >= s) & (centre <= e), np.maximum(best, n), best)
            out["social"][i:j] = np.minimum(1.0, best / most[g])
        t, _, n, sponsored = some(SECOND)
        low, high = s - reach_s, e + reach_s
        lo, hi = np.searchsorted(t, low), np.searchsorted(t, high, "right")
        near = [run[hi] - run[lo] for run in (np.append(0.0, np.cumsum(v)) for v in (n, sponsored))]
        t, u, n, sponsored = some(PAIR)
        if len(t):  # of a comment that names several seconds only one counts
            lo, hi = np.searchsorted(t, low), np.searchsorted(t, high, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                again = u[lo[k] : hi[k]] <= high[k]
                near[0][k] -= n[lo[k] : hi[k]][again].sum()
                near[1][k] -= sponsored[lo[k] : hi[k]][again].sum()
        out["sponsored"][i:j] = np.divide(near[1], near[0], out=np.zeros(j - i), where=near[0] != 0)
    return out


def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: a row for each sentence of rows (id, text): id, its place, its begin and end in words, the text. A text
    without words is one empty sentence."""
    for batch in batches:
        text = pc.fill_null(batch.column(1), "")
        total = np.append(0, np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64)))
        at = 0
        while at < len(text):  # some MB at a time
            until = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, "right")) - 1)
            t = Texts(text.slice(at, until - at))
            begins = np.zeros(len(t.ts), bool)
            begins[1:] = (t.c[t.te[:-1] - 1] & STOP) != 0
            begins[t.first[t.said]] = True
            token = np.flatnonzero(begins)
            row = t.row(t.ts[token])
            each = np.bincount(row, minlength=len(t.a))
            off = np.append(0, np.cumsum(np.maximum(each, 1)))
            order = np.arange(len(token)) - (np.cumsum(each) - each)[row]
            place = off[row] + order
            ends = np.append(token[1:], len(t.ts)) - 1
            begin, end = t.ts[token], t.te[ends]
            size, index, first, last = (np.zeros(off[-1], np.int64) for _ in range(4))
            size[place], index[place], first[place], last[place] = end - begin, order, token - t.first[row], ends + 1 - t.first[row]
            step = np.zeros(len(t.buf), np.int8)
            step[begin] += 1
            step[end] -= 1
            data = t.buf[np.cumsum(step, dtype=np.int8).view(bool)]
            found = pa.StringArray.from_buffers(off[-1], pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data))
            ids = batch.column(0).take(pa.array(at + np.repeat(np.arange(len(t.a)), np.maximum(each, 1))))
            made = pa.table({"id": ids, "index": pa.array(index.astype(np.int32)), "first": pa.array(first), "last": pa.array(last), "text": found})
            yield from made.to_batches(max_chunksize=65_536)
            at = until


def scorer(lengths: list[float], lexicon: tuple[str, ...], finish: Callable[[dict], dict] | None = None, reach: tuple[float, float] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: windows with their signals from rows (video_id, chunk, home, start, end, text, before, timeline_end, prior, next) in
    order, of which each group's first, without a start, has the last four (prior, next: whether segments begin in the chunks beside). ``finish`` gets the columns and says which to return. With ``reach`` (the last
    arguments of ``beside``) there are rows of a kind too, and columns kind, a, b, max_count, confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ("video_id", "chunk")):
            is_seg = table.column("start").is_valid().to_numpy()
            if reach:
                is_seg &= table.column("kind").is_null().to_numpy()
            heads = table.take(group[:-1])
            sizes = np.add.reduceat(is_seg.astype(np.int64), group[:-1])
            segs = table.filter(pa.array(is_seg)).combine_chunks()
            if not segs.num_rows:
                continue
            which = np.repeat(np.arange(len(sizes)), sizes)
            whole = heads.select(["before", "timeline_end"]).to_pydict()
            before = np.array([x or 0 for x in whole["before"]], np.int64)[which]
            last = np.array([-np.inf if x is None else x for x in whole["timeline_end"]])[which]
            start, end, home, chunk = (segs.column(n).to_numpy() for n in ("start", "end", "home", "chunk"))
            own = home == chunk
            all_groups, group = group, np.append(0, np.cumsum(sizes))
            turn = np.cumsum(own) - 1
            turn = turn - (np.append(0, np.cumsum(own))[group[:-1]])[which]
            lists = Lists(np.append(group[:-1][sizes > 0], len(start)), start, end, own, last, lengths)
            if not len(lists.count):
                continue
            text = segs.column("text")
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            values = window_values(text, lists, lexicon)
            row, k = lists.anchor[lists.window[0]], lists.window[1]
            near = {n: pc.fill_null(heads.column(n), True).to_numpy()[which[row]] for n in ("prior", "next")}
            made = {"video_id": segs.column("video_id"), "row": row, "group": which[row], **near, "chunk": chunk[row], "timeline_end": last[row], "anchor": (before + turn)[row].astype(np.int32), "start_s": start[row], "len_idx": k.astype(np.int32), "length": np.array(lengths)[k], "end_s": lists.until[lists.window], **values}
            if reach:
                made |= beside(table, all_groups, which[row], made["start_s"], made["end_s"], *reach)
            made = finish(made) if finish else made
            made = {n: v for n, v in made.items() if n not in ("group", *near)}
            video = made.pop("video_id").take(pa.array(made.pop("row")))
            video = video.combine_chunks() if isinstance(video, pa.ChunkedArray) else video
            for b in pa.table({"video_id": video, **{m: pa.array(v) for m, v in made.items()}}).combine_chunks().to_batches(max_chunksize=65_536):
                yield b

    return run


def text_scorer(names: tuple[str, ...], lexicon: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows with the signals of their column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = window_values(pc.fill_null(batch.column("text"), ""), Each(batch.num_rows), lexicon)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[n]) for n in names)], [*batch.schema.names, *names])

    return run
