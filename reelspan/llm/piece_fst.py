"""SentencePiece encoding and decoding as a weighted transducer over the tropical semiring.

A model compiles to three transducers. The normaliser (``normaliser.py``) applies the model's rule table, maps a space to the
mark U+2581 and puts one before a text. The piece transducer reads a piece's characters and writes its id; for a unigram model the arc weighs minus the
piece's score, for a BPE model its state is the piece just written and an arc exists (weight 0, else infinity) only
if the two adjacent pieces are the BPE encoding of their own text. A sequence of pieces is a text's BPE encoding if and only
if all its adjacent pairs are, so exactly one path has a finite weight. A character that is in no piece takes the
byte-fallback arc. ``encode`` composes these with the input lazily, position by position, and takes the shortest
path. ``decode`` runs the transducer backwards.

Where no piece holds the mark after another character, paths meet before each run of marks, so the text is cut there
and each distinct part is composed once.

Nulls: a null text is the empty text: no ids. Rows that share a doc_id, or have none, each give a row. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.normaliser import MARK, Normaliser, rules

#: The piece types of the model file that can be written by the piece transducer (normal, user-defined, unused).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, PieceTransducer] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message, by number."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            at += 8
            yield tag >> 3, raw[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, raw[at - n : at]
        else:
            at += 4
            yield tag >> 3, raw[at - 4 : at]


class PieceTransducer:
    def __init__(self, model: bytes, most: int = 500_000):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                found = dict(_fields(value))
                self.pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, b"\0\0\0\0"))[0], found.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that write a space as a mark, and before a word, are compiled")
        self.bpe = trainer.get(3, 1) == 2
        if not self.bpe and trainer.get(3, 1) != 1:
            raise ValueError("only unigram and BPE models are compiled")
        self.dummy_prefix = bool(normal.get(3, 1))
        kinds = (NORMAL, USER, UNUSED) if self.bpe else (NORMAL, USER)  # merging may pass through unused pieces
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in kinds}
        self.weight = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        users = sorted((p for p, _, kind in self.pieces if kind == USER), key=lambda p: (-len(p), p))
        # User-defined pieces are taken before all others: BPE cuts the text at them, a unigram path is paid for them.
        self.users = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users and self.bpe else None
        self.normaliser = Normaliser(rules(normal.get(2, b"")), users, bool(normal.get(4, 1)), self.dummy_prefix)
        best = max([0.0, *(score for _, score, kind in self.pieces if kind == NORMAL)])
        self.weight |= {} if self.bpe else {p: 0.1 - len(p.encode()) * best for p in users}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.by_part = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        place = {w: 2 * k for k, w in enumerate(sorted(set(self.weight.values())))}
        self.rank = {p: place[w] for p, w in self.weight.items()}
        self.halves: dict[str, list[str]] = {}
        self.late: set[str] = set()
        #: Of each string that a piece begins with the longest piece that is alone and begins it, or its first character.
        self.longest_in: dict[str, str] = {}
        for p in sorted(self.ids, key=len) if self.bpe else ():
            for k in range(2, len(p) + 1):
                if p[:k] not in self.longest_in:
                    self.longest_in[p[:k]] = p[:k] if p[:k] in self.ids and self.alone(p[:k]) else self.longest_in.get(p[: k - 1], p[0])
        self.ids_of: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.most = most
        self.text_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    # Compilation of the BPE arcs, as they are asked for.
    def merged(self, text: str, most: int = 1) -> list[str]:
        """The pieces of a short text by merging the best adjacent pair, leftmost first, until none is a piece or ``most`` are left."""
        parts = list(text)
        while len(parts) > most:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                w = self.weight.get(parts[k] + parts[k + 1], math.inf)
                if w < best:
                    best, at = w, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses from ``left`` to ``right``: the merges that made both are undone, the latest first, and between
        them the pieces at the edges must not be one that would have been merged before. Ranks are even, ties go to the left."""
        rank, halves = self.rank, self.halves
        a = rank[left] if len(left) > 1 else -1
        b = rank[right] if len(right) > 1 else -1
        limit = math.inf
        while True:
            if rank.get(left + right, math.inf) < limit:
                return False
            if a > b:
                limit, left = a, halves[left][1]
                a = rank[left] if len(left) > 1 else -1
            elif b >= 0:
                limit, right = b + 1, halves[right][0]
                b = rank[right] if len(right) > 1 else -1
            else:
                return True

    def allowed(self, left: str, right: str) -> bool:
        """Whether the BPE arc from ``left`` to ``right``, each alone one piece, exists."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            known = self.apart(left, right) if left not in self.late and right not in self.late else self.merged(left + right) == [left, right]
            self.pairs[key] = known
        return known

    def alone(self, piece: str) -> bool:
        """Whether a piece of the table is the encoding of its own text. The halves that it was merged from are kept, and in ``late``
        those that have a half, or a half's half, which ranks behind: of these the order of merges isn't that of ranks."""
        known = self.whole.get(piece)
        if known is None:
            halves = self.merged(piece, 2)
            known = self.whole[piece] = len(halves) == 2
            if known:
                self.halves[piece] = halves
                long = [h for h in halves if len(h) > 1]
                known = all([self.alone(h) for h in long])  # always, but it fills the table
                if any(h in self.late or self.rank[h] >= self.rank[piece] for h in long):
                    self.late.add(piece)
        return known

    def bpe_path(self, s: str) -> list[str]:
        """The one path of finite weight, depth first and longest arcs first. As at most one such path leads to a position, one
        from which none goes on is left for good."""
        n, at, left, out, dead = len(s), 0, None, [], set()
        longest, known, allowed = self.longest_in.get, self.pairs.get, self.allowed
        while at < n:
            piece, end = s[at], at + 2
            if at + 4 <= n and (p := longest(s[at : at + 4])):  # most arcs are about as long
                piece, end = p, at + 5
            while end <= n and (p := longest(s[at:end])):
                piece = p
                end += 1
            while True:
                end = at + len(piece)
                if end not in dead and (left is None or known((left, piece)) or allowed(left, piece)):
                    out.append(piece)
                    at, left = end, piece
                    break
                if len(piece) > 1:
                    piece = self.longest_in.get(piece[:-1], piece[0])
                elif out:
                    dead.add(at)
                    piece = out.pop()
                    at -= len(piece)
                    left = out[-1] if out else None
                else:
                    raise AssertionError("no path")
        return out

    def shortest_path(self, s: str) -> list[str]:
        """The pieces on the path of least weight through input ∘ pieces; characters in no piece stand alone."""
        if self.bpe:
            return self.bpe_path(s)
        n = len(s)
        cost, back = [math.inf] * (n + 1), [""] * (n + 1)
        cost[0] = 0.0
        worst = min((-w for w in self.weight.values()), default=0.0) - 10.0
        for b in range(1, n + 1):
            for a in range(b - 1, max(-1, b - 1 - self.longest), -1):
                if cost[a] == math.inf:
                    continue
                piece = s[a:b]
                if piece in self.weight or b - a == 1:
                    w = cost[a] + self.weight.get(piece, -worst)
                    if w < cost[b]:
                        cost[b], back[b] = w, piece
        if cost[n] == math.inf:
            raise AssertionError("no path")
        out, at = [], n
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def used(self, piece: str) -> list[str]:
        """The piece, or where it is unused the two that it was merged from, and so on."""
        at = self.ids.get(piece)
        if at is None or len(piece) == 1 or self.pieces[at][2] != UNUSED:
            return [piece]
        return [x for half in self.merged(piece, 2) for x in self.used(half)]

    def _ids(self, piece: str) -> bytes:
        """The ids that a piece of a path is written as."""
        known = self.ids_of.get(piece)
        if known is None:
            ids: list[int] = []
            for x in self.used(piece):
                if x in self.ids:
                    ids.append(self.ids[x])
                elif self.byte:
                    ids += [self.byte[c] for c in x.encode()]
                else:
                    ids.append(self.unknown)
            known = self.ids_of[piece] = np.array(ids, "<u4").tobytes()
        return known

    def _part(self, part: str) -> bytes:
        if self.users and self.users.search(part):
            found = [p for k, x in enumerate(self.users.split(part)) if x for p in ([x] if k % 2 else self.shortest_path(x))]
        else:
            found = self.shortest_path(part)
        return b"".join(map(self._ids, found))

    def encode_raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        s = self.normaliser.apply(text)
        parts = _PART.findall(s) if self.by_part else [s] * bool(s)
        memo = self.memo
        for p in set(parts).difference(memo):
            if len(memo) > self.most:
                memo.clear()
            memo[p] = self._part(p)
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:  # the memo was emptied
            return b"".join(map(self._part, parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def transducer(path: str) -> PieceTransducer:
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = PieceTransducer(f.read())
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) for each row of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(model_path)
        for b in common.sliced(batches):
            rows = ((d, len(raw) // 4, raw) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for raw in [tool.encode_raw(t)])
            yield from common.in_slices(rows, schema, 256)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(ids: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for rows of ``encode_documents``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(model_path)
        for b in common.sliced(batches):
            rows = ((d, tool.decode(np.frombuffer(raw, "<u4").tolist())) for d, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True))
            yield from common.in_slices(rows, schema, 256)

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, ids_crc32, decoded_sha256, same_text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("same_text", pa.bool_())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(model_path)

        def rows() -> Iterator[tuple]:
            for b in common.sliced(batches):
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    raw = tool.encode_raw(t)
                    back = tool.decode(np.frombuffer(raw, "<u4").tolist())
                    yield d, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == t

        yield from common.in_slices(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(both, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same_text boolean")
