"""Byte-level BPE ids by the tokenizers library, each distinct chunk of text encoded once.

The library's pre-tokenizer never joins a space that follows a non-space character to what stands before it,
so a text cut before such spaces has the ids of its chunks, one after another. The same holds for a line feed before a
non-space character. Words recur, so a bounded memo of chunks spares most calls; a new chunk that ends with punctuation has the ids
of what stands before, which often is known, and of the punctuation. Added tokens hold no space and therefore lie in one chunk.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space or line feed before white space or the end: there chunks can't be cut at every one.
_ODD = re.compile(r"[ \n](?:\s|\Z)")
_CUT = re.compile(r"(?<=\S) ")
_LOADED: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 1_000_000, group: int = 1 << 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: By chunk without the space that stands before it; chunks that begin with a space or line feed are whole.
        self.memo: dict[str, bytes] = {}
        self.most = most
        #: Characters of text that are cut at once, or one longer text.
        self.group = group
        #: Of the marks that end chunks, a run of them.
        self.ends: dict[str, bytes] = {}
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: ASCII punctuation, but none that an added token holds.
        self.marks = "".join(sorted(set(string.punctuation) - set("".join(special.values()))))
        #: Bytes of text behind each id; a byte-level token has one character for each byte.
        self.bytes_of = np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks: those without white space at either end as one text, whose ids are then cut at the
        chunks' byte lengths (their edges are pre-token edges there too), the others one by one."""
        memo, plain, ended = self.memo, set(), []
        for c in chunks:
            bare = c[1:] if c[0] == "\n" else c
            if not bare or len(bare.strip()) < len(bare):
                memo[c] = self._one(c if c[0] in " \n" else f" {c}")
                continue
            stem = c.rstrip(self.marks)
            # Between a letter or digit and marks is a pre-token edge; only Latin ones, which all Unicode versions have.
            if len(stem) < len(c) and stem and stem[-1] < "\u0250" and stem[-1].isalnum():
                ended.append((c, stem))
                if stem not in memo:
                    plain.add(stem)
            else:
                plain.add(c)
        stems = list(plain)
        for i in range(0, len(stems), 256):
            part = stems[i : i + 256]
            texts = [c if c[0] == "\n" else f" {c}" for c in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.cumsum([len(t.encode()) for t in texts])
            at = np.searchsorted(ends, cuts)
            if not np.array_equal(ends[at], cuts):
                raise AssertionError("a token crosses the edge of a chunk")
            raw, last = ids.tobytes(), 0
            for c, k in zip(part, ((at + 1) * 4).tolist(), strict=True):
                memo[c] = raw[last:k]
                last = k
        for c, stem in ended:
            end = c[len(stem) :]
            if end not in self.ends:
                self.ends[end] = self._one(end)
            memo[c] = memo[stem] + self.ends[end]

    def _ids(self, cut: pa.LargeListArray) -> list[bytes]:
        """Ids of texts, each as its start, up to its first cut, and its chunks. Equal chunks are looked up once."""
        begin = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        words, rest = cut.flatten(), np.ones(len(cut.flatten()), bool)
        rest[begin] = False
        coded = words.filter(pa.array(rest)).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, keys))
        if None in found:
            new = [c for c, x in zip(keys, found, strict=True) if x is None]
            if len(self.memo) + len(new) > self.most:
                self.memo.clear()
                self.ends.clear()
                new, found = keys, [None] * len(keys)
            self._learn(new)
            found = [self.memo[c] if x is None else x for c, x in zip(keys, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(np.frombuffer(b"".join(found), "<u4")))
        raw = memoryview(each.take(coded.indices).flatten().to_numpy()).cast("B")
        # Ids before each chunk; chunks before each text are the words but for its and earlier texts' starts.
        before = 4 * np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        edges = before[np.append(begin, len(words)) - np.arange(len(begin) + 1)].tolist()
        heads = words.take(pa.array(begin)).to_pylist()
        return [self._one(h) + raw[a:b] for h, a, b in zip(heads, edges[:-1], edges[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):
            plain, odd, size = [], [], 0
            while at < len(texts) and size < self.group:
                (odd if _ODD.search(texts[at]) else plain).append(at)
                size += len(texts[at])
                at += 1
            if plain:
                whole = pa.array([texts[k].replace("\n", " \n") for k in plain], pa.large_string())
                cut = pc.split_pattern(whole, " ")
                for k, raw in zip(plain, self._ids(cut.cast(pa.large_list(pa.large_string()))), strict=True):
                    out[k] = raw
            if odd:
                parts = [_CUT.split(texts[k]) for k in odd]
                cut = pa.array([[x[0], *(f" {c}" if c[:1] in " \n" else c for c in x[1:])] for x in parts], pa.large_list(pa.large_string()))
                for k, raw in zip(odd, self._ids(cut), strict=True):
                    out[k] = raw
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]
