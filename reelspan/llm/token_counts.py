"""Token counts by a sentencepiece BPE model, huge documents by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. A token that two neighbours share (same id, begin and
end) is a stable boundary: a sequence of BPE tokens is the encoding of its text if and only if each two adjacent
tokens are that of theirs, and left of the shared token's end all adjacent pairs stand in one encoding, right of its
begin in the other. Where no token is shared the overlap is doubled, at last to the whole of both chunks.

Shorter documents: no piece of such a model holds a space mark after another character (checked when it is loaded),
so the runs of spaces with the word after them are encoded independently, each distinct one once.

Nulls: a null text counts as empty, 0 tokens. Rows that share a doc_id, or have none, each give a row. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common

MARK = "▁"
_RUN = re.compile(r" +[^ ]*")
_LOADED: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 256, most: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = [self.model.is_byte(i) for i in range(n)]
        odd = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(n) if not self.model.is_control(i))
        plain = self.model.encode("a  b ", out_type=str) == [f"{MARK}a", MARK, f"{MARK}b", MARK] or "".join(self.model.encode("a  b ", out_type=str)) == f"{MARK}a{MARK}{MARK}b{MARK}"
        #: Whether texts may be cut before runs of spaces.
        self.by_word = plain and not odd
        #: Whether spaces are kept, so that offsets of a chunk are those of the text.
        self.plain = plain
        self.chunk, self.overlap, self.most = chunk, overlap, most
        self.memo: dict[str, int] = {}

    def tokens(self, text: str, at: int = 0) -> list[tuple[int, int, int]]:
        """(id, begin, end) in code points, moved by ``at``."""
        found = self.model.encode(text, return_type="offset_mapping")
        return [(i, a + at, b + at) for i, (a, b) in zip(found["ids"], found["offsets"], strict=True)]

    def long_ids(self, text: str) -> list[int]:
        """The ids of a text of any length, chunk by chunk; what is accepted is held in flat arrays."""
        ids, begins, ends = array("i"), array("q"), array("q")
        stop = 0
        while stop < len(text):
            width, after = self.overlap, min(len(text), stop + self.chunk)
            while True:
                b = max(0, stop - width)
                right = self.tokens(text[b:after], b)
                if b == 0:  # from the text's begin there is nothing to align with
                    keep, first = 0, 0
                    break
                # The first token of a chunk may hold the space mark that the library puts before a text.
                inner = {t: k for k, t in enumerate(right) if t[1] > b and t[2] > t[1] and not self.is_byte[t[0]]}
                k, keep = len(ids) - 1, -1
                while k >= 0 and begins[k] > b:
                    if (ids[k], begins[k], ends[k]) in inner:
                        keep, first = k + 1, inner[ids[k], begins[k], ends[k]] + 1
                        break
                    k -= 1
                if keep >= 0:
                    break
                width *= 2
            del ids[keep:], begins[keep:], ends[keep:]
            for i, x, y in right[first:]:
                ids.append(i)
                begins.append(x)
                ends.append(y)
            stop = after
        return ids.tolist()

    def counts(self, texts: list[str]) -> list[int]:
        out, cut = [], []
        for t in texts:
            if len(t) > 2 * self.chunk and self.plain:
                out.append(len(self.long_ids(t)))
                cut.append(None)
            elif not self.by_word or MARK in t:
                out.append(len(self.model.encode(t)))
                cut.append(None)
            else:
                out.append(0)
                cut.append([] if not t else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else [c[1:] for c in _RUN.findall(f" {t}")])
        new = {c for x in cut if x for c in x if c not in self.memo}
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = {c for x in cut if x for c in x}
        todo = list(new)
        for i in range(0, len(todo), 8192):
            # A chunk keeps the spaces before it but one, which the library adds to any text but an empty one.
            for c, ids in zip(todo[i : i + 8192], self.model.encode(todo[i : i + 8192], num_threads=1), strict=True):
                self.memo[c] = len(ids) if c else 1
        get = self.memo.__getitem__
        return [sum(map(get, x)) if x is not None else n for n, x in zip(out, cut, strict=True)]


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs(doc_id, text)``; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model_path)
        for batch in common.sliced(batches):
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                n = tool.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], schema=schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), F.octet_length(common.text_of()).cast("long").alias("n_bytes"))
    return found.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
