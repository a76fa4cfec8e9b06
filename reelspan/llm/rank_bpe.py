"""Byte-level BPE by the tiktoken library and a local rank file: ids of whole texts, and the raw bytes behind ids.

The library's matcher recurses, so it fails on a match of some hundred thousand characters. Texts longer than ``limit``
are therefore split before it sees them, only where every match must end: between a character other than white space and
U+0020 (no match of a byte-level pattern holds such a pair, and none looks behind). Where no such place is within reach
the part is split by the pattern outside the library, and each match is encoded by itself, whatever its length.

Decoding joins the bytes of the ids and never goes through text, so a sequence that ends inside a character gives those
bytes as they are.

Nulls: a null text counts as empty and has no ids; null ids give null bytes, as do ids that the rank file lacks. Rows
that share a doc_id, or have none, give a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common

IDS = "doc_id long, n_tokens long, ids binary"
_LOADED: dict[tuple[str, str], RankEncoder] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


class RankEncoder:
    def __init__(self, path: str, pattern: str, limit: int = 32_768):
        import regex
        import tiktoken

        ranks = load_ranks(path)
        self.tool = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.limit = regex.compile(pattern), limit
        self.known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.known[list(ranks.values())] = True

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that end at safe boundaries, as near below ``limit`` as these lie; longer where none does."""
        at = 0
        while len(text) - at > self.limit:
            cut = text.rfind(" ", at + 1, at + self.limit + 1)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.rfind(" ", at + 1, cut)
            if cut < 0:
                cut = text.find(" ", at + self.limit + 1)
                while cut > 0 and text[cut - 1].isspace():
                    cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= self.limit:
            return np.array(self.tool.encode_ordinary(text), "<u4")
        found = [np.zeros(0, "<u4")]
        for part in self.parts(text):
            if len(part) <= self.limit:
                found.append(np.array(self.tool.encode_ordinary(part), "<u4"))
            else:
                found += [np.array(self.tool._encode_single_piece(m.group()), "<u4") for m in self.pattern.finditer(part)]
        return np.concatenate(found)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes behind ids, or None where an id has none."""
        if ids.size and (int(ids.max()) >= self.known.size or not self.known[ids].all()):
            return None
        return b"".join(self.tool.decode_bytes(ids[a : a + 65_536].tolist()) for a in range(0, ids.size, 65_536))


def encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder for each worker process, rank file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankEncoder(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) for each row of ``docs(doc_id, text)``; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in common.sliced(batches, 200):
            ids = [tool.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.size for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return found.mapInArrow(encode, IDS)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and ``raw``, the bytes behind the ids, for each row of ``encoded(doc_id, n_tokens, ids)``; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in common.sliced(batches, 200):
            raw = [None if x is None else tool.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], schema=schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, f"{IDS}, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each row's ids and of the bytes decoded from them."""
    back = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
