"""Token-ID files: every id in the fewest bits that hold the vocabulary, with block offsets.

A file is ``magic | packed blocks | footer | footer length | magic``. A block holds ``block_ids`` ids (the last may
hold fewer), each in ``bits`` bits, least significant bit first, and begins at a byte. The footer holds the block
offsets, the documents' ids and their first positions, so that any range of ids is read by one seek and unpacked
by numpy.

Nulls: a null text is the empty text; a null doc_id sorts first. Ties: rows that share a doc_id stay separate rows,
ordered by text. An empty table gives no file and no rows. Other columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.byte_bpe import encoder

MAGIC = b"RSTOKEN1"
MANIFEST = "part int, path string, first_start long, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The inverse of ``pack``: ``n`` ids as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint64)
    for k in range(bits):
        out |= planes[:, k].astype(np.uint64) << np.uint64(k)
    return out.astype("<u4")


class Writer:
    """Writes one file; holds a block and the footer, never the ids of a whole file."""

    def __init__(self, out, vocabulary: int, block_ids: int = 65536):
        self.out, self.bits, self.block_ids = out, bits_for(vocabulary), block_ids
        self.vocabulary, self.held, self.n_held = vocabulary, [], 0
        self.docs, self.nulls, self.starts, self.offsets = [], [], [], []
        self.n_tokens, self.at = 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_tokens)
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for i in range(0, whole, self.block_ids):
            raw = pack(ids[i : min(i + self.block_ids, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.held, self.n_held = ([ids[whole:]] if whole < len(ids) else []), len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        head = json.dumps({"vocabulary": self.vocabulary, "bits": self.bits, "block_ids": self.block_ids, "n_tokens": self.n_tokens, "n_docs": len(self.docs), "n_blocks": len(self.offsets)}).encode()
        parts = [np.array(self.offsets, "<u8").tobytes(), np.array(self.docs, "<i8").tobytes(), np.array(self.nulls, "u1").tobytes(), np.array(self.starts, "<u8").tobytes()]
        footer = struct.pack("<I", len(head)) + head + b"".join(parts)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to one file by its block offsets."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or one that was cut short")
        (length,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 16 - length)
        raw = source.read(length)
        (n,) = struct.unpack("<I", raw[:4])
        self.head, at = json.loads(raw[4 : 4 + n]), 4 + n
        sizes = [("<u8", self.head["n_blocks"]), ("<i8", self.head["n_docs"]), ("u1", self.head["n_docs"]), ("<u8", self.head["n_docs"])]
        arrays = []
        for kind, count in sizes:
            arrays.append(np.frombuffer(raw, kind, count, at))
            at += np.dtype(kind).itemsize * count
        self.offsets, self.docs, self.nulls, self.starts = arrays
        self.held = (-1, np.zeros(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            n = min(self.head["block_ids"], self.head["n_tokens"] - k * self.head["block_ids"])
            self.source.seek(int(self.offsets[k]))
            self.held = (k, unpack(self.source.read((n * self.head["bits"] + 7) // 8), n, self.head["bits"]))
        return self.held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        size, parts = self.head["block_ids"], []
        for k in range(start // size, (max(stop, start + 1) - 1) // size + 1):
            parts.append(self._block(k)[max(0, start - k * size) : max(0, stop - k * size)])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        ends = np.append(self.starts[1:], np.uint64(self.head["n_tokens"]))
        for doc, null, a, b in zip(self.docs.tolist(), self.nulls.tolist(), self.starts.tolist(), ends.tolist(), strict=True):
            yield None if null else doc, a, self.ids(a, b)


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int, roll_tokens: int = 1 << 27) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order to files below ``folder``; returns the manifest, a row
    for each file. A range partition gives each task a run of ids; a task that is run again writes other files, and
    only those that the manifest names count."""
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    ordered = ordered.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tool, done, writer, out, name = TaskContext.get().partitionId(), encoder(vocabulary_path), [], None, None, ""
        fs, base = common.store(folder)
        end, vocabulary = np.array([end_id], "<u4"), max(encoder(vocabulary_path).tokenizer.get_vocab_size(), end_id + 1)

        def shut():
            writer.close()
            out.close()
            done.append((part, name, len(done), len(writer.docs), writer.n_tokens, fs.get_file_info(name).size))

        for batch in common.sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for doc, raw in zip(ids, tool.ids(texts), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(name)
                    writer = Writer(out, vocabulary)
                writer.add(doc, np.concatenate([np.frombuffer(raw, "<u4"), end]))
                if writer.n_tokens >= roll_tokens:
                    shut()
                    writer = None
        if writer is not None:
            shut()
        yield common.rows_batch(done, schema)

    return common.staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document from the files: where its ids begin among all ids, how many, and their crc32.

    The manifest has a row for each file of up to 2**27 ids, so its running sum is made on the driver."""
    spark = manifest.sparkSession
    files, at = [], 0
    for r in manifest.select("part", "path", "first_start", "n_tokens").orderBy("part", "first_start").collect():
        files.append((r["path"], at))
        at += r["n_tokens"]
    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, min(len(files), 10_000)))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.store(folder)
        for batch in common.sliced(batches):
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    found = Reader(source, source.size()).documents()
                    yield from common.in_slices(((doc, base + a, len(ids), zlib.crc32(ids.tobytes())) for doc, a, ids in found), schema)

    return listed.mapInArrow(read, ROWS)


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` and read the files back."""
    folder = common.shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary_path, end_id), folder)


def round_trip(ids_by_doc: list[tuple[int | None, list[int]]], vocabulary: int, block_ids: int = 7) -> list[tuple[int | None, list[int]]]:
    """Write and read one file in memory."""
    out = io.BytesIO()
    writer = Writer(out, vocabulary, block_ids)
    for doc, ids in ids_by_doc:
        writer.add(doc, np.array(ids, "<u4"))
    writer.close()
    return [(doc, ids.tolist()) for doc, _, ids in Reader(out, out.tell()).documents()]
