"""Recordings: RIFF/WAVE files of 16 kHz in any folder that Spark and the executors share, read by ranges of frames.

``headers`` lists the files and reads the head of each in a task of its own kind; ``frames`` deals every recording as ranges of
some thousand frames, whose bytes (with the half frame that reaches over on both sides) are read by themselves. So a long
recording is many tasks, and none holds more of it than a range. Headers are read by executors, not where the plan is made,
for there may be millions of files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators.audio import FRAME, HOP, RATE, signal_features

RANGE_FRAMES = 8192
HEADER = "path string, kind int, channels int, rate int, bits int, data_at long, n_samples long, error string"
FEATURES = "path string, frame_idx int, t double, rms double, zcr double"
_SCHEMA = pa.schema([("path", pa.string()), ("frame_idx", pa.int32()), ("t", pa.float64()), ("rms", pa.float64()), ("zcr", pa.float64())])
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_OPEN_END = 0xFFFFFFFF


def _file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith(("s3a:", "s3n:")) else path)


def parse_header(file: Any, length: int) -> tuple:
    """kind, channels, rate, bits, data_at, n_samples of an open file; ValueError for what can't be read as 16 kHz samples."""
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    shape, wide = None, None
    at = 12
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"ds64":
            wide = struct.unpack("<Q", file.read(16)[8:])[0]
        elif name == b"fmt ":
            raw = file.read(min(size, 40))
            kind, channels, rate, _, block, bits = struct.unpack("<HHIIHH", raw[:16])
            if kind == _EXTENSIBLE:
                kind = struct.unpack("<H", raw[24:26])[0]
            if (kind, bits) not in ((_PCM, 8), (_PCM, 16), (_PCM, 24), (_PCM, 32), (_FLOAT, 32), (_FLOAT, 64)) or channels < 1 or block != channels * bits // 8:
                raise ValueError(f"samples of kind {kind} with {bits} bits in {channels} channels are not read")
            if rate != RATE:
                raise ValueError(f"{rate} samples a second, not {RATE}")
            shape = kind, channels, rate, bits
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            size = wide if size == _OPEN_END and wide is not None else size
            return *shape, at + 8, min(size, length - at - 8) // (shape[1] * shape[3] // 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def headers(files: DataFrame) -> DataFrame:
    """The header of each of files(path, length). A file that can't be read is a row with ``error``, and no sample."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *((n, pa.int32()) for n in ("kind", "channels", "rate", "bits")), ("data_at", pa.int64()), ("n_samples", pa.int64()), ("error", pa.string())])
        for b in batches:
            rows = []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                try:
                    store, name = _file_system(path)
                    with store.open_input_file(name) as file:
                        rows.append((path, *parse_header(file, length), None))
                except (ValueError, struct.error) as e:  # a store that fails is an error of the task, which runs again
                    rows.append((path, None, None, None, None, None, 0, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return files.select("path", "length").mapInArrow(read, HEADER)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length of the files that match, but those of no byte, which Spark leaves out; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def samples(raw: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """Mono samples from -1 to 1; channels are averaged."""
    if kind == _FLOAT:
        y = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        y = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / 2.0**23
    else:
        y = np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return y.reshape(-1, channels).mean(1)


def frames(heads: DataFrame, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """path, frame_idx, t, rms, zcr of every frame of the recordings of ``headers``; those in error or empty have none."""
    n = F.when(F.col("n_samples") > 0, F.floor(F.col("n_samples") / HOP) + 1).otherwise(0)
    ranges = heads.where("error IS NULL AND n_samples > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(range_frames).cast("long"))))
    ranges = ranges.withColumn("until", F.least(F.col("first") + range_frames, n))
    spread = ranges.repartition("path", "first").select("path", "kind", "channels", "bits", "data_at", "n_samples", "first", "until")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                width = r["channels"] * r["bits"] // 8
                lo = max(0, r["first"] * HOP - FRAME // 2)
                hi = min(r["n_samples"], (r["until"] - 1) * HOP + FRAME // 2)
                store, name = _file_system(r["path"])
                with store.open_input_file(name) as file:
                    raw = file.read_at((hi - lo) * width, r["data_at"] + lo * width)
                if len(raw) != (hi - lo) * width:
                    raise OSError(f"{r['path']} is shorter than when its header was read")
                y = samples(raw, r["kind"], r["channels"], r["bits"])
                for at, rms, zcr in signal_features(y, lo, r["n_samples"], r["first"], r["until"]):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(at)), pa.array(at, pa.int32()), pa.array(at * HOP / RATE), pa.array(rms), pa.array(zcr)], schema=_SCHEMA)

    return spread.mapInArrow(read, FEATURES)


def write_recordings(parts: DataFrame, folder: str) -> DataFrame:
    """Write parts(video_id long, part long, pcm binary: 16-bit mono) as one file a video, parts in order, and return video_id, path,
    length. A file is written as a stream by one task, which holds one part of it at a time; each attempt writes its own file,
    and only those of the rows that come back count."""
    schema = pa.schema([("video_id", pa.int64()), ("path", pa.string()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, out, path, size = None, None, "", 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pylist([{"video_id": video, "path": path, "length": size}], schema)

        for b in batches:
            for v, pcm in zip(b.column("video_id").to_pylist(), b.column("pcm").to_pylist(), strict=True):
                if out is None or v != video:
                    yield from close()
                    video, path = v, f"{folder}/{v}-{uuid.uuid4().hex}.wav"
                    store, name = _file_system(path)
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name)
                    size = out.write(b"RIFF" + struct.pack("<I", _OPEN_END) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, _PCM, 1, RATE, RATE * 2, 2, 16) + b"data" + struct.pack("<I", _OPEN_END))
                size += out.write(pcm or b"")
        yield from close()

    ordered = parts.select("video_id", "part", "pcm").repartition("video_id").sortWithinPartitions("video_id", "part")
    return ordered.mapInArrow(write, "video_id long, path string, length long")
