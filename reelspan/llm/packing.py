"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are encoded once, where they are read; each is cut at multiples of the capacity, and a rest of more than
half of that once more. The histogram of piece lengths has at most ``capacity`` entries, whatever the corpus. On the
driver, lengths are placed longest first, each into the shortest pack, the one filled least (shortest-pack-first),
or a new one where it doesn't fit there, for all packs of a pattern at once, and pattern counts are updated. Pieces then find their
place by their rank among those of their length: ranks are counted within (length, salt), so that a length that a
third of all pieces have is spread over many tasks.

Nulls: a null text is the empty text and gives one piece, the end id. Rows that share a doc_id are packed each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.byte_bpe import encoder

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``((length, repeats), ...)`` with their counts. A count of packs shares a pattern and is split only
    where fewer pieces than packs are left, so that at most one pattern is added for each placement."""
    room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # by what is left of a pack
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fit = max(room, default=0)
            if fit < length:
                packs, pattern, fit, each = left, (), capacity, 1
                if length * 2 <= capacity and left > 1:  # a new pack stays the shortest until it holds no more of this length
                    each = min(left, capacity // length)
                    packs = left // each
            else:
                pattern, count = next(iter(room[fit].items()))
                each, packs = 1, min(count, left)
                room[fit][pattern] -= packs
                if not room[fit][pattern]:
                    del room[fit][pattern]
                if not room[fit]:
                    del room[fit]
                if pattern[-1][0] == length:  # one more of the same length
                    pattern, each = pattern[:-1], pattern[-1][1] + 1
                    room[fit - length][(*pattern, (length, each))] += packs
                    left -= packs
                    continue
            room[fit - each * length][(*pattern, (length, each))] += packs
            left -= packs * each
    return [(p, c) for _, found in sorted(room.items()) for p, c in found.items()]


def placement(patterns: list[tuple[tuple[tuple[int, int], ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of (length, rank): rank - first runs over the packs of a pattern, then over the repeats."""
    rows, seen, sequence = [], defaultdict(int), 0
    for pattern, packs in patterns:
        total = sum(length * n for length, n in pattern)
        padded, at = total if total & (total - 1) == 0 else capacity, 0
        for length, n in pattern:
            rows.append((length, seen[length], sequence, packs, at, total, padded))
            seen[length] += n * packs
            at += length * n
        sequence += packs
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 7)
    return dict(zip(("length", "first", "sequence", "packs", "offset", "total", "padded"), table.T, strict=True))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Whole sequences first; a rest of more than half a sequence is cut at the half, since pieces of at most half a
    sequence leave hardly any room unused."""
    edges = list(range(0, n + 1, capacity))
    if n - edges[-1] > capacity // 2 > 0:
        edges.append(edges[-1] + capacity // 2)
    if edges[-1] < n:
        edges.append(n)
    return list(zip(edges[:-1], edges[1:], strict=True))


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary_path)

        def rows() -> Iterator[tuple]:
            for batch in common.sliced(batches):
                ids = batch.column("doc_id").to_pylist()
                for doc, raw in zip(ids, tool.ids(batch.column("text").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for a, b in cuts(n, capacity):
                        yield doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n

        yield from common.in_slices(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text)`` with its sequence and offset there, and the length that its
    sequence is padded to: the capacity, or its own where that is a power of two."""
    spark = docs.sparkSession
    salts = max(32, common.partitions(spark))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    cut = common.staged(pieces(docs, vocabulary_path, end_id, capacity).withColumn("salt", salt), "pack-pieces")
    groups = common.staged(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-groups")
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = placement(shortest_pack_first(histogram, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("ahead"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("local", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("local") + F.col("ahead")).cast("long").alias("rank"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (place["length"] << np.int64(44)) + place["first"]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in common.sliced(batches):
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(key, (length << np.int64(44)) + rank, "right") - 1
            k = rank - place["first"][at]
            sequence = place["sequence"][at] + k % place["packs"][at]
            offset = place["offset"][at] + k // place["packs"][at] * length
            more = [sequence, offset, place["total"][at], place["padded"][at]]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *map(pa.array, more)], names=[*names, "sequence_id", "offset", "sequence_tokens", "padded_to"])

    return ranked.mapInArrow(put, shape)
