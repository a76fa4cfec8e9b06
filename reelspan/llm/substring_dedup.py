"""Removal of bytes covered by long strings that also start in a document with a smaller id.

Every document is a byte string. A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id; strings are judged on the input, and matches never cross documents.

The plan is one exchange of the texts, into blocks by a hash of the row, and four of short messages:

1. Each block cuts its texts into runs of neighbouring windows (strings of ``length`` bytes) that share their
   minimiser, the least ``seed``-gram. Equal windows have equal minimisers, so only runs of one minimiser can match. The
   block sends (minimiser, run, smallest doc_id), each distinct run once, to the minimiser's bucket. Runs beside a passage that
   many documents share have one minimiser, so the run's hash goes whole (64 bits); 40 bits of the minimiser do.
2. A bucket answers, for each run, whether an equal run is in a smaller document (then all its windows go), and
   whether this block holds the run's first document while the minimiser has other runs, too.
3. Only for runs of the latter kind the block compares window by window: it sorts these windows' suffixes
   by deep-shallow sorting, finds the runs of equal ones and their smallest doc_id, and sends each distinct window once
   to its bucket, which answers whether a smaller document has it. Between blocks windows are told apart by 80 bits: 64 of
   their own and 16 of their minimiser.
4. The block marks what goes and measures what is left.

A block sends a string at most once however often it occurs, so a passage of a third of all documents is a row for
each block, not one for each document. Messages are packed arrays. The bytes of a block and of a bucket are bounded, so
their numbers follow the input; a text of more than a block's bytes is a block of its own and is read in tiles.

Nulls: a null text is the empty text; a null doc_id is after all others. Rows that share a doc_id never remove
from one another. An empty table gives no rows. Other columns are ignored, unless named to be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.rolling import hashes, mix, running, widths
from reelspan.llm.suffix_sort import sort_suffixes, symbols

SEED = 20
LAST = (1 << 63) - 1
BUCKET_BYTES = 1 << 25
MESSAGE = "bucket int, block int, kind int, body binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte, which the shuffle's compression can shorten."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


class Texts:
    """The texts of a block end to end, and its runs of windows that share a minimiser."""

    def __init__(self, ids: list[int | None], texts: list[bytes], length: int, tile: int = 1 << 18):
        keep = sorted(range(len(ids)), key=lambda k: LAST if ids[k] is None else ids[k])
        self.rows = keep
        self.doc = np.array([LAST if ids[k] is None else ids[k] for k in keep], np.int64)
        sizes = np.array([len(texts[k]) for k in keep], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = np.frombuffer(b"".join(texts[k] for k in keep), np.uint8)
        self.length = length
        #: Bits for a gram's place in a tile; the same for all tiles, so that equal windows everywhere have one minimiser.
        self.low = np.uint64((1 << (tile + length).bit_length()) - 1)
        begin, stop, seed, run = [], [], [], []
        done = 0
        while done < len(self.raw):
            found = self._tile(done, min(len(self.raw), done + tile))
            for to, x in zip((begin, stop, seed, run), found, strict=True):
                to.append(x)
            done += tile
        empty = np.zeros(0, np.int64)
        self.begin, self.stop = (np.concatenate(x) if x else empty for x in (begin, stop))  # windows [begin, stop)
        self.seed, self.run = (np.concatenate(x) if x else empty.astype(np.uint64) for x in (seed, run))
        self.of = np.searchsorted(self.ends, self.begin, "right")

    def _tile(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Runs of the windows that begin in [a, b)."""
        length, width = self.length, self.length - SEED + 1
        raw = self.raw[a : min(len(self.raw), b + length)]
        windows = min(b - a, len(raw) - length + 1)
        if windows <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        total = running(raw)
        seeds = widths(total, SEED)
        # A gram's hash with its place in the lowest bits, so the least of a window tells its leftmost least gram.
        least = (seeds & ~self.low) | np.arange(len(seeds), dtype=np.uint64)
        span = 1
        while span < width:  # by doubling
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        new = np.empty(windows, bool)
        new[0] = True
        new[1:] = least[1:windows] != least[: windows - 1]
        # A run also ends where its document does, and before the windows that cross the document's end.
        i, j = np.searchsorted(self.ends, [a, a + windows], "right")
        for edge in (self.starts[i : j + 1], np.maximum(self.starts[i : j + 1], self.ends[i : j + 1] - length + 1)):
            new[edge[(edge >= a) & (edge < a + windows)] - a] = True
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], windows)
        good = begin + a + length <= self.ends[np.searchsorted(self.ends, begin + a, "right")]
        begin, stop = begin[good], stop[good]
        seed = seeds[(least[begin] & self.low).astype(np.int64)]
        # The seed's place counts too: runs are equal if their windows are.
        run = mix(hashes(total, begin, stop + length - 1) ^ (stop - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return begin + a, stop + a, seed, run

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First run of each distinct (seed, run) by bucket order; for each run the number of its distinct one; the
        smallest doc_id and the distinct seeds. Texts stand in the order of their ids, so the first is the smallest."""
        s, r = self.seed >> np.uint64(24), self.run
        # 40 bits of the seed and 24 of the run order almost all; where runs agree in these, the whole numbers do.
        key = (s << np.uint64(24)) | (r >> np.uint64(40))
        order = np.argsort(key)
        key, new = key[order], np.ones(len(s), bool)
        new[1:] = key[1:] != key[:-1]
        if (~new[1:] & (r[order[1:]] != r[order[:-1]])).any():
            order = np.lexsort((r, s))
            new[1:] = (s[order[1:]] != s[order[:-1]]) | (r[order[1:]] != r[order[:-1]])
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(s) else order
        return first, number, self.doc[self.of[first]], s[first]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all windows of the runs ``chosen``, and the run of each."""
        n = self.stop[chosen] - self.begin[chosen]
        base = np.repeat(self.begin[chosen] - (np.cumsum(n) - n), n)
        return base + np.arange(int(n.sum())), np.repeat(chosen, n)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries by bucket, in order within one, and where each bucket's entries begin; entry k's bucket is keys[k] % buckets."""
    to = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    edges = np.append(0, np.cumsum(np.bincount(to, minlength=buckets)))
    return np.argsort(to, kind="stable"), edges


def _send(block: int, kind: int, keys: np.ndarray, parts: list[tuple[np.ndarray, int]], buckets: int) -> Iterator[tuple]:
    """Rows for the buckets; entry k goes to bucket keys[k] % buckets, in order."""
    order, edges = _by_bucket(keys, buckets)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        yield b, block, kind, np.int64(len(own)).tobytes() + b"".join(planes(x[own].astype(np.uint64), w) for x, w in parts)


def _bits(replies: list[tuple[int, bytes]], keys: np.ndarray, buckets: int, columns: int) -> np.ndarray:
    """The buckets' answers in the order of the entries that were sent."""
    out = np.zeros((len(keys), columns), bool)
    order, edges = _by_bucket(keys, buckets)
    for b, raw in replies:
        own = order[edges[b] : edges[b + 1]]
        out[own] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(own) * columns).reshape(-1, columns)
    return out


def _gathered(table: pa.Table, widths: list[int]) -> tuple[list[tuple[int, int, int]], list[np.ndarray]]:
    """(block, from, to) of each message to a bucket, and the arrays of all."""
    spans, held, at = [], [[] for _ in widths], 0
    for block, raw in zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True):
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        where = 8
        for to, w in zip(held, widths, strict=True):
            to.append(unplanes(raw, n, w, where))
            where += n * w
        spans.append((block, at, at + n))
        at += n
    return spans, [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held]


def _replies(bucket: int, kind: int, spans: list[tuple[int, int, int]], bits: np.ndarray) -> pa.Table:
    rows = [(bucket, block, kind, np.packbits(bits[a:b].ravel()).tobytes()) for block, a, b in spans]
    return pa.Table.from_batches([common.rows_batch(rows, _MESSAGE)])


def _least(order_keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys, ordered by the last key first: the number of each entry's group, and an entry and the
    smallest doc of each group."""
    order = np.lexsort((doc, *order_keys))
    new = np.zeros(len(doc), bool)
    if len(doc):
        new[0] = True
    for k in order_keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum(new) - 1
    head = order[new]
    return number, head, doc[head]


def _answer_runs(table: pa.Table) -> pa.Table:
    """Two bits for each run: an equal run is in a smaller document; this block has the run's first document and the
    seed has runs of another first document."""
    spans, (seed, run, doc) = _gathered(table, [5, 8, 8])
    doc = doc.astype(np.int64)
    number, head, least = _least((run, seed), doc)
    smaller = least[number] < doc
    # Runs of one seed are neighbours.
    of = seed[head]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    differ = np.minimum.reduceat(least, first) < np.maximum.reduceat(least, first) if len(of) else np.zeros(0, bool)
    several = np.repeat(differ, np.diff(np.append(first, len(of))))[number]
    return _replies(table.column("bucket")[0].as_py(), 0, spans, np.stack([smaller, several & ~smaller], 1))


def _answer_windows(table: pa.Table) -> pa.Table:
    """A bit for each window: a smaller document has it."""
    spans, (window, seed, doc) = _gathered(table, [8, 2, 8])
    doc = doc.astype(np.int64)
    number, _, least = _least((seed, window), doc)
    return _replies(table.column("bucket")[0].as_py(), 1, spans, (least[number] < doc)[:, None])


class _Marks:
    """What a block knows after each answer."""

    def __init__(self, texts: Texts, replies: list[tuple[int, int, bytes]], buckets: int):
        self.t, self.buckets = texts, buckets
        first, number, least, seeds = texts.distinct()
        bits = _bits([(b, raw) for b, kind, raw in replies if kind == 0], seeds, buckets, 2)
        own = texts.doc[texts.of]
        #: Runs that an equal run in a smaller document removes whole.
        self.gone = bits[number, 0] | (own > least[number]) if len(number) else np.zeros(0, bool)
        #: Of the others those to compare window by window, each distinct run once for its document.
        self.edges = np.flatnonzero(~self.gone & bits[number, 1]) if len(number) else np.zeros(0, np.int64)

    def sorted_windows(self) -> tuple[np.ndarray, ...]:
        """Distinct windows of the edges by deep-shallow sorting: position, run and group of every window, and
        hash and smallest doc_id of every group."""
        t = self.t
        at, run = t.windows(self.edges)
        words = symbols(t.raw, t.length + 16)
        order, group = sort_suffixes(words, at, t.length)
        placed, run = at[order], run[order]
        new = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        doc = t.doc[t.of[run]]
        least = np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc
        total = running(t.raw)
        heads = placed[new]
        return placed, run, number, hashes(total, heads, heads + t.length), t.seed[run[new]] >> np.uint64(48), least


def removed_spans(texts: Texts, replies: list[tuple[int, int, bytes]], buckets: int) -> np.ndarray:
    """A flag for each byte of the block: whether it goes."""
    marks = _Marks(texts, replies, buckets)
    edge = np.zeros(len(texts.raw) + 1, np.int32)
    gone = marks.gone
    np.add.at(edge, texts.begin[gone], 1)
    np.add.at(edge, texts.stop[gone] + texts.length - 1, -1)
    if len(marks.edges):
        at, run, number, window, _, least = marks.sorted_windows()
        smaller = _bits([(b, raw) for b, kind, raw in replies if kind == 1], window, buckets, 1)[:, 0]
        out = smaller[number] | (least[number] < texts.doc[texts.of[run]])
        np.add.at(edge, at[out], 1)
        np.add.at(edge, at[out] + texts.length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, length: int = 50, block_bytes: int = 1 << 22, texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``,
    kept_text (the bytes that are left as text, without what is left of characters cut through) and the columns ``keep``
    as a struct ``row``."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes), 4 * common.partitions(spark) if size > block_bytes else 1)
    # A bucket's messages are about as many bytes as the texts that they come from.
    buckets = max(min(4 * common.partitions(spark), -(-size // (1 << 20))), -(-size // BUCKET_BYTES), 1)
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(blocks)).cast("int")
    own = docs.select(key.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().cast("binary").alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    base = own.drop("row")

    def load(table: pa.Table) -> Texts:
        return Texts(table.column("doc_id").to_pylist(), [x or b"" for x in table.column("text").to_pylist()], length)

    def told(table: pa.Table) -> list[tuple[int, int, bytes]]:
        return list(zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "body")), strict=True))

    def runs(table: pa.Table) -> pa.Table:
        t, block = load(table), table.column("block")[0].as_py()
        first, _, least, seeds = t.distinct()
        rows = list(_send(block, 0, seeds, [(seeds, 5), (t.run[first], 8), (least, 8)], buckets))
        return pa.Table.from_batches([common.rows_batch(rows, _MESSAGE)])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            marks = _Marks(load(left), told(right), buckets)
            if len(marks.edges):
                *_, window, seed, least = marks.sorted_windows()
                rows = list(_send(left.column("block")[0].as_py(), 1, window, [(window, 8), (seed, 2), (least, 8)], buckets))
        return pa.Table.from_batches([common.rows_batch(rows, _MESSAGE)])

    shape = own.drop("block", "text").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    shape = shape.add("kept_text", "string") if texts else shape

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", *(["row"] if keep else [])]
        more: list[tuple] = [()] * left.num_rows
        if left.num_rows:
            t = load(left)
            gone = removed_spans(t, told(right), buckets)
            for k, row in enumerate(t.rows):
                a, b = int(t.starts[k]), int(t.ends[k])
                g = gone[a:b]
                left_over = t.raw[a:b][~g].tobytes()
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0
                more[row] = (b - a, int(g.sum()), spans, hashlib.sha256(left_over).hexdigest(), *([left_over.decode(errors="ignore")] if texts else []))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if texts else []))
        columns = list(zip(*more, strict=True)) if more else [[] for _ in kinds]
        arrays = [left.column(n) for n in names] + [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])])

    first = base.groupBy("block").applyInArrow(runs, MESSAGE).groupBy("bucket").applyInArrow(_answer_runs, MESSAGE)
    first = common.staged(first, "dedup-runs")
    second = base.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(windows, MESSAGE).groupBy("bucket").applyInArrow(_answer_windows, MESSAGE)
    replies = first.unionByName(second)
    return own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, shape)


def keep_first(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` without the bytes that ``dedup`` removes, n_chars set anew where it is a column; rows that removal
    leaves blank go."""
    names = docs.columns
    # The text comes back as what is left of it; only whether it was null travels beside it.
    flagged = docs.withColumn("_null_text", F.col("text").isNull())
    found = dedup(flagged, length, texts=True, keep=[n for n in flagged.columns if n != "text"]).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.when(~F.col("row._null_text"), F.col("kept_text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(n, F.col(f"row.`{n}`")).alias(n) for n in names])
