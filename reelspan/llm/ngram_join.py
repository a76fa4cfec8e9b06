"""Exact Jaccard self-join of documents on word shingles, with its connected components.

Sets of equal content are one class, whose smallest id stands for it. What follows works on classes:

1. Candidates. A fixed-size sketch of the whole corpus orders shingles, rare ones first. Of a set of n shingles with
   k = ceil(t * n) the first n - k + L are its prefix, L = k / 16. Two sets that reach the threshold have L of them
   in common, so each may drop the L - 1 that most other prefixes hold: passages that many documents share open no
   list. Index lists of the rest with one entry are dropped, too, and with them most documents.
2. Groups. Each class follows the smallest class that shares most of its lists; those that end at the same one are a group.
   A group is cut into chunks of bounded bytes, and the class with most shared shingles, its pivot, is added to each.
3. In a chunk (``SetIndex``) set relations spare the work: index lists are cut into blocks by size, and blocks whose sizes
   or positions rule out the need are skipped; a set's overlaps are derived from those of a similar set by the lists of
   the shingles that only one of both has. Only pairs of different components are looked at.
4. Lists that still span several components name the pairs of units (a chunk's sets that the pivot reaches, or up to
   a chunk of those that it doesn't) that may still hold a link. These are compared the same way. Pairs of one component or of one
   chunk are never formed, and of a unit pair only links that join components are returned.

A hot group of M near copies costs M rows in step 3. In step 4 it costs M rows for each chunk of sets that its pivot doesn't reach.

Nulls: a null or blank text has no shingles and links with nothing; a row with a null doc_id gives component null.
Rows that share a doc_id are one document, linked through each of its texts. An empty table gives no rows. Other
columns are ignored. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.components import components
from reelspan.llm.rolling import hashes, running

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The sketch and the filter of wanted documents have a fixed size, whatever the corpus.
SKETCH_BITS, SLICES, FILTER_BITS, PROBES = 18, 64, 26, 3
#: Sets and shingles of a chunk at most, a single larger set aside.
CHUNK_SETS, CHUNK_SHINGLES = 600, 1_500_000


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words (all words where there are fewer), A-Z lower-cased."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    total = running(joined)
    gaps = np.flatnonzero(joined == 32)
    begins, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    k = min(size, len(words))
    return np.unique(hashes(total, begins[: len(words) - k + 1], ends[k - 1 :]))


def set_key(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()


def prefix_length(n: int, threshold: Fraction) -> int:
    return n - math.ceil(threshold * n) + 1 if n else 0


def long_prefix(n: int, threshold: Fraction) -> int:
    """The prefix of which linked sets share L. L depends on ceil(t * n) alone and grows slower than it, so that the
    partner, whatever its size, has as many of the common ones in its own prefix."""
    k = math.ceil(threshold * n)
    return n - k + max(1, k // 16) if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall in each of 2**SKETCH_BITS buckets; the sketch has that size for any corpus.
    Tasks send slices of their counts, which are summed slice by slice as they stream in."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in common.sliced(batches):
            found = [shingles(raw, size) for raw in common.utf8(b, "text")]
            if found:
                total += np.bincount(_bucket(np.concatenate(found)), minlength=len(total))
        if total.any():
            yield common.rows_batch([(k, total[k * width : (k + 1) * width].astype("<u4").tobytes()) for k in range(SLICES)], schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        yield common.rows_batch([(k, np.minimum(v, 2**32 - 1).astype("<u4").tobytes()) for k, v in sums.items()], schema)

    parts = _texts(docs).select("text").mapInArrow(count, "slice int, counts binary").repartition(common.partitions(docs.sparkSession), "slice")
    out = np.zeros((SLICES, width), np.uint32)
    for r in parts.mapInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def document_sets(docs: DataFrame, size: int, threshold: Fraction, sketch: Broadcast) -> DataFrame:
    """doc_id, k1, k2 (the set's key), n, prefix (its rarest shingles) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value

        def rows() -> Iterator[tuple]:
            for b in common.sliced(batches):
                for doc, raw in zip(b.column("doc_id").to_pylist(), common.utf8(b, "text"), strict=True):
                    s = shingles(raw, size)
                    order = np.lexsort((s, often[_bucket(s)]))
                    yield doc, *set_key(s), len(s), s[order[: long_prefix(len(s), threshold)]].view(np.int64)

        yield from common.in_slices(rows(), schema, 1024)

    return _texts(docs).mapInArrow(make, "doc_id long, k1 long, k2 long, n int, prefix array<long>")


def candidate_lists(sets: DataFrame, t: Fraction) -> DataFrame:
    """token, rep, n, head of every index list with two classes or more; head is the smallest class of the list."""
    reps = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("r")).select("r.doc_id", "r.n", "r.prefix")
    posts = reps.select(F.col("doc_id").alias("rep"), "n", F.explode("prefix").alias("token"))
    # Counts by token are partial sums, met by the postings: no task holds the postings of a frequent shingle.
    often = common.staged(posts.groupBy("token").agg(F.count("*").alias("copies")).where("copies > 1"), "join-often")
    shared = common.meet(posts, often.withColumn("c", F.col("copies")), ["token"], _total(often))
    k = F.expr(f"cast((cast(n as bigint) * {t.numerator} + {t.denominator - 1}) div {t.denominator} as int)")
    # Shingles that one prefix alone holds come first; they are not sent, but they count.
    alone = F.col("n") - k + F.greatest(F.lit(1), (k / 16).cast("int")) - F.size("held")
    kept = shared.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("held"))
    kept = kept.select("rep", "n", F.explode(F.slice("held", 1, F.greatest(F.lit(0), F.col("n") - k + 1 - alone))).alias("x")).select("rep", "n", F.col("x.token").alias("token"))
    kept = common.staged(kept, "join-kept")
    heads = common.staged(kept.groupBy("token").agg(F.count("*").alias("copies"), F.min("rep").alias("head")).where("copies > 1"), "join-heads")
    found = common.staged(common.meet(kept, heads, ["token"], _total(heads)).select("token", "rep", "n", "head"), "join-lists")
    common.discard(often, kept, heads)
    return found


def _total(facts: DataFrame) -> int:
    return facts.agg(F.sum("copies")).first()[0] or 0


def groups(lists: DataFrame) -> DataFrame:
    """rep, n, leader, pivot, salt of every class in a list: the chunk (leader, salt) that it belongs to, and the chunk's pivot."""
    votes = lists.groupBy("rep", "n", "head").agg(F.count("*").alias("c"))
    near = votes.groupBy("rep", "n").agg(F.max_by("head", F.struct("c", -F.col("head"))).alias("leader"), F.sum("c").alias("degree"))
    near = common.staged(near, "join-leaders")
    total = near.count()
    for _ in range(2):  # a leader never is larger than its class, so this ends at one that leads itself
        up = near.groupBy("leader").agg(F.count("*").alias("copies")).join(near.select(F.col("rep").alias("leader"), F.col("leader").alias("up")), "leader")
        after = common.staged(common.meet(near, up, ["leader"], total).select("rep", "n", F.col("up").alias("leader"), "degree"), "join-groups")
        common.discard(near)
        near = after
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")
    whole = near.groupBy("leader").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot"), chunks, F.count("*").alias("copies"))
    return common.meet(near, whole, ["leader"], total).select("rep", "n", "leader", "pivot", F.pmod(F.xxhash64("rep"), "chunks").alias("salt"))


def _probes(column: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(1 << FILTER_BITS)) for k in range(PROBES)]


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of wanted(rep), of a fixed size for any number of them: 8 MB, sent to the driver in slices."""
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
    width = (1 << FILTER_BITS) // SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("at").to_numpy()
            for k in np.unique(at // width).tolist():
                held.setdefault(k, np.zeros(width, bool))[at[at // width == k] % width] = True
        yield common.rows_batch([(k, np.packbits(v).tobytes()) for k, v in held.items()], schema)

    at = wanted.select(F.explode(F.array(*_probes("rep"))).alias("at")).distinct()
    parts = at.repartition(common.partitions(wanted.sparkSession), F.floor(F.col("at") / width)).mapInArrow(build, "slice int, bits binary")
    out = np.zeros((SLICES, width // 8), np.uint8)
    for r in parts.collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def whole_sets(docs: DataFrame, placed: DataFrame, size: int, wanted: Broadcast) -> DataFrame:
    """placed(rep, k1, k2, ...) with shingles (binary). Texts are not moved: the filter picks them where they are read,
    and only the sets of those that it lets through meet ``placed``."""
    schema = pa.schema([("rep", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.binary())])
    names = [f"p{k}" for k in range(PROBES)]
    texts = _texts(docs).select("doc_id", "text", *[c.alias(n) for c, n in zip(_probes("doc_id"), names, strict=True)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value

        def rows() -> Iterator[tuple]:
            for b in common.sliced(batches):
                at = [b.column(n).to_numpy() for n in names]
                hit = np.logical_and.reduce([(bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 for a in at]).astype(bool)
                b = b.filter(pa.array(hit))
                for doc, raw in zip(b.column("doc_id").to_pylist(), common.utf8(b, "text"), strict=True):
                    s = shingles(raw, size)
                    yield doc, *set_key(s), s.tobytes()

        yield from common.in_slices(rows(), schema, 512)

    made = texts.mapInArrow(make, "rep long, k1 long, k2 long, shingles binary")
    return made.join(placed, ["rep", "k1", "k2"])


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [begin, begin + count), end to end."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class SetIndex:
    """Index lists over the sets of a chunk, in ascending order of their sizes.

    Shingles that one set alone holds are in no list. The others are numbered from the rarest to the most frequent,
    so a set's numbers in ascending order are its index order, after those that it alone holds. A list of
    the prefix index is cut into blocks by size class; a block knows its sizes and how many shingles can follow at most."""

    def __init__(self, sets: list[np.ndarray], t: Fraction):
        self.num, self.den = t.numerator, t.denominator
        self.n = np.array([len(s) for s in sets], np.int64)
        value, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(value), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(value))
        lone = int((often == 1).sum())
        owner = np.repeat(np.arange(len(sets)), self.n)
        held = often[ids] > 1
        owner, ids = owner[held], rank[ids[held]] - lone
        order = np.lexsort((ids, owner))
        self.owner, self.ids = owner[order], ids[order]
        total = len(value) - lone
        self.start = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        pos = np.arange(len(self.ids)) - self.start[self.owner] + (self.n - np.diff(self.start))[self.owner]
        order = np.lexsort((self.owner, self.ids))
        self.members = self.owner[order]
        self.list_start = np.searchsorted(self.ids[order], np.arange(total + 1))
        # The prefix index.
        first = pos <= (self.n - -(-self.n * self.num // self.den))[self.owner]
        self.pre_ids, self.pre_pos, own = self.ids[first], pos[first], self.owner[first]
        self.pre_start = np.searchsorted(own, np.arange(len(sets) + 1))
        order = np.lexsort((own, self.pre_ids))
        self.entries, ids, rest = own[order], self.pre_ids[order], (self.n[own] - self.pre_pos)[order]
        step = math.log(self.den / self.num) / 2 if self.num < self.den else 1.0
        kind = np.floor(np.log(self.n[self.entries]) / step).astype(np.int64)
        new = np.append(True, (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1])) if len(ids) else np.zeros(0, bool)
        self.block = np.flatnonzero(new)
        self.block_len = np.diff(np.append(self.block, len(ids)))
        self.low, self.high = self.n[self.entries[self.block]], self.n[self.entries[self.block + self.block_len - 1]]
        self.rest = np.maximum.reduceat(rest, self.block) if len(ids) else rest
        self.list_block = np.searchsorted(ids[self.block], np.arange(total + 1))
        self.known: list[tuple[int, np.ndarray]] = []

    def candidates(self, k: int) -> np.ndarray:
        """Sets that can reach the threshold with set k by the blocks of its prefix. With the first common shingle at i and j
        at most min(n - i, m - j) are common."""
        ids, i = (x[self.pre_start[k] : self.pre_start[k + 1]] for x in (self.pre_ids, self.pre_pos))
        count = self.list_block[ids + 1] - self.list_block[ids]
        at, i, n = _spread(self.list_block[ids], count), np.repeat(i, count), self.n[k]
        low, high = self.low[at], self.high[at]
        fits = (n * self.den >= low * self.num) & (high * self.den >= n * self.num)
        fits &= np.minimum(n - i, self.rest[at]) * (self.num + self.den) >= self.num * (n + low)
        at = at[fits]
        return np.unique(self.entries[_spread(self.block[at], self.block_len[at])])

    def _count(self, ids: np.ndarray) -> np.ndarray:
        begin = self.list_start[ids]
        return np.bincount(self.members[_spread(begin, self.list_start[ids + 1] - begin)], minlength=len(self.n))

    def overlaps(self, k: int) -> np.ndarray:
        """How many listed shingles every set shares with set k: from those of the most similar set that has been answered by the
        lists of what they don't share, or from all lists of set k where no such set is near."""
        own = self.ids[self.start[k] : self.start[k + 1]]
        like = max(self.known, key=lambda x: int(x[1][k]), default=None)
        if like is not None:
            j, found = like
            other = self.ids[self.start[j] : self.start[j + 1]]
            if len(own) + len(other) - 2 * int(found[k]) < len(own):
                return found + self._count(np.setdiff1d(own, other, True)) - self._count(np.setdiff1d(other, own, True))
        found = self._count(own)
        self.known = [*self.known[-7:], (k, found)]
        return found

    def links(self, k: int, others: np.ndarray) -> np.ndarray:
        both = self.overlaps(k)[others]
        return others[both * (self.num + self.den) >= self.num * (self.n[k] + self.n[others])]


def joining_links(sets: list[np.ndarray], label: np.ndarray, place: np.ndarray, t: Fraction, first: int = 0) -> list[tuple[int, int]]:
    """Links between sets of different ``place`` that together join all components of equal ``label`` that links join."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    index, label, place = SetIndex([sets[k] for k in order], t), np.unique(label[order], return_inverse=True)[1], place[order]
    found: list[tuple[int, int]] = []
    first = int(np.flatnonzero(order == first)[0])
    for k in [first, *(x for x in range(len(sets)) if x != first)]:
        others = index.candidates(k)
        others = others[(label[others] != label[k]) & (place[others] != place[k])]
        for x in index.links(k, others).tolist() if len(others) else []:
            if label[x] != label[k]:
                found.append((int(order[k]), int(order[x])))
                label[label == label[x]] = label[k]
    return found


def _labels(table: pa.Table, t: Fraction) -> pa.Table:
    """rep, leader, salt, pivot, label of a chunk's own rows; the label is the pivot where links lead to it, else the smallest
    class that they lead to. Rows with ``extra`` are the pivot of another chunk."""
    reps, at = np.unique(table.column("rep").to_numpy(), return_index=True)
    table = table.take(pa.array(at))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    pivot = int(np.searchsorted(reps, table.column("pivot")[0].as_py()))
    label = np.arange(len(reps))
    for a, b in joining_links(sets, label, label, t, pivot):
        x, y = label[a], label[b]
        label[label == (y if x == pivot else max(x, y) if y != pivot else x)] = pivot if pivot in (x, y) else min(x, y)
    own = np.flatnonzero(~np.array(table.column("extra").to_pylist(), bool))
    kept = table.select(["rep", "leader", "salt", "pivot"]).take(pa.array(own))
    return kept.append_column("label", pa.array(reps[label[own]], pa.int64()))


def _more_links(table: pa.Table, t: Fraction) -> pa.Table:
    """Links a, b between the chunks of a pair of units."""
    table = table.take(pa.array(np.unique(table.column("rep").to_numpy(), return_index=True)[1]))
    reps = table.column("rep").to_numpy()
    places = np.unique(np.stack([table.column("leader").to_numpy(), table.column("salt").to_numpy()], 1), axis=0, return_inverse=True)[1].ravel()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    found = joining_links(sets, table.column("label").to_numpy(), places, t)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return pa.Table.from_batches([common.rows_batch([(int(reps[a]), int(reps[b])) for a, b in found], schema)])


def _unit_pairs(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v of the pairs of units that share a list and hold different components, and unit, rep of the units' classes."""
    far = labels.where("label <> pivot").groupBy("leader").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("parts"))
    off = F.col("label") != F.col("pivot")
    part = F.when(off, F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))).otherwise(F.col("salt"))
    unit = F.struct("leader", F.when(off, 1).otherwise(0).alias("far"), part.alias("part")).alias("unit")
    place = F.struct("leader", "salt").alias("place")
    marked = lists.select("token", "rep").join(labels.join(far, "leader", "left").select("rep", "label", unit, place), "rep")
    spans = marked.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("copies")).where("x <> y")
    marked = common.staged(common.meet(marked, spans, ["token"], lists.count()).drop("x", "y"), "join-spans")
    held = marked.groupBy("token", "unit").agg(*[f(c).alias(n) for c, lo, hi in (("label", "lo", "hi"), ("place", "near", "off")) for f, n in ((F.min, lo), (F.max, hi))])
    one, two = (held.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("unit", "lo", "hi", "near", "off")]) for k in "12")
    # Sets of one chunk have been compared.
    met = one.join(two, "token").where("unit1 <= unit2 AND least(lo1, lo2) <> greatest(hi1, hi2) AND least(near1, near2) <> greatest(off1, off2)")
    return met.select(F.col("unit1").alias("u"), F.col("unit2").alias("v")).distinct(), marked.select("unit", "rep").distinct()


def class_components(sets: DataFrame, docs: DataFrame, size: int, t: Fraction) -> DataFrame:
    """node, component of every class (by its smallest doc_id) that is linked with another. ``sets`` are those of ``docs``,
    whose ids are unique and not null."""
    lists = candidate_lists(sets, t)
    placed = groups(lists).join(sets.select(F.col("doc_id").alias("rep"), "k1", "k2"), "rep")
    placed = common.staged(placed, "join-placed")
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_filter(placed))
    whole = common.staged(whole_sets(docs, placed, size, wanted).drop("k1", "k2"), "join-whole")
    places = placed.select("leader", "salt", "pivot").distinct().join(placed.select(F.col("rep").alias("pivot"), F.col("salt").alias("home")), "pivot").where("salt <> home")
    extra = places.select("leader", "salt", "pivot").join(whole.select(F.col("rep").alias("pivot"), "shingles"), "pivot")
    extra = extra.select("leader", "salt", F.col("pivot").alias("rep"), "pivot", "shingles", F.lit(True).alias("extra"))
    rows = whole.select("leader", "salt", "rep", "pivot", "shingles", F.lit(False).alias("extra")).unionByName(extra)
    labels = rows.groupBy("leader", "salt").applyInArrow(lambda table: _labels(table, t), "rep long, leader long, salt long, pivot long, label long")
    labels = common.staged(labels, "join-labels")
    pairs, members = _unit_pairs(lists, labels)
    pairs = common.staged(pairs, "join-units")
    links, spent = labels.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")), [labels, pairs]
    if not pairs.isEmpty():
        ends = pairs.select("u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("unit"))
        rows = ends.join(members, "unit").join(labels.select("rep", "leader", "salt", "label"), "rep").join(whole.select("rep", "shingles"), "rep")
        more = rows.select("u", "v", "rep", "leader", "salt", "label", "shingles").groupBy("u", "v").applyInArrow(lambda table: _more_links(table, t), "a long, b long")
        spent.append(common.staged(more, "join-links"))
        links = links.unionByName(spent[-1])
    found = common.staged(components(links), "join-components")
    common.discard(lists, placed, whole, *spent)
    return found


def _joined(docs: DataFrame, size: int, t: Fraction) -> DataFrame:
    """doc_id, n_shingles, component_id where ids are unique and not null."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(shingle_sketch(docs, size))
    sets = common.staged(document_sets(docs, size, t, sketch), "join-sets")
    joined = class_components(sets, docs, size, t)
    brief = common.staged(sets.select("doc_id", "k1", "k2", "n"), "join-brief")
    common.discard(sets)
    # Empty sets have one key, but they are linked with nothing. Sets that are alone and linked with none need no join.
    classes = brief.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 OR component IS NOT NULL")
    classes = classes.select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component"))
    out = common.meet(brief.where("n > 0"), classes, ["k1", "k2"], brief.count(), how="left").unionByName(brief.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _odd_ids(docs: DataFrame) -> bool:
    """Whether an id is null or repeated."""
    return not docs.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.count("*").alias("c")).where("k IS NULL OR c > 1").isEmpty()


def jaccard_components(docs: DataFrame, size: int = 5, threshold: str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``. Where ids are null or repeated, rows are
    compared by their number in the order of doc_id, and those of one id are linked."""
    t = Fraction(threshold)
    if not _odd_ids(docs):
        return _joined(docs, size, t)
    rows = _numbered(docs.select("doc_id", "text"), "_row").select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id IS NOT NULL")
    found = common.staged(_joined(named.select(F.col("_row").alias("doc_id"), "text"), size, t), "join-found")
    first = named.groupBy("doc_id").agg(F.min("_row").alias("b"))
    links = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(named.join(first, "doc_id").select(F.col("_row").alias("a"), "b"))
    joined = components(links).join(named.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    out = rows.select("_row", "doc_id").join(joined.select(F.col("node").alias("_row"), "component_id"), "_row", "left")
    blank = rows.where("doc_id IS NULL").select(F.col("_row").alias("doc_id"), "text")
    sizes = found.select(F.col("doc_id").alias("_row"), "n_shingles").unionByName(set_sizes(blank, size).withColumnRenamed("doc_id", "_row"))
    return out.join(sizes, "_row").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def set_sizes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.rows_batch([(d, len(shingles(raw, size))) for d, raw in zip(b.column("doc_id").to_pylist(), common.utf8(b, "text"), strict=True)], schema)

    return _texts(docs).mapInArrow(count, "doc_id long, n_shingles long")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row in the order of doc_id, nulls last, staged."""
    key = F.col("doc_id").cast("long").asc_nulls_last()
    order = [key, F.xxhash64("text").asc(), F.col(name).asc()]
    dealt = docs.withColumn(name, F.monotonically_increasing_id()).repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return common.staged(dealt.withColumn(name, F.monotonically_increasing_id()), "join-rows")


def keep_one(docs: DataFrame, size: int = 5, threshold: str = "0.8") -> DataFrame:
    """``docs`` with one row of each component alone, that of the smallest doc_id. Where ids are null or repeated, rows
    are numbered and compared by their number: each row counts by its own text, a null id is after all others."""
    name, t = "_component_doc", Fraction(threshold)
    if not _odd_ids(docs):
        chosen = _joined(docs, size, t).where("component_id = doc_id").select(F.col("doc_id").alias(name))
        return docs.join(chosen, docs["doc_id"].cast("long") == chosen[name], "left_semi")
    rows = _numbered(docs, name)
    chosen = _joined(rows.select(F.col(name).alias("doc_id"), "text"), size, t).where("component_id = doc_id").select(F.col("doc_id").alias(name))
    return rows.join(chosen, name, "left_semi").select(*docs.columns)
