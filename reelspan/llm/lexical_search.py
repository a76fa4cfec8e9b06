"""Ranked lexical search: the 10 best documents for each item, by an exact integer relevance score.

Scores are one sparse matrix product: items by terms (multiplicities) times terms by documents (int64 impacts). It is
computed in blocks. Items are dealt to blocks of bounded text (``ITEM_BYTES``; a longer item is a block by itself), and
only such a block's vocabulary and rows are broadcast. Documents are read by partition, in blocks of bounded entries
(``BLOCK_ENTRIES``): a block is sorted by term, and each item's row of the product is merged from the rows of its terms
(Gustavson) into one int64 accumulator. A task keeps the best ``k`` of each item over all its blocks; the tasks' lists are
merged in two steps. No pair of an item and a document ever leaves a task but for these.

A document's entries for a block's vocabulary are written once, term and count in flat binaries; document frequencies
are summed by task before they are shuffled. N and L cover all documents.

Nulls: a null text has no terms. A null item_id is an item, a null doc_id a document that comes first among equal scores.
Rows that share an item_id are one item with the terms of its different texts; documents that share a doc_id are ranked
one by one. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.llm import common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Text of the items in a block, and entries of the documents in a block.
ITEM_BYTES, BLOCK_ENTRIES = 4_000_000, 2_000_000
RANKED = "item int, doc_id long, score long"


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemBlock:
    """The items-by-terms matrix of some items, by rows: ``columns`` and ``counts`` between ``ends``."""

    def __init__(self, texts: list[list[str]]):
        self.vocabulary: dict[str, int] = {}
        rows = []
        for own in texts:
            found = Counter(x for t in own for x in terms(t))
            rows.append([(self.vocabulary.setdefault(x, len(self.vocabulary)), c) for x, c in found.items()])
        flat = [e for r in rows for e in r]
        self.columns = np.array([e[0] for e in flat], np.int64)
        self.counts = np.array([e[1] for e in flat], np.int64)
        self.ends = np.cumsum([0, *map(len, rows)])


class DocumentBlock:
    """The terms-by-documents matrix of some documents, by terms: impacts, weighted by term."""

    def __init__(self, sizes: np.ndarray, columns: list[np.ndarray], tf: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int):
        column, count = np.concatenate(columns), np.concatenate(tf).astype(np.int64)
        row = np.repeat(np.arange(len(columns), dtype=np.int64), [c.size for c in columns])
        length = 100 - 75 + (75 * sizes * n_docs) // n_terms
        order = np.argsort(column, kind="stable")
        column, count, row = column[order], count[order], row[order]
        self.impacts = weights[column] * ((1_000_000_000 * count) // (1000 * count + 8 * length[row]))
        self.rows = row
        self.starts = np.searchsorted(column, np.arange(weights.size + 1))
        self.n = len(columns)

    def product_row(self, columns: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """One item's scores of all documents of the block: the rows of its terms, each times its count, merged."""
        into[:] = 0
        for t, c in zip(columns.tolist(), counts.tolist(), strict=True):
            a, b = self.starts[t], self.starts[t + 1]
            into[self.rows[a:b]] += c * self.impacts[a:b]


def best(score: np.ndarray, doc: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores above 0; among equal ones rows without an id first, then by ascending id."""
    least = np.partition(score, -k)[-k] if score.size > k else 1
    found = np.flatnonzero(score >= max(1, least))
    return found[np.lexsort((doc[found], named[found], -score[found]))[:k]]


def _blocks(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """The items, each with the number of its block, and these numbers. Blocks are halved by hash until each is within the bound or one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).distinct()
    size = rows.groupBy("item_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = size.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items"))
        found = over.agg(F.collect_list("block").alias("blocks"), F.coalesce(F.sum(((F.col("bytes") > ITEM_BYTES) & (F.col("items") > 1)).cast("int")), F.lit(0)).alias("over")).first()
        if not found.over:
            return rows.withColumn("block", block), sorted(found.blocks)
        n *= 2


def _entries(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, size (terms with repeats), and the terms that the vocabulary has with their counts, for each document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("columns", pa.binary()), ("tf", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in common.sliced(batches, 200):
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(t)
                if found:
                    held = [(known[x], c) for x, c in Counter(found).items() if x in known]
                    out.append((i, len(found), np.array([e[0] for e in held], "<i4").tobytes(), np.array([e[1] for e in held], "<i4").tobytes()))
            yield common.rows_batch(out, schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return found.mapInArrow(read, "doc_id long, size long, columns binary, tf binary")


def _frequencies(entries: DataFrame, n: int) -> np.ndarray:
    """How many documents hold each term: counted by task, then summed."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column("columns").to_pylist():
                total[np.frombuffer(x, "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    out = np.zeros(n, np.int64)
    for r in entries.select("columns").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _ranked(entries: DataFrame, items: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of each item in each task."""
    sent = entries.sparkSession.sparkContext.broadcast((items.columns, items.counts, items.ends, weights))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts, ends, own = sent.value
        empty = np.zeros(0, np.int64)
        tops = [(empty, empty, np.zeros(0, bool))] * (len(ends) - 1)
        held: list[tuple] = []

        def merge() -> None:
            ids, sizes, cols, tf = zip(*held, strict=True)
            block = DocumentBlock(np.array(sizes, np.int64), list(cols), list(tf), own, n_docs, n_terms)
            doc, named = np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool)
            row = np.zeros(block.n, np.int64)
            for i in range(len(tops)):
                block.product_row(columns[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]], row)
                at = best(row, doc, named, k)
                score, d, m = (np.concatenate(x) for x in zip(tops[i], (row[at], doc[at], named[at]), strict=True))
                at = best(score, d, m, k)
                tops[i] = score[at], d[at], m[at]
            held.clear()

        n = 0
        for batch in batches:
            for i, size, c, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c:
                    held.append((i, size, np.frombuffer(c, "<i4"), np.frombuffer(f, "<i4")))
                    n += len(c) // 4
                if n >= BLOCK_ENTRIES:
                    merge()
                    n = 0
        if held:
            merge()
        found = ((i, int(d) if m else None, int(s)) for i, (score, doc, named) in enumerate(tops) for s, d, m in zip(score, doc, named, strict=True))
        yield from common.in_slices(found, schema)

    return entries.select("doc_id", "size", "columns", "tf").mapInArrow(rank, RANKED)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best rows of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    numbered, blocks = _blocks(items)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in blocks:
        own = numbered.where(F.col("block") == b).groupBy("item_id").agg(F.sort_array(F.collect_set("text")).alias("texts")).collect()
        block = ItemBlock([r.texts for r in own])
        entries = common.staged(_entries(docs, block.vocabulary), "search-entries")
        total = entries.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("terms")).first()
        if total.n and block.vocabulary:
            weights = np.array([weight(total.n, d) for d in _frequencies(entries, len(block.vocabulary)).tolist()], np.int64)
            ranked = _ranked(entries, block, weights, total.n, total.terms, k).withColumn("part", F.spark_partition_id())
            order = [F.desc("score"), F.asc_nulls_first("doc_id")]
            some = W.partitionBy("item", F.floor(F.col("part") / 64)).orderBy(*order)
            last = W.partitionBy("item").orderBy(*order)
            ranked = ranked.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
            ranked = ranked.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "item int, item_id long")
            out = out.unionByName(common.staged(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-ranked"))
        common.discard(entries)
    return out


#: The contract's columns in DuckDB SQL.
ORACLE = r"""
WITH c AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM (SELECT DISTINCT item_id, text FROM benchmark), c),
q AS (SELECT item_id, x, count(*) AS a FROM i GROUP BY ALL),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM documents, c),
f AS (SELECT doc_id, x, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT x, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, t GROUP BY x),
s AS (SELECT item_id, doc_id, sum(a * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (x) JOIN w USING (x) JOIN n USING (doc_id), t GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10"""
