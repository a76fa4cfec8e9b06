"""Filter interaction audit: what each filter removes, alone and after the others, for every order of applying them.

Each document becomes one mask of the filters that it fails. Documents of a part with the same mask act alike, so they
are counted first; only these few cells (parts times masks) are unpivoted against the steps of all orders. In this long
form a running bit-or over the steps before tells whether a cell is gone already, conditional sums over the cells of a step
give its counts, and a total over a filter's rows of all orders its Shapley numerator.

Copies: the first row of a text is found by one partial aggregation on the text's SHA-256 and joined back on digest and
doc_id together, so a text that a third of all rows share is no hot key.

Nulls: a null text is the empty text, a null part the empty string. A row without doc_id is never a copy, nor the first of
one. Rows that share a doc_id are documents of their own; those of them with the first text of its kind are all no copies.
A document is good (toxic) if any row of ``labels`` with its doc_id says so. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.llm.common import SPACE_CLASS, discard, staged, text_of


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def few_distinct_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def many_capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text)


def has_symbol(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions on a text and its words, by letter; ``COPY`` fails texts that a smaller doc_id has.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": has_symbol}
COPY = "E"


def masks(docs: DataFrame, part: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """doc_id, part, mask and n, the rows of ``docs`` that share these: bit k of the mask is set where they fail the k-th
    filter, the last bit where they are copies. Equal rows are counted before each shuffle."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    # One element by a generator: the words are computed once, however many conditions read them.
    base = base.withColumn("words", F.explode(F.array(F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != ""))))
    own = sum((f(F.col("text"), F.col("words")).cast("int") * (1 << k) for k, f in enumerate(filters.values())), F.lit(0))
    rows = base.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("own"))
    rows = staged(rows.groupBy("digest", "doc_id", "part", "own").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    found = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("own") + copy.cast("int") * (1 << len(filters)))
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def unpivot(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each cell, order and step: filter_order, step and the bit of the step's filter."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(letters)))), " ")
    at = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    return at.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', substr(filter_order, step, 1)) - 1)"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = "".join(filters) + COPY
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = masks(docs, part, filters).join(marks, "doc_id", "left")
    cells = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")))
    long = unpivot(cells, letters)

    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("fails", fails).withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    failed, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(value: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(value)).otherwise(F.lit(0)))

    counted = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~failed & ~gone).alias("kept"),
        total("n", failed & ~gone).alias("removed"),
        total("n", failed & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", failed & ~gone).alias("good_lost"),
        total("toxic", failed & ~gone).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


#: The contract's columns in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 200,
  'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': d.doc_id > f.first} AS x FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
u AS (SELECT doc_id, part, good, toxic, k.letter, coalesce(CASE k.letter WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C
  WHEN 'D' THEN x.D ELSE x.E END, FALSE) AS failed FROM m, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) k),
p AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p),
z AS (SELECT doc_id, part, good, toxic, string_agg(letter, '' ORDER BY letter) FILTER (failed) AS bad FROM u GROUP BY ALL),
b AS (SELECT part, coalesce(bad, '') AS bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM z GROUP BY ALL),
q AS (SELECT b.*, filter_order, step, filter_order[step] AS letter, contains(bad, filter_order[step]) AS fails,
  len(list_filter(range(1, step), lambda i: contains(bad, filter_order[i]))) > 0 AS gone FROM b, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bad = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
