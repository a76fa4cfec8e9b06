"""SimHash fingerprints of documents, and permuted block tables that find those within a Hamming radius.

A text's terms are its runs of five words (all its words where it has fewer), each hashed to 64 bits. A term votes
once for each time that it stands in the text, +1 on its set bits and -1 on the others; the fingerprint has the bits
with a positive sum. Votes are counted in 32 sums, each with two 32-bit lanes, so one partial aggregation makes a
fingerprint and no row but (document, sums) is shuffled.

Block tables: 64 bits are cut into ``blocks``; fingerprints within ``radius`` differ in at most ``radius`` blocks, so
they agree on some choice of ``blocks - radius`` others. Each choice is a table keyed by those bits (its permutation
of the fingerprint begins with them). Equal fingerprints are one entry, so a group of copies never makes pairs.

Everything is built-in expressions. Nulls: a null text is the empty text, whose fingerprint is 0; a null doc_id sorts
first and has no ``near_classes``. Rows that share a doc_id give a row each, in the order of their texts. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.llm import common
from reelspan.llm.common import SPACE_CLASS, text_of

LANES = 0x0000000100000001


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def fingerprints(texts: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """keys, fp (long) for each row of ``texts(*keys, text)``; rows of equal keys vote together. A text without
    words has no terms and the fingerprint 0."""
    cut = texts.select(*keys, word_hashes(F.col("text")).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(size)]))
    terms = cut.select(*keys, F.explode_outer(F.when(F.size("w") > 0, runs)).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES))).alias(f"s{k}") for k in range(32)]
    voted = terms.groupBy(*keys).agg(F.count("h").alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{k}"), 32)
        for lane, at in ((low, k), (high, k + 32)):
            one = (1 << at) - (1 << 64 if at == 63 else 0)
            bits = bits.bitwiseOR(F.when(lane * 2 > F.col("n"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return voted.select(*keys, bits.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that two fingerprints' Hamming distance stands for, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def block_tables(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """fp, table, key: each fingerprint in every table."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    entries = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        entries.append(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.table", "e.key")


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Distinct pairs (query_fp, fp, distance) of ``queries(fp)`` and ``fps(fp)`` at most ``radius`` apart, equal
    ones left out. All pairs are found; exact distances are checked."""
    left = block_tables(queries.select("fp").distinct(), radius, blocks).withColumnRenamed("fp", "query_fp")
    right = block_tables(fps.select("fp").distinct(), radius, blocks)
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    near = left.join(right, ["table", "key"]).where((F.col("fp") != F.col("query_fp")) & (distance <= radius))
    return near.select("query_fp", "fp", distance.alias("distance")).distinct()


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, n_chars by ascending doc_id, the last followed by the first. Ids are dealt by range, so
    that only the edges of the ranges, a row for each, are brought together."""
    spark = docs.sparkSession
    dealt = docs.select("doc_id", "n_chars").repartitionByRange(common.partitions(spark), "doc_id").withColumn("part", F.spark_partition_id())
    dealt = common.staged(dealt, "simhash-ids")
    order = Window.partitionBy("part").orderBy("doc_id")
    inner = dealt.select("doc_id", "n_chars", "part", F.lead("doc_id").over(order).alias("within"), (F.row_number().over(order) == 1).alias("first"))
    edges = dealt.groupBy("part").agg(F.min("doc_id").alias("edge"))
    after = Window.orderBy("part")
    edges = edges.select("part", F.coalesce(F.lead("edge").over(after), F.min("edge").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    return inner.join(F.broadcast(edges), "part").select("doc_id", "n_chars", F.coalesce("within", "edge").alias("next_id"))


def numbered(rows: DataFrame) -> DataFrame:
    """row, id, text of ``rows(doc_id, text)``, numbered in the order of doc_id and text, staged."""
    spark = rows.sparkSession
    order = ["doc_id", "text", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    return common.staged(dealt.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"), "simhash-rows")


def with_classes(rows: DataFrame, classes: DataFrame, n_rows: int, hot: int = 1000) -> DataFrame:
    """``rows(fp, ...)`` with class_id and near of ``classes(fp, class_id, near, copies)``. A fingerprint with more than
    1/``hot`` of all rows would be one task of the join; there are fewer than ``hot`` of them, which are broadcast."""
    many = F.col("copies") * hot > n_rows
    top = classes.where(many).select("fp", F.struct("class_id", "near").alias("top"))
    dealt = rows.join(F.broadcast(top), "fp", "left")
    rest = dealt.where("top IS NULL").drop("top").join(classes.where(~many).select("fp", "class_id", "near").hint("merge"), "fp")
    return dealt.where("top IS NOT NULL").select("*", "top.*").drop("top").unionByName(rest)


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 20) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of each text edited with the next document's beginning.

    Texts are dealt by doc_id once; of the next document only the characters that replace the tail travel.
    ``class_id`` is the smallest doc_id with the same fingerprint; ``near_classes`` counts the other fingerprints
    within ``radius``, for rows whose id is divisible by ``query_step`` (else null)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Where ids are null or repeated, a row's number takes the place of its id until the end.
    named = None
    if not own.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id IS NULL OR c > 1").isEmpty():
        named = numbered(own)
        own, named = named.select(F.col("row").alias("doc_id"), "text"), named.select(F.col("row").alias("doc_id"), "id")
    ids = common.staged(next_ids(own.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))), "simhash-next")
    tails = own.join(ids.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("n_chars") / 4).alias("need")), "doc_id")
    tails = tails.select(F.col("for_id").alias("doc_id"), F.expr("substring(text, 1, cast(need as int))").alias("tail"))
    both = own.join(tails, "doc_id").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("tail"))
    two = both.select("doc_id", "n_chars", "text", edited.alias("edited"))
    rows = two.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text"), F.col("n_chars"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.col("n_chars"), F.sha2("edited", 256).alias("sha")))).alias("r")).select("doc_id", "r.*")
    fps = fingerprints(rows, ["doc_id", "which", "n_chars", "sha"])
    found = fps.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    found = common.staged(found, "simhash-prints")
    follow = ids.select("doc_id", "next_id").join(found.select(F.col("doc_id").alias("next_id"), F.col("fp").alias("next_fp")), "next_id").select("doc_id", "next_fp")
    found = found.join(named, "doc_id") if named else found.withColumn("id", F.col("doc_id"))
    classes = found.groupBy("fp").agg((F.min_by("id", "doc_id") if named else F.min("doc_id")).alias("class_id"), F.count("*").alias("copies"))
    queries = found.where(F.col("id") % query_step == 0).select("fp").distinct()
    near = within_radius(queries, classes, radius).groupBy(F.col("query_fp").alias("fp")).agg(F.count("*").alias("near"))
    extra = common.staged(classes.join(near, "fp", "left"), "simhash-classes")
    out = with_classes(found.join(follow, "doc_id"), extra, found.count())
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.lower(F.lpad(F.hex("edited_fp"), 16, "0")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "class_id",
        F.when(F.col("id") % query_step == 0, F.coalesce("near", F.lit(0))).alias("near_classes"),
    )
