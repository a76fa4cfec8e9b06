"""Greedy selection of intervals that don't overlap: best score first, then earliest, then the order that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<neg:double,start_s:double,turn:int,anchor:int,len_idx:int,end_s:double>"


def greedy(candidates: Column, k: int) -> Column:
    """Of an array of ITEM in ascending order those kept, at most ``k``; touching intervals don't overlap."""
    none = F.array().cast(f"array<{ITEM}>")

    def step(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda h: (c["start_s"] < h["end_s"]) & (c["end_s"] > h["start_s"]))
        return F.when((F.size(kept) >= k) | clash, kept).otherwise(F.concat(kept, F.array(c)))

    return F.aggregate(candidates, none, step)


def contenders(candidates: Column, k: int, begin: Column, end: Column, longest: float) -> Column:
    """Of the windows of one chunk of time, in ascending order of ITEM, all that the greedy walk over the whole video may keep.

    No window is longer than ``longest``, so one that begins as much after the chunk's begin and ends in it meets windows of the chunk
    alone: where no better one that is kept or open overlaps it, it is kept for certain. The others stay open, unless one
    that is certain overlaps them, or they hold a better open one: whatever removes that one overlaps them too. After ``k`` certain ones
    the rest of the chunk is out."""
    none = F.array().cast(f"array<{ITEM}>")
    zero = F.struct(none.alias("sure"), none.alias("open"))
    overlaps = lambda c: lambda h: (c["start_s"] < h["end_s"]) & (c["end_s"] > h["start_s"])

    def step(acc: Column, c: Column) -> Column:
        out = (F.size(acc["sure"]) >= k) | F.exists(acc["sure"], overlaps(c)) | F.exists(acc["open"], lambda h: (h["start_s"] >= c["start_s"]) & (h["end_s"] <= c["end_s"]))
        edge = (c["start_s"] - longest < begin) | (c["end_s"] > end) | F.exists(acc["open"], overlaps(c))
        held = F.when(edge, F.struct(acc["sure"].alias("sure"), F.concat(acc["open"], F.array(c)).alias("open"))).otherwise(F.struct(F.concat(acc["sure"], F.array(c)).alias("sure"), acc["open"].alias("open")))
        return F.when(out, acc).otherwise(held)

    return F.aggregate(candidates, zero, step, lambda acc: F.concat(acc["sure"], acc["open"]))


def select_moments(windows: DataFrame, k: int, turn: str | None = None, longest: float | None = None, span: float | None = None) -> DataFrame:
    """video_id, rank, start_s, end_s, score, anchor, len_idx of the windows kept per video. Windows of one score and
    start keep the order of column ``turn``, or else that in which they were made.

    With ``longest`` and ``span`` given, ``windows`` has a column ``chunk``, the chunk of ``span`` seconds in which the window begins:
    then each chunk is thinned by itself, and what comes together for a video is a few windows a chunk."""
    first = (F.col(turn) if turn else F.lit(0)).cast("int").alias("turn")
    item = F.struct((-F.col("score")).alias("neg"), F.col("start_s"), first, F.col("anchor").cast("int").alias("anchor"), F.col("len_idx").cast("int").alias("len_idx"), F.col("end_s")).cast(ITEM)
    rows = windows.select("video_id", *(["chunk"] if longest is not None else []), item.alias("m"))
    if longest is not None and span is not None:
        own = rows.groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list("m")).alias("c"))
        rows = own.select("video_id", F.explode(contenders(F.col("c"), k, F.col("chunk") * span, (F.col("chunk") + 1) * span, longest)).alias("m"))
    ranked = rows.groupBy("video_id").agg(F.array_sort(F.collect_list("m")).alias("c"))
    kept = ranked.select("video_id", F.posexplode(greedy(F.col("c"), k)).alias("rank", "m"))
    return kept.select("video_id", (F.col("rank") + 1).alias("rank"), F.col("m.start_s").alias("start_s"), F.col("m.end_s").alias("end_s"), (-F.col("m.neg")).alias("score"), F.col("m.anchor").alias("anchor"), F.col("m.len_idx").alias("len_idx"))
