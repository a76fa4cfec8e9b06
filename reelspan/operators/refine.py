"""Boundary refinement: nearest segment or silence within reach, forward laughter, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.settings import DEFAULTS, REACTION_PATTERN, Settings


def _nearest(options: Column, edge: Column) -> Column:
    """Of structs (class, distance, idx, at) the least; a snapped time of exactly 0 counts as none."""
    best = F.array_min(options)["at"]
    return F.when(best.isNull() | (best == 0.0), edge).otherwise(best)


def snapped_start(segs: Column, start: Column, reach: float) -> Column:
    """The nearest segment start within reach, those after a sentence's end first, then the earlier one on a tie."""
    def option(s: Column, i: Column) -> Column:
        clean = (i == 0) | T.ends_sentence(F.get(segs, i - 1)["text"])
        near = F.abs(s["start"] - start)
        return F.when(near <= reach, F.struct(F.when(clean, 0).otherwise(1).alias("c"), near.alias("d"), i.alias("i"), s["start"].alias("at")))

    return _nearest(F.filter(F.transform(segs, option), lambda x: x.isNotNull()), start)


def snapped_end(segs: Column, end: Column, reach: float) -> Column:
    def option(s: Column, i: Column) -> Column:
        near = F.abs(s["end"] - end)
        return F.when(near <= reach, F.struct(F.when(T.ends_sentence(s["text"]), 0).otherwise(1).alias("c"), near.alias("d"), i.alias("i"), s["end"].alias("at")))

    return _nearest(F.filter(F.transform(segs, option), lambda x: x.isNotNull()), end)


def laughter_end(segs: Column, end: Column, settings: Settings) -> Column:
    """The end of the first reaction that begins within reach after ``end``, and a little more."""
    near = F.filter(segs, lambda s: (s["start"] - end >= 0) & (s["start"] - end <= settings.laughter_reach_s) & s["text"].rlike(REACTION_PATTERN))
    return F.coalesce(F.get(near, F.lit(0))["end"] + settings.laughter_extend_s, end)


def clamped(start: Column, end: Column, raw_start: Column, raw_end: Column, timeline_end: Column, settings: Settings) -> tuple[Column, Column]:
    """Into [0, timeline]; an inverted window falls back to the raw one; a long one is cut."""
    a, b = F.greatest(F.lit(0.0), start), F.least(timeline_end, end)
    bad = b <= a
    a, b = F.when(bad, raw_start).otherwise(a), F.when(bad, raw_end).otherwise(b)
    return a, F.least(b, a + settings.max_clip_s)


def refine(moments: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """moments with raw_start_s, raw_end_s and refined start_s, end_s, and the video's segs."""
    rows = moments.join(lines, "video_id").withColumnsRenamed({"start_s": "raw_start_s", "end_s": "raw_end_s"})
    rows = rows.withColumn("a", snapped_start(F.col("segs"), F.col("raw_start_s"), settings.search_s)).withColumn("e", snapped_end(F.col("segs"), F.col("raw_end_s"), settings.search_s))
    rows = rows.withColumn("e", laughter_end(F.col("segs"), F.col("e"), settings))
    a, b = clamped(F.col("a"), F.col("e"), F.col("raw_start_s"), F.col("raw_end_s"), F.col("timeline_end"), settings)
    return rows.withColumn("start_s", a).withColumn("end_s", b).drop("a", "e")


def nearest_silence(mids: Column, edge: Column, reach: float) -> Column:
    """The midpoint in [max(0, edge - reach), edge + reach) nearest to the edge, the first on a tie, else the edge."""
    near = F.filter(mids, lambda m: (m >= F.greatest(F.lit(0.0), edge - reach)) & (m < edge + reach))
    options = F.transform(near, lambda m, i: F.struct(F.abs(m - edge).alias("d"), i.alias("i"), m.alias("at")))
    best = F.array_min(options)["at"]
    return F.coalesce(best, edge)
