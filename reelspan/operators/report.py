"""Rows of the detection report: length guard, test window, edges of a transcript, first pauses, short snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import text as T


def length_guard(duration: Column) -> Column:
    """FAIL over two hours, WARN over one."""
    return F.when(duration > 7200, "FAIL").when(duration > 3600, "WARN").otherwise("PASS")


def dry_run_window(videos: DataFrame, clusters: DataFrame) -> DataFrame:
    """A minute of each of videos(video_id, duration, audio_duration): from 20 s before the largest cluster's centre, or
    from 40 % of a video without clusters, and not beyond its audio where that is known."""
    top = clusters.groupBy("video_id").agg(F.max_by("center_s", F.struct("count", -F.col("start_s"))).alias("anchor"))
    start = F.when(F.col("anchor").isNotNull(), F.greatest(F.lit(0.0), F.col("anchor") - 20)).otherwise(F.col("duration") * 0.4)
    rows = videos.join(top, "video_id", "left").withColumn("start_s", start)
    return rows.select("video_id", "start_s", F.least(F.col("start_s") + 60, "audio_duration").alias("end_s"))


def has_cluster(packed: Column, start: Column, end: Column) -> Column:
    """Whether a cluster's centre lies in the closed window."""
    return F.coalesce(F.exists(packed, lambda c: (c["center_s"] >= start) & (c["center_s"] <= end)), F.lit(False))


def segment_edges(segments: DataFrame, first: int = 5, last: int = 3, most: int = 60) -> DataFrame:
    """The first and the last segments of each video, cut to ``most`` characters; a segment may be both."""
    w = Window.partitionBy("video_id")

    def edge(name: str, order: list[Column], k: int) -> DataFrame:
        rows = segments.withColumn("k", F.row_number().over(w.orderBy(*order))).where(F.col("k") <= k)
        return rows.select("video_id", F.lit(name).alias("edge"), "seg_idx", "start", F.substring(T.strip(F.col("text")), 1, most).alias("text"))

    return edge("first", [F.asc("start"), F.asc("seg_idx")], first).unionByName(edge("last", [F.desc("start"), F.desc("seg_idx")], last))


def first_pauses(gaps: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("gap_start")
    return gaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def short_snippet(text: Column, most: int = 52) -> Column:
    """The first sentence, or the text where that is empty, in one line; what is longer ends with three dots."""
    said = T.first_sentence(text)
    line = F.replace(T.strip(F.when(said != "", said).otherwise(text)), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def signals_in_range(signals: list[str]) -> Column:
    """PASS where every signal lies in [0, 1]; a signal that was not measured is no failure."""
    ok = F.lit(True)
    for name in signals:
        ok = ok & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return F.when(ok, "PASS").otherwise("FAIL")
