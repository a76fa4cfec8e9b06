"""Checks of detected clips and of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.operators.report import signals_in_range


def clip_checks(clips: DataFrame, signals: tuple[str, ...] = ()) -> DataFrame:
    """PASS, WARN or FAIL of each check of clips(start_s, end_s, score, duration, snippet). With ``signals``, columns of
    ``clips``, signal_check tells whether all of them lie in [0, 1]."""
    length = F.col("end_s") - F.col("start_s")
    ok = lambda c, bad="FAIL": F.when(c, "PASS").otherwise(bad)
    more = {"signal_check": signals_in_range(list(signals))} if signals else {}
    return clips.withColumns(more | {
        "score_check": ok(F.col("score").between(0, 1)), "order_check": ok(F.col("start_s") < F.col("end_s")), "length_check": ok(length.between(15, 90), "WARN"),
        "bounds_check": ok((F.col("start_s") >= 0) & (F.col("end_s") <= F.col("duration") + 5)), "snippet_check": ok(F.coalesce("snippet", F.lit("")) != "", "WARN"),
    })


CHECKS = ("score_check", "order_check", "length_check", "bounds_check", "snippet_check", "signal_check")


def tally(checked: DataFrame, keys: list[str]) -> DataFrame:
    every = checked.select(*keys, F.explode(F.array(*[c for c in CHECKS if c in checked.columns])).alias("v"))
    found = every.groupBy(*keys).agg(*[F.count_if(F.col("v") == x).alias(x.lower()) for x in ("PASS", "WARN", "FAIL")])
    return found.withColumn("overall", F.when(F.col("fail") > 0, "FAIL").when(F.col("warn") > 0, "WARN").otherwise("PASS"))


def iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
    union = (a2 - a1) + (b2 - b1) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def neighbour_iou(clips: DataFrame, key: str = "job_id") -> DataFrame:
    """Each clip's overlap with the next one by start."""
    w = Window.partitionBy(key).orderBy("start_s", "end_s", "clip_no")
    rows = clips.withColumns({"next_start_s": F.lead("start_s").over(w), "next_end_s": F.lead("end_s").over(w)})
    return rows.where("next_start_s IS NOT NULL").withColumn("iou", iou(F.col("start_s"), F.col("end_s"), F.col("next_start_s"), F.col("next_end_s")))


def coverage(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments, words, last end and the share of the video that is covered; below 0.7 is a warning."""
    found = segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.sum(F.size(T.tokens(F.col("text")))).alias("words"), F.max_by("end", F.struct("start", "seg_idx")).alias("last_end"))
    rows = found.join(durations, "video_id")
    share = F.coalesce(F.try_divide(F.col("last_end"), F.col("duration")), F.lit(0.0))
    return rows.withColumn("coverage", share).withColumn("verdict", F.when(share < 0.7, "WARN").otherwise("PASS"))
