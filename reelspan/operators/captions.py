"""Captions: words into lines, SRT blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import text as T


def caption_lines(words: DataFrame, per_line: int = 6, offset_s: float = 0.0) -> DataFrame:
    """Lines of at most ``per_line`` words; blank lines go, the rest are numbered from 1. Words without times are dropped."""
    w = Window.partitionBy("video_id").orderBy("word_idx")
    kept = words.where("start IS NOT NULL AND end IS NOT NULL").withColumn("line", F.floor((F.row_number().over(w) - 1) / per_line).cast("int"))
    item = F.struct("word_idx", "word", "start", "end")
    lines = kept.groupBy("video_id", "line").agg(F.array_sort(F.collect_list(item)).alias("w"))
    text = T.strip(F.array_join(F.transform("w", lambda x: T.strip(x["word"])), " "))
    lines = lines.select("video_id", "line", (F.col("w")[0]["start"] - offset_s).alias("start_s"), (F.element_at("w", -1)["end"] - offset_s).alias("end_s"), text.alias("text")).where("text <> ''")
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("video_id").orderBy("line"))).drop("line")


def srt(lines: DataFrame) -> DataFrame:
    """SRT blocks of lines(video_id, line_no, start_s, end_s, text)."""
    block = F.concat(F.col("line_no").cast("string"), F.lit("\n"), T.srt_time(F.col("start_s")), F.lit(" --> "), T.srt_time(F.col("end_s")), F.lit("\n"), F.col("text"))
    return lines.select("video_id", "line_no", block.alias("block"))


def segment_srt(segments: DataFrame) -> DataFrame:
    """A block per segment, numbered before blank ones go, so that numbers have holes; a null end is the start."""
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    rows = segments.withColumn("line_no", F.row_number().over(w)).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    return srt(rows.select("video_id", "line_no", F.coalesce("start", F.lit(0.0)).alias("start_s"), F.coalesce("end", "start", F.lit(0.0)).alias("end_s"), "text"))


def srt_files(blocks: DataFrame) -> DataFrame:
    """The SRT text of each video, for ``write.text`` partitioned by video_id."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "block")))
    return blocks.groupBy("video_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("value"))
