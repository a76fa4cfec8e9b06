"""Audio signals from feature frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import clamp
from reelspan.settings import DEFAULTS, Settings

HOP, RATE, FRAME = 512, 16_000, 2048


def normalised(frames: DataFrame) -> DataFrame:
    """frames with energy and zero-crossing rate as shares of the video's largest, 0 where that is 0."""
    w = Window.partitionBy("video_id")
    share = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    return frames.select("video_id", "frame_idx", "t", "rms", share("rms").alias("energy"), share("zcr").alias("zcr"))


def floors(frames: DataFrame) -> DataFrame:
    """The video's silence floor: the 10th percentile of raw RMS, 1e-5 at least."""
    return frames.groupBy("video_id").agg(F.greatest(F.percentile("rms", F.lit(0.1)), F.lit(1e-5)).alias("floor"), F.max("t").alias("last_t"))


def silence_gaps(frames: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Runs of frames at or below the floor, closed by the next frame's time (the last frame's at the end), long ones."""
    w = Window.partitionBy("video_id").orderBy("t")
    marked = frames.join(floors(frames), "video_id").withColumn("silent", F.col("rms") <= F.col("floor"))
    marked = marked.withColumn("next_t", F.coalesce(F.lead("t").over(w), "last_t"))
    turn = F.when(F.col("silent") != F.coalesce(F.lag("silent").over(w), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("turn", turn).withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("silent")
    found = runs.groupBy("video_id", "run").agg(F.min("t").alias("gap_start"), F.max("next_t").alias("gap_end"))
    found = found.where(F.col("gap_end") - F.col("gap_start") >= settings.pause_min_s)
    return found.select("video_id", "gap_start", "gap_end", ((F.col("gap_start") + F.col("gap_end")) / 2).alias("mid"))


def mids_by_part(gaps: DataFrame, step: float) -> DataFrame:
    """video_id, part, mids: the midpoints of each stretch [part * step, (part + 1) * step) and of the one before it."""
    part = F.floor(F.col("mid") / step)
    rows = gaps.select("video_id", "mid", F.explode(F.array(part, part + 1)).alias("part"))
    return rows.groupBy("video_id", "part").agg(F.array_sort(F.collect_list("mid")).alias("mids"))


def window_features(windows: DataFrame, frames: DataFrame, gaps: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """windows(video_id, start_s, end_s, ...) with audio_energy, audio_laughter, audio_pause; frames count in
    [start, end), pauses whose midpoint lies in [start - pause_min_s, end). Window edges are sorted among a video's frames
    and pauses, and running sums up to the two edges are subtracted: a window costs three rows, however many frames it
    holds. Windows that agree in all columns are as many rows as they were."""
    zero, none = F.lit(0.0), F.lit(0)
    keys = windows.columns
    sums = {"energy": zero, "laughter": zero, "n": none, "pauses": none}
    windows = windows.withColumn("_window", F.monotonically_increasing_id())
    edge = F.struct(*keys, "_window").alias("w")
    edges = F.explode(F.array(*[F.struct(at.alias("t"), F.lit(k).alias("edge")) for k, at in enumerate((F.col("start_s") - settings.pause_min_s, F.col("start_s"), F.col("end_s")))])).alias("e")
    rows = windows.select("video_id", edge, edges).select("video_id", "w", "e.t", "e.edge", *[v.alias(k) for k, v in sums.items()])
    blank = [F.lit(None).cast(rows.schema["w"].dataType).alias("w"), "t", F.lit(3).alias("edge")]
    heard = normalised(frames).select("video_id", *blank, "energy", (F.col("energy") * F.col("zcr")).alias("laughter"), F.lit(1).alias("n"), none.alias("pauses"))
    mids = gaps.withColumn("t", F.col("mid")).select("video_id", *blank, zero.alias("energy"), zero.alias("laughter"), none.alias("n"), F.lit(1).alias("pauses"))
    # An edge stands before what begins at its time, which is outside of a window that ends there.
    before = Window.partitionBy("video_id").orderBy("t", "edge").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.unionByName(heard).unionByName(mids).select("video_id", "w", "edge", *[F.sum(k).over(before).alias(k) for k in sums]).where("edge < 3")
    at = lambda name, k: F.max(F.when(F.col("edge") == k, F.col(name)))
    inside = [(at(k, 2) - at(k, 0 if k == "pauses" else 1)).alias(f"_{k}") for k in sums]
    found = summed.groupBy("video_id", "w").agg(*inside)
    mean = lambda c: clamp(F.when(F.col("_n") > 0, F.round(F.col(c) / F.col("_n"), 12)).otherwise(0.0))
    out = found.withColumns({"audio_energy": mean("_energy"), "audio_laughter": mean("_laughter"), "audio_pause": F.least(F.lit(1.0), F.col("_pauses") / F.lit(3.0))})
    return out.select(*[F.col(f"w.`{k}`").alias(k) for k in keys], "audio_energy", "audio_laughter", "audio_pause")


def per_second(frames: DataFrame) -> DataFrame:
    """Mean energy of every second from 0 to the last frame's, 0 where a second has no frame."""
    means = normalised(frames).groupBy("video_id", F.floor("t").cast("int").alias("second")).agg(F.avg("energy").alias("energy"))
    spine = frames.groupBy("video_id").agg(F.max("t").alias("last")).select("video_id", F.explode(F.sequence(F.lit(0), F.floor("last").cast("int"))).alias("second"))
    return spine.join(means, ["video_id", "second"], "left").select("video_id", "second", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def baselines(seconds: DataFrame) -> DataFrame:
    """The median of a video's positive seconds, 0 without any."""
    return seconds.groupBy("video_id").agg(F.coalesce(F.median(F.when(F.col("energy") > 0, F.col("energy"))), F.lit(0.0)).alias("baseline"))


def ratio(x: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise(x / base)


def signal_features(y: np.ndarray, lo: int, n: int, first: int, until: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """frame_idx, rms, zcr of the frames ``first`` to ``until`` of a signal of ``n`` samples, of which ``y`` holds those from ``lo``
    on that these frames reach, in slices. A frame is the 2048 samples around its hop. Beyond the signal's edges RMS takes
    zeros, the zero-crossing rate the edge's sample; for the latter values up to 1e-10 count as zero, which has the sign of
    what is positive, and a frame's crossings are divided by all its samples."""
    if first >= until:
        return
    start = first * HOP - FRAME // 2
    before, after = max(0, -start), max(0, (until - 1) * HOP + FRAME // 2 - n)
    y = y[max(0, start) - lo :]
    squares = np.pad(y.astype(np.float64) ** 2, (before, after))
    below = np.pad(y < -1e-10, (before, after), mode="edge")
    crossed = np.concatenate([[0], np.cumsum(below[1:] != below[:-1])])
    for a in range(first, until, 1024):
        at = np.arange(a, min(until, a + 1024))
        begin = (at - first) * HOP
        block = np.lib.stride_tricks.sliding_window_view(squares, FRAME)[begin]
        yield at, np.sqrt(block.mean(1)), (crossed[begin + FRAME - 1] - crossed[begin]) / FRAME


def frame_features(audio: DataFrame) -> DataFrame:
    """video_id, frame_idx, t, rms, zcr from audio(video_id, pcm binary: mono 32-bit float samples at 16 kHz), for clips that fit
    into one cell; ``recordings`` reads whole files by ranges."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for video, pcm in zip(pdf.video_id, pdf.pcm, strict=True):
                y = np.frombuffer(pcm or b"", "<f4")
                for at, rms, zcr in signal_features(y, 0, len(y), 0, 1 + len(y) // HOP if len(y) else 0):
                    yield pd.DataFrame({"video_id": video, "frame_idx": at.astype("int32"), "t": at * HOP / RATE, "rms": rms, "zcr": zcr})

    return audio.select("video_id", "pcm").mapInPandas(run, "video_id long, frame_idx int, t double, rms double, zcr double")
