"""The detection plan: candidates, content scores, social fusion, threshold, selection, refinement, final selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.operators import audio as A
from reelspan.operators import batches as B
from reelspan.operators import quality as Q
from reelspan.operators import refine as R
from reelspan.operators import social as C
from reelspan.operators import windows as W
from reelspan.operators.select import select_moments
from reelspan.settings import DEFAULTS, Settings


def _fused(rows: DataFrame, comments: DataFrame | None, settings: Settings) -> DataFrame:
    """rows(video_id, start_s, end_s, content) with score."""
    if comments is None:
        return rows.withColumn("score", F.round("content", 9))
    joined = C.with_social(rows, comments, settings)
    return joined.withColumn("score", F.round(C.fused(F.col("content"), F.col("social"), F.col("confidence"), F.col("multiplier")), 9)).drop("social", "confidence", "multiplier")


def _content(found: DataFrame, frames: DataFrame | None, gaps: DataFrame | None, settings: Settings) -> DataFrame:
    """found(video_id, start_s, end_s, signals) with content by the text, and audio where given."""
    if frames is not None:
        found = A.window_features(found, frames, gaps, settings)
    return found.withColumn("content", W.content_score(settings, frames is not None))


def _beside(comments: DataFrame | None, frames: DataFrame | None, gaps: DataFrame | None, settings: Settings) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """Audio and comments as rows beside the segments (``windows.scored_windows``), and the totals of the videos with comments."""
    parts, totals = [], None

    def rows(found: DataFrame, kind: int, at: str, a: str | None = None, b: str | None = None, end: str | None = None) -> None:
        value = lambda c: F.col(c).cast("double") if c else F.lit(0.0)
        parts.append(found.select("video_id", F.lit(kind).alias("kind"), value(at).alias("start"), value(end).alias("end"), value(a).alias("a"), value(b).alias("b")))

    if frames is not None and gaps is not None:
        rows(A.normalised(frames).withColumn("laughter", F.col("energy") * F.col("zcr")), B.FRAME, "t", "energy", "laughter")
        rows(gaps, B.PAUSE, "mid")
    if comments is not None:
        found = C.clusters(comments, settings)
        seconds, pairs = C.named_seconds(comments, settings.sponsor_keywords, max(settings.lengths()) + 2 * settings.proximity_s)
        rows(found, B.CLUSTER, "center_s", "count")
        rows(seconds, B.SECOND, "t", "n", "sponsored")
        rows(pairs, B.PAIR, "t", "n", "sponsored", "u")
        totals = C.video_totals(found, settings)
    if not parts:
        return None, None
    if totals is None:
        totals = parts[0].select("video_id", F.lit(0.0).alias("max_count"), F.lit(0.0).alias("confidence")).limit(0)
    return reduce(DataFrame.unionByName, parts), totals.select("video_id", F.col("max_count").cast("double").alias("max_count"), "confidence")


def detect(segments: DataFrame, comments: DataFrame | None = None, frames: DataFrame | None = None, settings: Settings = DEFAULTS, max_clips: int | None = None, durations: DataFrame | None = None) -> DataFrame:
    """video_id, rank, start_s, end_s, score: at most ``max_clips`` disjoint moments of each video, best first. Videos with
    audio but no segment are found by their audio (``detect_audio``)."""
    k = settings.max_clips if max_clips is None else max_clips
    lines = W.timeline(segments)
    gaps = A.silence_gaps(frames, settings) if frames is not None else None
    chosen = W.best(segments, settings, *_beside(comments, frames, gaps, settings))
    refined = W.texts_inside(R.refine(chosen.drop("score").withColumnRenamed("rank", "turn"), lines, settings))
    again = _fused(_content(W.text_signals(refined.drop("segs")).drop("text"), frames, gaps, settings), comments, settings)
    found = select_moments(again, max(0, k), "turn").select("video_id", "rank", "start_s", "end_s", "score")
    if frames is None:
        return found
    silent = frames.join(segments.select("video_id").distinct(), "video_id", "left_anti")
    return found.unionByName(detect_audio(silent, comments, settings, max_clips, durations))


def detect_audio(frames: DataFrame, comments: DataFrame | None = None, settings: Settings = DEFAULTS, max_clips: int | None = None, durations: DataFrame | None = None) -> DataFrame:
    """The same without transcripts: windows every ``anchor_step_s``, audio scores, edges moved to silences. The timeline
    ends with the media, by durations(video_id, duration); where that is unknown, at the last frame's time."""
    k = settings.max_clips if max_clips is None else max_clips
    gaps = A.silence_gaps(frames, settings)
    ends = frames.groupBy("video_id").agg(F.max("t").alias("timeline_end"))
    if durations is not None:
        ends = ends.join(durations.select("video_id", "duration"), "video_id", "left").select("video_id", F.coalesce("duration", "timeline_end").alias("timeline_end"))
    step = settings.anchor_step_s
    anchors = ends.select("video_id", "timeline_end", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.col("timeline_end") / step).cast("int")), lambda i: i * step)).alias("anchor", "start_s"))
    lengths = F.array(*[F.lit(x) for x in settings.lengths()])
    rows = anchors.select("*", F.posexplode(lengths).alias("len_idx", "length")).withColumn("end_s", F.col("start_s") + F.col("length")).where(F.col("end_s") <= F.col("timeline_end") + 1e-9)

    def scored(windows: DataFrame) -> DataFrame:
        found = A.window_features(windows, frames, gaps, settings).withColumn("content", W.audio_score(settings))
        return _fused(found, comments, settings)

    chosen = select_moments(scored(rows).where(F.col("score") >= settings.min_clip_score), settings.top_k).drop("score").withColumnRenamed("rank", "turn")
    mids = gaps.groupBy("video_id").agg(F.array_sort(F.collect_list("mid")).alias("mids"))
    near = chosen.join(ends, "video_id").join(mids, "video_id", "left").withColumnsRenamed({"start_s": "raw_start_s", "end_s": "raw_end_s"})
    own = F.coalesce("mids", F.array().cast("array<double>"))
    near = near.withColumn("a", R.nearest_silence(own, F.col("raw_start_s"), settings.search_s)).withColumn("e", R.nearest_silence(own, F.col("raw_end_s"), settings.search_s))
    a, b = R.clamped(F.col("a"), F.col("e"), F.col("raw_start_s"), F.col("raw_end_s"), F.col("timeline_end"), settings)
    again = scored(near.withColumn("start_s", a).withColumn("end_s", b).drop("mids", "a", "e"))
    return select_moments(again, max(0, k), "turn").select("video_id", "rank", "start_s", "end_s", "score")


def score_window(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """video_id, start_s, end_s, score of each video's whole span: from its first segment's start to its last one's end."""
    lines = W.timeline(segments).where(F.size("segs") > 0)
    rows = lines.withColumns({"start_s": F.col("segs")[0]["start"], "end_s": F.element_at("segs", -1)["end"]})
    return _content(W.signals(W.texts_inside(rows)), None, None, settings).select("video_id", "start_s", "end_s", F.round("content", 9).alias("score"))


def clip_report(clips: DataFrame, segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """clips(video_id, start_s, end_s, and score if there is one) with their signals, recomputed from the segments, snippet and checks
    (``quality.clip_checks``). Without a score the content's is taken; the duration is the last segment's end, null for a
    video without segments, whose bounds then fail."""
    rows = clips.join(W.timeline(segments).withColumnRenamed("timeline_end", "duration"), "video_id", "left")
    rows = W.signals(W.texts_inside(rows.withColumn("segs", F.coalesce("segs", F.array().cast(rows.schema["segs"].dataType))))).drop("segs")
    score = F.col("score") if "score" in clips.columns else F.round(W.content_score(settings), 9)
    rows = rows.withColumns({"score": score, "snippet": F.substring(F.trim("text"), 1, 200)}).drop("text")
    return Q.clip_checks(rows, W.SIGNALS)


def snippets(clips: DataFrame, segments: DataFrame, most: int = 200) -> DataFrame:
    """clips(video_id, start_s, end_s, ...) with the text of the segments that they overlap, cut to ``most`` characters."""
    rows = clips.join(W.timeline(segments).select("video_id", "segs"), "video_id", "left")
    text = F.trim(W.joined_text(W.overlapping(F.col("segs"), F.col("start_s"), F.col("end_s"))))
    return rows.withColumn("snippet", F.substring(F.coalesce(text, F.lit("")), 1, most)).drop("segs")
