"""Candidate windows, their text and content scores, in chunks of a video's time.

Windows begin at segments and are bounded in length, so a video is cut into chunks of ``CHUNK_S`` seconds; each chunk gets copies
of the few segments beside it that its windows reach, and is scored by itself. A long video thus spreads over as many tasks as it
has chunks. What a chunk has to know of its video, the segments before it and the end of the timeline, comes from one small row
for each chunk.

The windows of one anchor are prefixes of one list of segments, in order of their starts. Their signals are computed for many chunks at
once (``batches``).
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from reelspan.functions import text as T
from reelspan.operators import batches as B
from reelspan.operators.select import select_moments
from reelspan.settings import DEFAULTS, EMOTION_WORDS, Settings

CHUNK_S = 600.0
#: A segment is copied to at most so many chunks: to those of the next 60 million seconds.
MOST_CHUNKS = 100_000
#: How far back the segments are looked for that still run when another begins: the first step where none does.
LOOKBACK = (1, 4, 16, 64, 256, 1024)


def timed(segments: DataFrame) -> DataFrame:
    """segments whose times and texts aren't null; null times count as 0."""
    zero = F.lit(0.0)
    return segments.select("video_id", "seg_idx", F.coalesce("start", zero).alias("start"), F.coalesce("end", zero).alias("end"), F.coalesce("text", F.lit("")).alias("text"))


def timeline(segments: DataFrame) -> DataFrame:
    """video_id, segs (ordered by start, then seg_idx), timeline_end."""
    item = F.struct("start", "seg_idx", "end", "text")
    return timed(segments).groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("segs"), F.max("end").alias("timeline_end"))


def chunk_of(t: Column) -> Column:
    """The chunk of a time; what begins before 0 is in the first, so that the segments after 0 need no copies for a chunk before it."""
    return F.greatest(F.floor(t / CHUNK_S), F.lit(0).cast("long"))


def chunks(rows: DataFrame) -> DataFrame:
    """A row for each chunk of a video in which a segment begins: video_id, chunk, before (segments of earlier chunks), timeline_end, and
    whether segments begin in the chunks beside (prior, next)."""
    own = rows.groupBy("video_id", chunk_of(F.col("start")).alias("chunk")).agg(F.count("*").alias("n"), F.max("end").alias("last"))
    line = Window.partitionBy("video_id")
    before = F.coalesce(F.sum("n").over(line.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beside = [F.coalesce(step("chunk").over(line.orderBy("chunk")) == F.col("chunk") + d, F.lit(False)).alias(n) for n, step, d in (("prior", F.lag, -1), ("next", F.lead, 1))]
    return own.select("video_id", "chunk", before.alias("before"), F.max("last").over(line).alias("timeline_end"), *beside)


def _dealt(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """rows (with chunk) and the chunks' own rows together, dealt by video and chunk into as many partitions as the session says:
    windows multiply a chunk's text, so these aren't merged by the bytes of the segments alone."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(keyed, allowMissingColumns=True).repartition(n, "video_id", "chunk")


def _copied(rows: DataFrame, settings: Settings, beside: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Segments (home: their own chunk) with their copies for the other chunks whose windows reach them, and the chunks' own rows; likewise
    the rows beside them, and the videos' totals with the chunks' rows."""
    own, longest = chunk_of(F.col("start")), max(settings.lengths())
    reached = F.sequence(F.least(own, chunk_of(F.col("start") - longest)), F.least(own + MOST_CHUNKS, F.greatest(own, chunk_of(F.col("end")))))
    copies, keyed = rows.select("*", own.alias("home"), F.explode(reached).alias("chunk")), chunks(rows)
    if beside is not None and totals is not None:
        reach = max(settings.pause_min_s, settings.proximity_s) + 1.0
        near = F.sequence(chunk_of(F.col("start") - (longest + reach)), chunk_of(F.col("start") + reach))
        copies = copies.unionByName(beside.where("video_id IS NOT NULL AND start IS NOT NULL").select("*", F.explode(near).alias("chunk")), allowMissingColumns=True)
        keyed = keyed.join(totals, "video_id", "left")
    return _dealt(copies, keyed)


def candidate_windows(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every segment start with every length, if it fits the timeline: video_id, timeline_end, anchor (the segment's place in the
    order of start, seg_idx), start_s, len_idx, length, end_s."""
    rows = timed(segments).select("video_id", "seg_idx", "start", "end")
    both = _dealt(rows.select("video_id", chunk_of(F.col("start")).alias("chunk"), "start", "seg_idx"), chunks(rows))
    own = Window.partitionBy("video_id", "chunk")
    # The chunk's own row has no start and so comes first.
    placed = both.select("video_id", "start", (F.max("before").over(own) + F.row_number().over(own.orderBy("start", "seg_idx")) - 2).cast("int").alias("anchor"), F.max("timeline_end").over(own).alias("timeline_end"))
    spans = F.array(*[F.struct(F.lit(k).alias("len_idx"), F.lit(x).alias("length")) for k, x in enumerate(settings.lengths())])
    found = placed.where(F.col("start").isNotNull()).select("video_id", "timeline_end", "anchor", F.col("start").alias("start_s"), F.explode(spans).alias("x")).select("*", "x.*").drop("x")
    return found.withColumn("end_s", F.col("start_s") + F.col("length")).where(F.col("end_s") <= F.col("timeline_end") + 1e-9)


def anchored(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A row for each segment at which a window begins: video_id, chunk (the rows stay dealt by these two), timeline_end, anchor, start_s, inside (start and text of the
    segments that its longest window overlaps, in order)."""
    both, longest = _copied(timed(segments), settings), max(settings.lengths())
    here = Window.partitionBy("video_id", "chunk").orderBy("start", "seg_idx")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    is_seg = F.col("start").isNotNull()
    placed = both.withColumns({"pos": F.sum(is_seg.cast("int")).over(upto) - 1, "turn": F.sum((is_seg & (F.col("home") == F.col("chunk"))).cast("int")).over(upto) - 1, "passed": F.max("end").over(upto)})
    lo = F.lit(0)
    for k in reversed(LOOKBACK):
        lo = F.when(F.coalesce(F.lag("passed", k).over(here) <= F.col("start"), F.lit(True)), F.col("pos") - (k - 1)).otherwise(lo)
    hi = F.expr(f"count(start) OVER (PARTITION BY video_id, chunk ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND {longest!r}D FOLLOWING)").cast("int")
    placed = placed.withColumns({"lo": F.greatest(lo, F.lit(0)).cast("int"), "hi": hi})
    item = F.when(is_seg, F.struct("start", "seg_idx", "end", "text", "home", "turn", "lo", "hi"))
    packed = placed.groupBy("video_id", "chunk").agg(F.sort_array(F.collect_list(item)).alias("segs"), F.max("before").alias("before"), F.max("timeline_end").alias("timeline_end"))
    begins = F.filter("segs", lambda s: (s["home"] == F.col("chunk")) & (s["start"] + min(settings.lengths()) <= F.col("timeline_end") + 1e-9))

    def one(s: Column) -> Column:
        reach = F.filter(F.slice(F.col("segs"), s["lo"] + 1, s["hi"] - s["lo"]), lambda x: x["end"] > s["start"])
        inside = F.transform(reach, lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text")))
        return F.struct((F.col("before") + s["turn"]).cast("int").alias("anchor"), s["start"].alias("start_s"), inside.alias("inside"))

    return packed.select("video_id", "chunk", "timeline_end", F.explode(F.transform(begins, one)).alias("a")).select("video_id", "chunk", "timeline_end", "a.*")


def _ends(settings: Settings) -> Column:
    """The lengths of a row's windows that fit the timeline."""
    spans = F.array(*[F.struct(F.lit(k).alias("len_idx"), F.lit(x).alias("length")) for k, x in enumerate(settings.lengths())])
    ends = F.transform(spans, lambda x: F.struct(x["len_idx"].alias("len_idx"), x["length"].alias("length"), (F.col("start_s") + x["length"]).alias("end_s")))
    return F.filter(ends, lambda x: x["end_s"] <= F.col("timeline_end") + 1e-9)


def begun(segs: Column, end: Column) -> Column:
    """How many of segments in order of their starts begin before ``end``."""
    return F.size(F.filter(segs, lambda s: s["start"] < end))


def window_texts(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The candidate windows with the text of the segments that they overlap."""
    found = anchored(segments, settings)
    found = found.select("video_id", "timeline_end", "anchor", "start_s", "inside", F.explode(_ends(settings)).alias("x"))
    return found.select("video_id", "timeline_end", "anchor", "start_s", "x.*", joined_text(F.slice("inside", F.lit(1), begun(F.col("inside"), F.col("x.end_s")))).alias("text"))


def overlapping(segs: Column, start: Column, end: Column) -> Column:
    """Segments that overlap [start, end); touching edges don't count."""
    return F.filter(segs, lambda s: (s["start"] < end) & (s["end"] > start))


def joined_text(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["text"]), " ")


def window_text(windows: DataFrame) -> DataFrame:
    """windows with the text of ``segs``."""
    return windows.withColumn("text", joined_text(F.col("segs")))


def texts_inside(windows: DataFrame) -> DataFrame:
    """windows(start_s, end_s, segs) with ``segs`` cut to those that the window overlaps, and their text."""
    return window_text(windows.withColumn("segs", overlapping(F.col("segs"), F.col("start_s"), F.col("end_s"))))


SIGNALS = ("hook", "coherence", "sentiment", "specificity", "curiosity", "laughter")


def signals(rows: DataFrame, lexicon: tuple[str, ...] = EMOTION_WORDS) -> DataFrame:
    """The signals of column ``text``."""
    text = F.col("text")
    # The first sentence is computed once and read by two signals.
    head = T.let(T.first_sentence(text), lambda f: F.struct(T.hook_quality(f).alias("hook"), T.coherence(f).alias("coherence")))
    found = rows.withColumn("_head", head)
    made = (F.col("_head.hook"), F.col("_head.coherence"), T.sentiment(text, lexicon), T.specificity(text), T.curiosity(text), T.text_laughter(text))
    return found.select("*", *[x.alias(n) for n, x in zip(SIGNALS, made, strict=True)]).drop("_head")


def text_signals(rows: DataFrame, lexicon: tuple[str, ...] = EMOTION_WORDS) -> DataFrame:
    """The signals of column ``text``, as ``signals``, by batches."""
    kind = T_.StructType([*rows.schema.fields, *[T_.StructField(n, T_.DoubleType()) for n in SIGNALS]])
    return rows.mapInArrow(B.text_scorer(SIGNALS, tuple(lexicon)), kind)


def window_signals(segments: DataFrame, settings: Settings = DEFAULTS, lexicon: tuple[str, ...] = EMOTION_WORDS) -> DataFrame:
    """The candidate windows with the signals of their texts."""
    return _by_batch(segments, settings, lexicon, ", ".join(f"{n} double" for n in SIGNALS))


def _by_batch(segments: DataFrame, settings: Settings, lexicon: tuple[str, ...], values: str, finish=None, beside: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Windows with ``values``, which ``finish`` makes of their signals (see ``batches``). beside: rows (video_id, kind, start, end, a, b) that the windows
    need too; totals(video_id, max_count, confidence)."""
    rows = timed(segments)
    both, reach, more = _copied(rows, settings, beside, totals), None, []
    if beside is not None:
        reach, more = (settings.pause_min_s, settings.proximity_s), ["kind", "a", "b", "max_count", "confidence"]
    sorted_ = both.sortWithinPartitions("video_id", "chunk", "start", "seg_idx").select("video_id", "chunk", "home", "start", "end", "text", "before", "timeline_end", "prior", "next", *more)
    kind = rows.schema["video_id"].dataType.simpleString()
    return sorted_.mapInArrow(B.scorer(settings.lengths(), tuple(lexicon), finish, reach), f"video_id {kind}, chunk long, timeline_end double, anchor int, start_s double, len_idx int, length double, end_s double, {values}")


def content_score(settings: Settings = DEFAULTS, audio: bool = False) -> Column:
    """The weighted sum of the signals; with ``audio`` columns audio_energy, audio_laughter and audio_pause count."""
    w = settings.weights
    laugh = F.greatest("laughter", "audio_laughter") if audio else F.col("laughter")
    total = F.col("hook") * w.hook + F.col("coherence") * w.coherence + F.col("sentiment") * w.sentiment + F.col("specificity") * w.specificity + F.col("curiosity") * w.curiosity
    total = total + (F.col("audio_energy") * w.audio_energy if audio else F.lit(0.0)) + laugh * w.laughter + (F.col("audio_pause") * w.dramatic_pause if audio else F.lit(0.0))
    return T.clamp(total)


def audio_score(settings: Settings = DEFAULTS) -> Column:
    """The score without a transcript."""
    w = settings.audio_weights
    return T.clamp(F.col("audio_energy") * w.audio_energy + F.col("audio_laughter") * w.laughter + F.col("audio_pause") * w.dramatic_pause)


def scored_windows(segments: DataFrame, settings: Settings = DEFAULTS, least: float | None = None, beside: DataFrame | None = None, totals: DataFrame | None = None, thin: bool = False) -> DataFrame:
    """video_id, chunk, anchor, len_idx, start_s, end_s, timeline_end, score; with ``least`` only those that score as much. The score is
    that of the transcript alone, or with the audio and comments in ``beside`` (see ``_by_batch``) that of all. ``thin`` leaves those that the
    greedy walk may keep."""
    found = _by_batch(segments, settings, EMOTION_WORDS, "score double", partial(_scored, settings, least, thin), beside, totals)
    return found.select("video_id", "chunk", "anchor", "len_idx", "start_s", "end_s", "timeline_end", "score")


def _scored(settings: Settings, least: float | None, thin: bool, made: dict) -> dict:
    """Columns of windows with ``content_score``, rounded, in place of the signals."""
    w = settings.weights
    total = made["hook"] * w.hook + made["coherence"] * w.coherence + made["sentiment"] * w.sentiment + made["specificity"] * w.specificity + made["curiosity"] * w.curiosity
    audio = "audio_energy" in made
    total = total + (made["audio_energy"] * w.audio_energy if audio else 0.0)
    total = total + (np.maximum(made["laughter"], made["audio_laughter"]) if audio else made["laughter"]) * w.laughter
    score = np.clip(total + (made["audio_pause"] * w.dramatic_pause if audio else 0.0), 0.0, 1.0)
    if audio:  # without comments the confidence is 0
        multiplier = np.where(made["sponsored"] > settings.sponsor_ratio, settings.sponsor_multiplier, 1.0)
        score = np.clip((made["social"] * made["confidence"] + score * (1.0 - made["confidence"])) * multiplier, 0.0, 1.0)
    score = B.rounded(score, 9)
    kept = np.flatnonzero(score >= least) if least is not None else np.arange(len(score))
    if thin:
        kept = kept[np.lexsort(tuple(x[kept] for x in (made["len_idx"], made["anchor"], made["start_s"], -score, made["group"])))]
        begin = made["chunk"][kept] * CHUNK_S
        begins, ends = np.where(made["prior"][kept], begin, -np.inf), np.where(made["next"][kept], begin + CHUNK_S, np.inf)
        kept = kept[B.contenders(made["group"][kept], made["start_s"][kept], made["end_s"][kept], begins, ends, settings.top_k, max(settings.lengths()))]
    names = ("video_id", "chunk", "timeline_end", "anchor", "start_s", "len_idx", "length", "end_s")
    return {n: made[n] if n == "video_id" else made[n][kept] for n in names} | {"row": made["row"][kept], "score": score[kept]}


def best(segments: DataFrame, settings: Settings = DEFAULTS, beside: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` best disjoint windows of each video that score ``min_clip_score`` at least."""
    return select_moments(scored_windows(segments, settings, settings.min_clip_score, beside, totals, thin=True), settings.top_k)


def selected(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The ``top_k`` best disjoint windows of each video, of windows with their ``chunk``."""
    return select_moments(scored, settings.top_k, longest=max(settings.lengths()), span=CHUNK_S)
