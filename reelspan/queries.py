"""The engine's queries over the driver's tables, with the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan import oracle as O
from reelspan.functions import text as T
from reelspan.operators import audio as A
from reelspan.operators import captions as K
from reelspan.operators import jobs as J
from reelspan.operators import quality as Q
from reelspan.operators import refine as R
from reelspan.operators import render as V
from reelspan.operators import report as P
from reelspan.operators import social as C
from reelspan.operators import windows as W
from reelspan.plans import detect as D
from reelspan.settings import DEFAULTS, STAGES, TRANSITIONS
from reelspan.sources import adapters as X
from reelspan.sources import stores as B

#: The driver's invented prose seldom reaches the default threshold.
CORPUS = DEFAULTS.overlay({"min_clip_score": 0.40, "sponsor_keywords": ["purchase"]})
LEXICON = ("the", "and", "das", "que", "les", "for")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", "text")


# Text signals


@query(f"SELECT doc_id, {O.first_sentence('text')} AS first FROM documents")
def first_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text")).alias("first"))


@query(f"SELECT doc_id, round({O.hook('f')}, 6) AS hook, round({O.coherence('f')}, 6) AS coherence FROM (SELECT doc_id, {O.first_sentence('text')} AS f FROM documents)")
def hook_and_coherence(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("f", T.first_sentence(F.col("text")))
    return rows.select("doc_id", r6(T.hook_quality(F.col("f"))).alias("hook"), r6(T.coherence(F.col("f"))).alias("coherence"))


@query(f"SELECT doc_id, round({O.sentiment('text')}, 6) AS sentiment, round({O.sentiment('text', LEXICON)}, 6) AS corpus_sentiment FROM documents")
def sentiment(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", r6(T.sentiment(F.col("text"))).alias("sentiment"), r6(T.sentiment(F.col("text"), LEXICON)).alias("corpus_sentiment"))


@query(f"SELECT doc_id, round({O.specificity('text')}, 6) AS specificity, len({O.capitalised('text')})::BIGINT AS terms FROM documents")
def specificity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", r6(T.specificity(F.col("text"))).alias("specificity"), F.size(T.capitalised_terms(F.col("text"))).cast("long").alias("terms"))


@query(f"SELECT doc_id, round({O.curiosity('text')}, 6) AS curiosity, round({O.laughter('text')}, 6) AS laughter FROM documents")
def curiosity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", r6(T.curiosity(F.col("text"))).alias("curiosity"), r6(T.text_laughter(F.col("text"))).alias("laughter"))


# Comments


@query(O.sql(O.COMMENTS, "SELECT comment_id, video_id, ts FROM men"))
def parse_timestamps(spark, sf_dir):
    return X.event_comments(spark, sf_dir).select("comment_id", "video_id", F.explode("timestamps").alias("ts"))


@query(O.sql(O.COMMENTS, "SELECT c.video_id, count(m.ts) AS mentions, count(DISTINCT c.comment_id) AS comments, count(DISTINCT CASE WHEN contains(c.text, 'purchase') THEN c.comment_id END) AS sponsored, round(CASE WHEN count(m.ts) = 0 THEN 0 ELSE least(0.65::DOUBLE, 0.2::DOUBLE + count(m.ts) / 50.0::DOUBLE * 0.45::DOUBLE) END, 6) AS confidence FROM com c LEFT JOIN men m USING (comment_id, video_id) GROUP BY c.video_id"))
def mention_totals(spark, sf_dir):
    rows = X.event_comments(spark, sf_dir).groupBy("video_id").agg(F.sum(F.size("timestamps")).alias("mentions"), F.count("*").alias("comments"), F.count_if(T.contains_any(F.col("text"), CORPUS.sponsor_keywords)).alias("sponsored"))
    return rows.withColumn("confidence", r6(C.confidence(F.col("mentions"))))


@query(O.sql(O.CLUSTERS, "SELECT video_id, round(center_s, 6) AS center_s, start_s, end_s, count FROM clu", True))
def timestamp_clusters(spark, sf_dir):
    return C.clusters(X.event_comments(spark, sf_dir)).withColumn("center_s", r6("center_s"))


@query(O.sql(O.CLUSTERS, "SELECT video_id, round(center_s, 6) AS center_s, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY count DESC, start_s) AS rank FROM clu) WHERE rank <= 3", True))
def top_clusters(spark, sf_dir):
    order = Window.partitionBy("video_id").orderBy(F.desc("count"), "start_s")
    return C.clusters(X.event_comments(spark, sf_dir)).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("video_id", r6("center_s").alias("center_s"), "count", "rank")


def _grid(comments: DataFrame) -> DataFrame:
    """Windows of 20 seconds end to end, up to the last second that a comment of the video names."""
    last = comments.groupBy("video_id").agg(F.coalesce(F.max(F.array_max("timestamps")), F.lit(0)).alias("last"))
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.col("last") / 20).cast("int")), lambda k: k * 20.0)
    return last.select("video_id", F.explode(starts).alias("start_s")).withColumn("end_s", F.col("start_s") + 20.0)


@query(O.sql(O.CLUSTERS + "," + O.GRID, "SELECT g.video_id, g.start_s, round(least(1.0::DOUBLE, coalesce(max(c.count), 0)::DOUBLE / any_value(m.most)), 6) AS social FROM grid g LEFT JOIN clu c ON c.video_id = g.video_id AND c.center_s BETWEEN g.start_s AND g.end_s LEFT JOIN (SELECT video_id, max(count) AS most FROM clu GROUP BY 1) m ON m.video_id = g.video_id GROUP BY g.video_id, g.start_s", True))
def social_scores(spark, sf_dir):
    comments = X.event_comments(spark, sf_dir)
    return C.with_social(_grid(comments), comments, CORPUS).select("video_id", "start_s", r6("social").alias("social"))


@query(O.sql(O.COMMENTS + "," + O.GRID, "SELECT video_id, start_s, CASE WHEN n > 0 AND s::DOUBLE / n > 0.3 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM (SELECT g.video_id, g.start_s, count(DISTINCT m.comment_id) AS n, count(DISTINCT CASE WHEN contains(m.text, 'purchase') THEN m.comment_id END) AS s FROM grid g LEFT JOIN men m ON m.video_id = g.video_id AND m.ts BETWEEN g.start_s - 5 AND g.end_s + 5 GROUP BY ALL)"))
def sponsor_multiplier(spark, sf_dir):
    comments = X.event_comments(spark, sf_dir)
    return C.with_social(_grid(comments), comments, CORPUS).select("video_id", "start_s", "multiplier")


# Windows and detection


@query(O.sql(O.SEGMENTS, 'SELECT video_id, seg_idx, start, "end", text FROM seg'))
def transcript_segments(spark, sf_dir):
    return X.document_segments(spark, sf_dir)


@query(O.sql(O.WINDOWS, "SELECT video_id, anchor, len_idx, start_s, end_s FROM win"))
def candidate_windows(spark, sf_dir):
    return W.candidate_windows(X.document_segments(spark, sf_dir)).select("video_id", "anchor", "len_idx", "start_s", "end_s")


@query(O.sql(O.WINDOW_TEXT, "SELECT video_id, anchor, len_idx, md5(text) AS text_md5 FROM wt"))
def window_text(spark, sf_dir):
    rows = W.window_texts(X.document_segments(spark, sf_dir))
    return rows.select("video_id", "anchor", "len_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(O.sql(O.SCORED, "SELECT video_id, anchor, len_idx, round(hook, 6) AS hook, round(coherence, 6) AS coherence, round(sentiment, 6) AS sentiment, round(specificity, 6) AS specificity, round(curiosity, 6) AS curiosity, round(laughter, 6) AS laughter FROM ws"))
def window_signals(spark, sf_dir):
    rows = W.window_signals(X.document_segments(spark, sf_dir))
    return rows.select("video_id", "anchor", "len_idx", *[r6(n).alias(n) for n in W.SIGNALS])


@query(O.sql(O.SCORED, "SELECT video_id, anchor, len_idx, start_s, end_s, round(score, 6) AS score FROM sc"))
def content_scores(spark, sf_dir):
    rows = W.scored_windows(X.document_segments(spark, sf_dir))
    return rows.select("video_id", "anchor", "len_idx", "start_s", "end_s", r6("score").alias("score"))


_PICKED = O.SCORED + """,
src AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, anchor, len_idx) AS n FROM sc WHERE score >= 0.40)"""


@query(O.sql(_PICKED + "," + O.greedy("src", 6, "nms"), "SELECT s.video_id, row_number() OVER (PARTITION BY s.video_id ORDER BY s.n)::INTEGER AS rank, s.start_s, s.end_s, round(s.score, 6) AS score FROM nms JOIN src s USING (video_id, n)", True))
def top_moments(spark, sf_dir):
    """The best six disjoint windows of each document by its transcript."""
    return W.best(X.document_segments(spark, sf_dir), CORPUS).select("video_id", "rank", "start_s", "end_s", r6("score").alias("score"))


_REFINED = _PICKED + "," + O.greedy("src", 6, "nms") + f""",
top AS (SELECT s.* FROM nms JOIN src s USING (video_id, n)),
lag_ AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY start, seg_idx) AS prev FROM sego),
sa AS (SELECT t.video_id, t.n, min_by(s.start, {{'c': CASE WHEN s.anchor = 0 OR {O.ends_sentence('s.prev')} THEN 0 ELSE 1 END, 'd': abs(s.start - t.start_s), 'i': s.anchor}}) AS v FROM top t JOIN lag_ s ON s.video_id = t.video_id AND abs(s.start - t.start_s) <= 10 GROUP BY ALL),
se AS (SELECT t.video_id, t.n, min_by(s."end", {{'c': CASE WHEN {O.ends_sentence('s.text')} THEN 0 ELSE 1 END, 'd': abs(s."end" - t.end_s), 'i': s.anchor}}) AS v FROM top t JOIN lag_ s ON s.video_id = t.video_id AND abs(s."end" - t.end_s) <= 10 GROUP BY ALL),
ref0 AS (SELECT t.*, CASE WHEN coalesce(sa.v, 0) = 0 THEN t.start_s ELSE sa.v END AS a, CASE WHEN coalesce(se.v, 0) = 0 THEN t.end_s ELSE se.v END AS e0 FROM top t LEFT JOIN sa USING (video_id, n) LEFT JOIN se USING (video_id, n)),
lau AS (SELECT r.video_id, r.n, min_by(s."end", s.anchor) AS v FROM ref0 r JOIN lag_ s ON s.video_id = r.video_id AND s.start - r.e0 >= 0 AND s.start - r.e0 <= 3 AND regexp_matches(s.text, '{O.S.REACTION_PATTERN}') GROUP BY ALL),
ref1 AS (SELECT r.*, greatest(0, a) AS ca, least(timeline_end, coalesce(lau.v + 1.5, e0)) AS ce FROM ref0 r LEFT JOIN lau USING (video_id, n)),
ref2 AS (SELECT *, CASE WHEN ce <= ca THEN start_s ELSE ca END AS ra, CASE WHEN ce <= ca THEN end_s ELSE ce END AS re FROM ref1),
ref AS (SELECT video_id, n, anchor, len_idx, start_s AS raw_start_s, end_s AS raw_end_s, ra AS start_s, least(re, ra + 60) AS end_s FROM ref2)"""


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = X.document_segments(spark, sf_dir)
    lines = W.timeline(segments)
    return R.refine(W.best(segments, CORPUS), lines, CORPUS)


@query(O.sql(_REFINED, "SELECT video_id, raw_start_s, raw_end_s, start_s, end_s FROM ref", True))
def refined_boundaries(spark, sf_dir):
    return _refined(spark, sf_dir).select("video_id", "raw_start_s", "raw_end_s", "start_s", "end_s")


_FINAL = _REFINED + f""",
rt AS (SELECT r.video_id, r.n AS n0, any_value(r.anchor) AS anchor, any_value(r.len_idx) AS len_idx, any_value(r.start_s) AS start_s, any_value(r.end_s) AS end_s, coalesce(string_agg(s.text, ' ' ORDER BY s.start, s.seg_idx), '') AS text FROM ref r LEFT JOIN seg s ON s.video_id = r.video_id AND s.start < r.end_s AND s."end" > r.start_s GROUP BY r.video_id, r.n),
rf AS (SELECT *, {O.first_sentence('text')} AS f FROM rt),
rs AS (SELECT *, {O.signal_columns('text', 'f')} FROM rf),
fin0 AS (SELECT video_id, n0, anchor, len_idx, start_s, end_s, round({O.content()}, 9) AS score FROM rs),
fin AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, n0) AS n FROM fin0),""" + O.greedy("fin", 3, "last_")


@query(O.sql(_FINAL, "SELECT f.video_id, row_number() OVER (PARTITION BY f.video_id ORDER BY f.n)::INTEGER AS rank, f.start_s, f.end_s, round(f.score, 6) AS score FROM last_ JOIN fin f USING (video_id, n)", True))
def final_moments(spark, sf_dir):
    """The whole detection by transcripts: at most three refined moments a document."""
    return D.detect(X.document_segments(spark, sf_dir), settings=CORPUS).withColumn("score", r6("score"))


_TAIL = _REFINED[len(_PICKED + "," + O.greedy("src", 6, "nms")) :]
_FULL = ",".join(
    [
        O.SCORED, O.CLUSTERS, O.GAPS, O.audio_features("ws", "wa"), f"\nwc AS (SELECT video_id, anchor, len_idx, start_s, end_s, timeline_end, {O.full_content()} AS content FROM wa)", O.social_fused("wc", "full_", "purchase"),
        "\nsrc AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, anchor, len_idx) AS n FROM full_ WHERE score >= 0.2)", O.greedy("src", 6, "nms"),
    ]
) + _TAIL + _FINAL[len(_REFINED) : _FINAL.index("\nfin0 AS")] + ",".join(
    [
        O.audio_features("rs", "ra"), f"\nrc AS (SELECT video_id, n0, anchor, len_idx, start_s, end_s, {O.full_content()} AS content FROM ra)", O.social_fused("rc", "fin0", "purchase"),
        "\nfin AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, n0) AS n FROM fin0)", O.greedy("fin", 3, "last_"), O.audio_final("purchase", "video_id NOT IN (SELECT video_id FROM seg)"),
    ]
)
_RANKED = "SELECT f.video_id, row_number() OVER (PARTITION BY f.video_id ORDER BY f.n)::INTEGER AS rank, f.start_s, f.end_s, round(f.score, 6) AS score FROM {} JOIN {} f USING (video_id, n)"


@query(O.sql(_FULL, _RANKED.format("last_", "fin") + " UNION ALL " + _RANKED.format("alast", "afin"), True))
def detect_full(spark, sf_dir):
    """Detection by transcripts, comments and audio; ids that are both a document's and a user's have all three."""
    low = replace(CORPUS, min_clip_score=0.2)
    return D.detect(X.document_segments(spark, sf_dir), X.event_comments(spark, sf_dir), X.event_frames(spark, sf_dir), low).withColumn("score", r6("score"))


@query(O.sql(O.GAPS + "," + O.audio_final(), "SELECT f.video_id, row_number() OVER (PARTITION BY f.video_id ORDER BY f.n)::INTEGER AS rank, f.start_s, f.end_s, round(f.score, 6) AS score FROM alast JOIN afin f USING (video_id, n)", True))
def detect_audio_only(spark, sf_dir):
    return D.detect_audio(X.event_frames(spark, sf_dir), None, replace(CORPUS, min_clip_score=0.2)).withColumn("score", r6("score"))


@query(O.sql(_FINAL.replace(O.SEGMENTS, O.TURNS).replace("score >= 0.40", "score >= 0.2"), "SELECT f.video_id, row_number() OVER (PARTITION BY f.video_id ORDER BY f.n)::INTEGER AS rank, f.start_s, f.end_s, round(f.score, 6) AS score FROM last_ JOIN fin f USING (video_id, n)", True))
def detect_conversations(spark, sf_dir):
    return D.detect(X.conversation_segments(spark, sf_dir), settings=replace(CORPUS, min_clip_score=0.2)).withColumn("score", r6("score"))


_SPANS = O.SEGMENTS + f""",
sp0 AS (SELECT video_id, min_by(start, {{'s': start, 'i': seg_idx}}) AS start_s, max_by("end", {{'s': start, 'i': seg_idx}}) AS end_s FROM seg GROUP BY video_id),
sp1 AS (SELECT p.video_id, any_value(start_s) AS start_s, any_value(end_s) AS end_s, coalesce(string_agg(s.text, ' ' ORDER BY s.start, s.seg_idx), '') AS text FROM sp0 p LEFT JOIN seg s ON s.video_id = p.video_id AND s.start < p.end_s AND s."end" > p.start_s GROUP BY p.video_id),
sp2 AS (SELECT *, {O.first_sentence('text')} AS f FROM sp1), sp3 AS (SELECT *, {O.signal_columns('text', 'f')} FROM sp2)"""


@query(O.sql(_SPANS, f"SELECT video_id, start_s, end_s, round(round({O.content()}, 9), 6) AS score FROM sp3"))
def span_scores(spark, sf_dir):
    return D.score_window(X.document_segments(spark, sf_dir)).withColumn("score", r6("score"))


# Audio


GRID_S = 40.0


def _audio_grid(frames: DataFrame) -> DataFrame:
    """Windows of GRID_S end to end, as far as a frame lies in them."""
    ends = frames.groupBy("video_id").agg(F.max("t").alias("last_t"))
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.col("last_t") / GRID_S).cast("int")), lambda k: k * GRID_S)
    rows = ends.select("video_id", "last_t", F.explode(starts).alias("start_s")).where("start_s <= last_t")
    return rows.select("video_id", "start_s", (F.col("start_s") + GRID_S).alias("end_s"))


@query(O.sql(O.AUDIO_GRID, "SELECT g.video_id, g.start_s, round(greatest(0, least(1, coalesce(avg(f.energy), 0))), 6) AS audio_energy, round(greatest(0, least(1, coalesce(avg(f.energy * f.zcr), 0))), 6) AS audio_laughter, round(least(1.0::DOUBLE, (SELECT count(*) FROM gap p WHERE p.video_id = g.video_id AND p.mid >= g.start_s - 0.6 AND p.mid < g.end_s) / 3.0::DOUBLE), 6) AS audio_pause FROM agrid g LEFT JOIN fr f ON f.video_id = g.video_id AND f.t >= g.start_s AND f.t < g.end_s GROUP BY g.video_id, g.start_s, g.end_s"))
def audio_by_window(spark, sf_dir):
    frames = X.event_frames(spark, sf_dir)
    rows = A.window_features(_audio_grid(frames), frames, A.silence_gaps(frames))
    return rows.select("video_id", "start_s", r6("audio_energy").alias("audio_energy"), r6("audio_laughter").alias("audio_laughter"), r6("audio_pause").alias("audio_pause"))


@query(O.sql(O.GAPS, "SELECT video_id, gap_start, gap_end, mid FROM gap"))
def silence_gaps(spark, sf_dir):
    return A.silence_gaps(X.event_frames(spark, sf_dir))


@query(O.sql(O.AUDIO_GRID, "SELECT g.video_id, g.start_s, coalesce(min_by(p.mid, {'d': abs(p.mid - g.start_s), 'm': p.mid}), g.start_s) AS silence FROM agrid g LEFT JOIN gap p ON p.video_id = g.video_id AND p.mid >= greatest(0, g.start_s - 10) AND p.mid < g.start_s + 10 GROUP BY g.video_id, g.start_s"))
def nearest_silence(spark, sf_dir):
    frames = X.event_frames(spark, sf_dir)
    grid = _audio_grid(frames).withColumn("part", F.floor(F.col("start_s") / GRID_S))
    rows = grid.join(A.mids_by_part(A.silence_gaps(frames), GRID_S), ["video_id", "part"], "left")
    return rows.select("video_id", "start_s", R.nearest_silence(F.coalesce("mids", F.array().cast("array<double>")), F.col("start_s"), 10.0).alias("silence"))


_SECONDS = O.FRAMES + """,
sec AS (SELECT s.video_id, s.second::INTEGER AS second, coalesce(e.energy, 0) AS energy FROM (SELECT video_id, unnest(range(floor(max(t))::BIGINT + 1)) AS second FROM fr GROUP BY video_id) s
  LEFT JOIN (SELECT video_id, floor(t)::BIGINT AS second, avg(energy) AS energy FROM fr GROUP BY ALL) e ON e.video_id = s.video_id AND e.second = s.second)"""


@query(O.sql(_SECONDS, "SELECT video_id, second, round(energy, 6) AS energy FROM sec"))
def per_second_energy(spark, sf_dir):
    return A.per_second(X.event_frames(spark, sf_dir)).withColumn("energy", r6("energy"))


@query("""WITH h AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, (event_id * 37 % 401 - 200) * 50 AS v FROM events WHERE user_id IS NOT NULL),
s AS (SELECT video_id, k, v FROM h UNION ALL SELECT video_id, max(k) + 1, NULL FROM h GROUP BY video_id),
f AS (SELECT video_id, k, v, lag(v, 2) OVER w AS a, lag(v, 1) OVER w AS b, lead(v, 1) OVER w AS d, first_value(v) OVER w AS first FROM s WINDOW w AS (PARTITION BY video_id ORDER BY k)),
g AS (SELECT *, coalesce(a, first) < 0 AS na, coalesce(b, first) < 0 AS nb FROM f),
e AS (SELECT *, coalesce(v < 0, nb) AS nv, coalesce(d < 0, v < 0, nb) AS nd FROM g)
SELECT video_id, k::INTEGER AS frame_idx, k * 512 / 16000.0::DOUBLE AS t,
  round(sqrt((coalesce(a * a, 0) + coalesce(b * b, 0) + coalesce(v * v, 0) + coalesce(d * d, 0)) / 4.0::DOUBLE) / 32768, 9) AS rms,
  ((na <> nb)::INTEGER + (nb <> nv)::INTEGER + (nv <> nd)::INTEGER) / 2048.0::DOUBLE AS zcr FROM e""")
def recording_frames(spark, sf_dir):
    """Recordings, one a user with a hop of equal samples for each event, written and then read back as frames by ranges."""
    from reelspan.sources import recordings
    from reelspan.sources.stores import shared_folder

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = X.table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    word = F.pmod((F.col("event_id") * 37 % 401 - 200) * 50, F.lit(65536))
    raw = F.unhex(F.repeat(F.concat(F.lpad(F.hex(word % 256), 2, "0"), F.lpad(F.hex(F.floor(word / 256)), 2, "0")), A.HOP))
    parts = events.select(F.col("user_id").alias("video_id"), F.row_number().over(w).cast("long").alias("part"), raw.alias("pcm"))
    folder = f"{shared_folder(spark).rstrip('/')}/recordings-{uuid.uuid4().hex}"
    recordings.write_recordings(parts, f"{folder}/wav").write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    rows = recordings.frames(recordings.headers(files)).join(files, "path")
    return rows.select("video_id", "frame_idx", "t", F.round("rms", 9).alias("rms"), "zcr")


@query(O.sql(_SECONDS + ", base AS (SELECT video_id, coalesce(median(CASE WHEN energy > 0 THEN energy END), 0) AS baseline FROM sec GROUP BY video_id)", "SELECT video_id, second, rank, round(energy, 6) AS energy, round(CASE WHEN baseline = 0 THEN 0 ELSE energy / baseline END, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY energy DESC, second)::INTEGER AS rank FROM sec) JOIN base USING (video_id) WHERE rank <= 5"))
def loudest_seconds(spark, sf_dir):
    seconds = A.per_second(X.event_frames(spark, sf_dir))
    order = Window.partitionBy("video_id").orderBy(F.desc("energy"), "second")
    rows = seconds.withColumn("rank", F.row_number().over(order)).where("rank <= 5").join(A.baselines(seconds), "video_id")
    return rows.select("video_id", "second", "rank", r6("energy").alias("energy"), r6(A.ratio(F.col("energy"), F.col("baseline"))).alias("ratio"))


# Captions


@query(O.sql(O.WORDS, "SELECT video_id, line_no, start_s, end_s, text FROM lin"))
def caption_lines(spark, sf_dir):
    return K.caption_lines(X.document_words(spark, sf_dir)).select("video_id", "line_no", "start_s", "end_s", "text")


@query(O.sql(O.WORDS, f"SELECT video_id, line_no, line_no::VARCHAR || chr(10) || {O.srt_time('start_s')} || ' --> ' || {O.srt_time('end_s')} || chr(10) || text AS block FROM lin"))
def srt_blocks(spark, sf_dir):
    return K.srt(K.caption_lines(X.document_words(spark, sf_dir)))


@query(O.sql(O.SEGMENTS, f"""SELECT video_id, (seg_idx + 1)::INTEGER AS line_no, (seg_idx + 1)::VARCHAR || chr(10) || {O.srt_time('start')} || ' --> ' || {O.srt_time('"end"')} || chr(10) || {O.strip('text')} AS block FROM seg WHERE {O.strip('text')} <> ''"""))
def segment_srt(spark, sf_dir):
    return K.segment_srt(X.document_segments(spark, sf_dir))


@query("SELECT event_id, " + O.srt_time("value") + " AS srt, printf('%02d:%02d', CAST(trunc(greatest(value, 0)) AS BIGINT) // 60, CAST(trunc(greatest(value, 0)) AS BIGINT) % 60) AS clock FROM events")
def srt_timestamp(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", T.srt_time(F.col("value")).alias("srt"), T.clock(F.greatest("value", F.lit(0.0))).alias("clock"))


_SPEECH = O.SEGMENTS + f""",
sw0 AS (SELECT video_id, seg_idx, start, unnest(range(len(w))) AS i, unnest(w) AS word FROM (SELECT *, {O.tokens('text')} AS w FROM seg)),
sw AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, i) - 1)::INTEGER AS word_idx, word, start + i * 0.5::DOUBLE AS start, start + (i + 1) * 0.5::DOUBLE AS "end" FROM sw0 WHERE length(word) < 9)"""


@query(O.sql(_SPEECH, 'SELECT video_id, word_idx, word, start, "end" FROM sw'))
def speech_words(spark, sf_dir):
    """Timed words of a speech model's nested output."""
    return B.whisper_words(X.document_speech(spark, sf_dir))


@query(O.sql(_SPEECH, 'SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY k)::INTEGER AS line_no, start_s, end_s, text FROM (SELECT video_id, word_idx // 4 AS k, min(start) AS start_s, max("end") AS end_s, string_agg(word, $$ $$ ORDER BY word_idx) AS text FROM sw GROUP BY ALL)'))
def speech_captions(spark, sf_dir):
    return K.caption_lines(B.whisper_words(X.document_speech(spark, sf_dir)), per_line=4).select("video_id", "line_no", "start_s", "end_s", "text")


# Jobs


@query(O.sql(O.JOBS, "SELECT id, submitted_at FROM job WHERE state = 'queued' ORDER BY submitted_at, id LIMIT 1"))
def next_job(spark, sf_dir):
    return J.next_job(X.order_jobs(spark, sf_dir)).select("id", "submitted_at")


@query(O.sql(O.JOBS, "SELECT id, submitted_at, row_number() OVER (ORDER BY submitted_at, id) AS position FROM job WHERE state = 'queued'"))
def queue_positions(spark, sf_dir):
    return J.queue_positions(X.order_jobs(spark, sf_dir))


_INDEX = "coalesce(list_position(['downloading', 'detecting', 'editing', 'captioning', 'formatting'], last_stage_completed), 0)::BIGINT"


@query(O.sql(O.JOBS, f"SELECT id, state, {_INDEX} AS resume_index FROM job WHERE state NOT IN ('complete', 'failed', 'cancelled', 'queued')"))
def resumable_jobs(spark, sf_dir):
    return J.resume_index(J.resumable(X.order_jobs(spark, sf_dir))).select("id", "state", F.col("resume_index").cast("long").alias("resume_index"))


@query(O.sql(O.JOBS, f"SELECT id, (k - {_INDEX})::INTEGER AS step, ['downloading', 'detecting', 'editing', 'captioning', 'formatting'][k + 1] AS stage FROM job, (SELECT unnest(range(5)) AS k) WHERE state = 'downloading' AND k >= {_INDEX}"))
def pending_stages(spark, sf_dir):
    return J.pending_stages(X.order_jobs(spark, sf_dir))


@query(O.sql(O.JOBS + "," + O.CLIPS, "SELECT id, state, CASE state WHEN 'queued' THEN 5 WHEN 'downloading' THEN 33 WHEN 'complete' THEN 100 ELSE 0 END AS progress, CASE state WHEN 'queued' THEN 'Queued…' WHEN 'downloading' THEN 'Downloading video…' ELSE 'Done!' END AS label, count(job_id) AS clip_count FROM job LEFT JOIN clip ON job_id = id GROUP BY id, state"))
def job_status(spark, sf_dir):
    return J.job_status(X.order_jobs(spark, sf_dir), X.line_clips(spark, sf_dir))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in TRANSITIONS.items() for b in to)


@query(O.sql(O.JOBS, f"SELECT a.id, a.state AS from_state, t.s AS to_state, (a.state, t.s) IN ({_LEGAL}) AS legal FROM job a, (SELECT unnest({list(TRANSITIONS)}) AS s) t"))
def transitions(spark, sf_dir):
    rows = X.order_jobs(spark, sf_dir).select("id", F.col("state").alias("from_state"), F.explode(F.array(*[F.lit(x) for x in TRANSITIONS])).alias("to_state"))
    return rows.withColumn("legal", J.legal(F.col("from_state"), F.col("to_state")))


_NEXT = ["downloading", "detecting", "editing", "captioning", "formatting", "complete", "queued"]
#: Events of an order's job: it is queued, then each of its lines asks for a state.
_EVENTS = f"""
ev0 AS (SELECT o_orderkey AS id, 0::BIGINT AS number, 'queued' AS state FROM orders UNION ALL SELECT l_orderkey, l_linenumber::BIGINT,
  CASE WHEN l_quantity < 4 THEN 'cancelled' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'failed' ELSE {_NEXT}[l_linenumber] END FROM lineitem),
ev AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY number, state) AS n FROM ev0),
leg AS (SELECT unnest([{", ".join(f"{{'a': {repr(a) if a else 'NULL'}, 'b': '{b}'}}" for a, to in {"": ("queued",), **TRANSITIONS}.items() for b in to)}], recursive := true)),
fol AS (SELECT id, 1::BIGINT AS n, NULL::VARCHAR AS state, NULL::VARCHAR AS last_stage_completed, 0 AS retry_count, 0 AS refused, -1::BIGINT AS number FROM (SELECT DISTINCT id FROM ev)
  UNION ALL SELECT f.id, f.n + 1, CASE WHEN e.number <= f.number OR l.b IS NULL THEN f.state ELSE e.state END,
    CASE WHEN e.number > f.number AND l.b IS NOT NULL AND list_contains({list(STAGES)}, f.state) AND (list_contains({list(STAGES)}, e.state) OR e.state = 'complete') THEN f.state ELSE f.last_stage_completed END,
    f.retry_count + CASE WHEN e.number > f.number AND l.b IS NOT NULL AND f.state = 'failed' THEN 1 ELSE 0 END,
    f.refused + CASE WHEN e.number > f.number AND l.b IS NULL THEN 1 ELSE 0 END, greatest(f.number, e.number)
  FROM fol f JOIN ev e ON e.id = f.id AND e.n = f.n LEFT JOIN leg l ON l.a IS NOT DISTINCT FROM f.state AND l.b = e.state)"""


@query(O.sql(_EVENTS, "SELECT id, max_by(state, n) AS state, max_by(last_stage_completed, n) AS last_stage_completed, max_by(retry_count, n)::INTEGER AS retry_count, max_by(refused, n)::INTEGER AS refused, max(number) AS number FROM fol GROUP BY id", True).replace("max_by(state, n)", "arg_max_null(state, n)").replace("max_by(last_stage_completed, n)", "arg_max_null(last_stage_completed, n)"))
def job_states(spark, sf_dir):
    """Each job's last state by the stream of its transitions: two batches, the query started anew from its checkpoint between them."""
    from reelspan.sources.stores import shared_folder
    from reelspan.streaming import states

    line = F.when(F.col("l_quantity") < 4, "cancelled").when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0), "failed").otherwise(F.get(F.array(*[F.lit(x) for x in _NEXT]), F.col("l_linenumber").cast("int") - 1))
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("number"), line.alias("state"))
    events = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lit(0).cast("long").alias("number"), F.lit("queued").alias("state")).unionByName(lines)
    folder = f"{shared_folder(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    for part in (events.where("number <= 2"), events.where("number > 2")):
        part.write.mode("append").parquet(f"{folder}/events")
        states.follow(spark, f"{folder}/events", f"{folder}/checkpoint", f"{folder}/sink").awaitTermination()
    return states.latest(spark, f"{folder}/sink")


@query(O.sql(O.CLIPS, "SELECT job_id, count(*) FILTER (flag <> 'R') AS eligible, count(*) FILTER (flag = 'A') AS succeeded, count(*) FILTER (flag <> 'R') > 0 AND count(*) FILTER (flag = 'A') = 0 AS fails FROM clip GROUP BY job_id"))
def failing_jobs(spark, sf_dir):
    rows = X.line_clips(spark, sf_dir)
    return J.jobs_that_fail(rows.select("job_id", (F.col("flag") != "R").alias("eligible"), (F.col("flag") == "A").alias("succeeded")))


@query(O.sql(O.CLIPS, "SELECT job_id, clip_no, CASE flag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status, CASE flag WHEN 'R' THEN 'returned' END AS error FROM clip"))
def post_outcomes(spark, sf_dir):
    rows = X.line_clips(spark, sf_dir).select(F.concat_ws("/", "job_id", "clip_no", "start_s", "flag").alias("id"), "job_id", "clip_no", "flag")
    posts = rows.select("id", "job_id", "clip_no", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("posted_at"), F.lit(None).cast("string").alias("post_url"), F.lit(None).cast("string").alias("error"))
    done = rows.where("flag <> 'N'").select("id", F.lit(None).cast("string").alias("post_url"), F.when(F.col("flag") == "R", "returned").alias("error"), F.lit(None).cast("timestamp").alias("at")).distinct()
    return J.post_outcomes(posts, done).select("job_id", "clip_no", "status", "error")


# Reports


def _doc_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("video_id"), F.lit(8.0).alias("start_s"), F.lit(20.0).alias("end_s"))
    return rows


@query(O.sql(O.SEGMENTS, """SELECT d.doc_id AS video_id, substr(trim(coalesce(string_agg(s.text, ' ' ORDER BY s.start, s.seg_idx), '')), 1, 200) AS snippet FROM documents d LEFT JOIN seg s ON s.video_id = d.doc_id AND s.start < 20 AND s."end" > 8 GROUP BY d.doc_id"""))
def clip_snippets(spark, sf_dir):
    return D.snippets(_doc_clips(spark, sf_dir), X.document_segments(spark, sf_dir)).select("video_id", "snippet")


@query(O.sql(O.CLIPS + """,
chk AS (SELECT job_id, unnest([CASE WHEN score BETWEEN 0 AND 1 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN start_s < end_s THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN end_s - start_s BETWEEN 15 AND 90 THEN 'PASS' ELSE 'WARN' END, CASE WHEN start_s >= 0 AND end_s <= 65 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN flag <> 'N' THEN 'PASS' ELSE 'WARN' END]) AS v FROM clip),
tal AS (SELECT job_id, count(*) FILTER (v = 'PASS') AS pass, count(*) FILTER (v = 'WARN') AS warn, count(*) FILTER (v = 'FAIL') AS fail FROM chk GROUP BY job_id)""", "SELECT *, CASE WHEN fail > 0 THEN 'FAIL' WHEN warn > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM tal"))
def clip_quality_report(spark, sf_dir):
    rows = X.line_clips(spark, sf_dir).withColumn("duration", F.lit(60.0)).withColumn("snippet", F.when(F.col("flag") != "N", F.col("flag")))
    return Q.tally(Q.clip_checks(rows), ["job_id"])


_CLIP_REPORT = _SPANS.replace("""sp0 AS (SELECT video_id, min_by(start, {'s': start, 'i': seg_idx}) AS start_s, max_by("end", {'s': start, 'i': seg_idx}) AS end_s FROM seg GROUP BY video_id)""",
    "sp0 AS (SELECT doc_id AS video_id, 8.0::DOUBLE AS start_s, 20.0::DOUBLE AS end_s FROM documents)") + f""",
sp4 AS (SELECT video_id, start_s, end_s, round({O.content()}, 9) AS score, substr(trim(text), 1, 200) AS snippet, hook, coherence, sentiment, specificity, curiosity, laughter, (SELECT max("end") FROM seg s WHERE s.video_id = sp3.video_id) AS duration FROM sp3)"""  # fmt: skip
_YES = "CASE WHEN {} THEN 'PASS' ELSE '{}' END AS {}"


@query(O.sql(_CLIP_REPORT, "SELECT video_id, snippet, round(score, 6) AS score, " + ", ".join([f"round({s}, 6) AS {s}" for s in W.SIGNALS] + [_YES.format(*x) for x in (
    ("score BETWEEN 0 AND 1", "FAIL", "score_check"), ("start_s < end_s", "FAIL", "order_check"), ("end_s - start_s BETWEEN 15 AND 90", "WARN", "length_check"), ("start_s >= 0 AND end_s <= duration + 5", "FAIL", "bounds_check"),
    ("snippet <> ''", "WARN", "snippet_check"), (" AND ".join(f"{s} BETWEEN 0 AND 1" for s in W.SIGNALS), "FAIL", "signal_check"))]) + " FROM sp4"))
def clip_report(spark, sf_dir):
    """A clip of each document with its recomputed signals and every check."""
    found = D.clip_report(_doc_clips(spark, sf_dir), X.document_segments(spark, sf_dir))
    return found.select("video_id", "snippet", *[r6(c).alias(c) for c in ("score", *W.SIGNALS)], *Q.CHECKS)


@query(O.sql(O.CLIPS, "SELECT job_id, clip_no, round(greatest(0, least(end_s, e2) - greatest(start_s, s2)) / (end_s - start_s + e2 - s2 - greatest(0, least(end_s, e2) - greatest(start_s, s2))), 6) AS iou FROM (SELECT *, lead(start_s) OVER w AS s2, lead(end_s) OVER w AS e2 FROM clip WINDOW w AS (PARTITION BY job_id ORDER BY start_s, end_s, clip_no)) WHERE s2 IS NOT NULL"))
def clip_iou(spark, sf_dir):
    return Q.neighbour_iou(X.line_clips(spark, sf_dir)).select("job_id", "clip_no", r6("iou").alias("iou"))


@query(O.sql(O.SEGMENTS, f"""SELECT s.video_id, count(*) AS segments, sum(len({O.tokens('s.text')}))::BIGINT AS words, max_by(s."end", s.seg_idx) AS last_end, round(coalesce(max_by(s."end", s.seg_idx) / any_value(nullif(n_chars, 0) / 12.0::DOUBLE), 0), 6) AS coverage, CASE WHEN coalesce(max_by(s."end", s.seg_idx) / any_value(nullif(n_chars, 0) / 12.0::DOUBLE), 0) < 0.7 THEN 'WARN' ELSE 'PASS' END AS verdict FROM seg s JOIN documents d ON d.doc_id = s.video_id GROUP BY s.video_id"""))
def transcript_coverage(spark, sf_dir):
    durations = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), (F.col("n_chars") / 12.0).alias("duration"))
    return Q.coverage(X.document_segments(spark, sf_dir), durations).select("video_id", "segments", "words", "last_end", r6("coverage").alias("coverage"), "verdict")


_URL = "regexp_matches(trim(url), '" + O.S.URL_PATTERN + "')"


@query(f"""SELECT page_id, {_URL} AS is_video, regexp_matches(trim(url), '(?i)^https?://[^\\s/]+') AS is_web, nullif(regexp_extract('https://youtu.be/' || lpad(page_id::VARCHAR, 11, 'a') || '?t=1', '(?:v=|youtu\\.be/|shorts/)([A-Za-z0-9_-]{{11}})', 1), '') AS video_key FROM pages""")
def url_checks(spark, sf_dir):
    made = F.concat(F.lit("https://youtu.be/"), F.lpad(F.col("page_id").cast("string"), 11, "a"), F.lit("?t=1"))
    return X.table(spark, sf_dir, "pages").select("page_id", T.is_video_url(F.col("url")).alias("is_video"), T.is_web_url(F.col("url")).alias("is_web"), T.video_id(made).alias("video_key"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'bad url' WHEN o_orderstatus = 'P' THEN 'inaccessible' WHEN o_orderpriority LIKE '1%' THEN 'playlist' WHEN o_orderpriority LIKE '2%' THEN 'live' WHEN o_totalprice > 21600 THEN 'too long' ELSE 'ok' END AS verdict FROM orders""")
def preflight_verdict(spark, sf_dir):
    p = F.col("o_orderpriority")
    url = F.when(F.col("o_orderkey") % 7 == 0, "ftp://x").otherwise(F.concat(F.lit(" https://www.youtube.com/watch?v="), F.col("o_orderkey").cast("string")))
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), url.alias("url"), (F.col("o_orderstatus") != "P").alias("accessible"), F.when(p.startswith("1"), "playlist").alias("kind"), p.startswith("2").alias("is_live"), F.col("o_totalprice").alias("duration"))
    return J.preflight(rows).select("id", "verdict")


# Detection report


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 7200 THEN 'FAIL' WHEN o_totalprice > 3600 THEN 'WARN' ELSE 'PASS' END AS verdict FROM orders")
def length_guard(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.length_guard(F.col("o_totalprice")).alias("verdict"))


@query(O.sql(O.CLUSTERS + """,
top AS (SELECT video_id, center_s FROM clu QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY count DESC, start_s) = 1),
tst AS (SELECT d.doc_id AS video_id, CASE WHEN t.video_id IS NULL THEN d.n_chars / 12.0::DOUBLE * 0.4::DOUBLE ELSE greatest(0, t.center_s - 20) END AS start_s, d.n_chars / 12.0::DOUBLE AS last_s FROM documents d LEFT JOIN top t ON t.video_id = d.doc_id)""", "SELECT video_id, round(start_s, 6) AS start_s, round(least(start_s + 60, last_s), 6) AS end_s FROM tst", True))
def report_window(spark, sf_dir):
    length = F.col("n_chars") / 12.0
    videos = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), length.alias("duration"), length.alias("audio_duration"))
    rows = P.dry_run_window(videos, C.clusters(X.event_comments(spark, sf_dir)))
    return rows.select("video_id", r6("start_s").alias("start_s"), r6("end_s").alias("end_s"))


@query(O.sql(O.CLUSTERS + "," + O.GRID, "SELECT g.video_id, g.start_s, EXISTS (SELECT 1 FROM clu c WHERE c.video_id = g.video_id AND c.center_s BETWEEN g.start_s AND g.end_s) AS social FROM grid g", True))
def cluster_in_window(spark, sf_dir):
    comments = X.event_comments(spark, sf_dir)
    rows = _grid(comments).join(C.social_rows(comments), "video_id", "left")
    return rows.select("video_id", "start_s", P.has_cluster(F.col("clusters"), F.col("start_s"), F.col("end_s")).alias("social"))


@query(O.sql(O.SEGMENTS, f"""SELECT video_id, 'first' AS edge, seg_idx, start, substr({O.strip('text')}, 1, 60) AS text FROM seg QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start, seg_idx) <= 5
  UNION ALL SELECT video_id, 'last', seg_idx, start, substr({O.strip('text')}, 1, 60) FROM seg QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start DESC, seg_idx DESC) <= 3"""))
def segment_edges(spark, sf_dir):
    return P.segment_edges(X.document_segments(spark, sf_dir))


@query(O.sql(O.GAPS, "SELECT video_id, gap_start, gap_end, mid, row_number() OVER (PARTITION BY video_id ORDER BY gap_start)::INTEGER AS rank FROM gap QUALIFY rank <= 5"))
def first_pauses(spark, sf_dir):
    return P.first_pauses(A.silence_gaps(X.event_frames(spark, sf_dir))).select("video_id", "gap_start", "gap_end", "mid", "rank")


@query(f"SELECT doc_id, CASE WHEN length(x) > 52 THEN substr(x, 1, 49) || '...' ELSE x END AS snippet FROM (SELECT doc_id, replace({O.strip('coalesce(nullif(f, $$$$), text)')}, chr(10), ' ') AS x FROM (SELECT doc_id, text, {O.first_sentence('text')} AS f FROM documents))")
def short_snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.short_snippet(F.col("text")).alias("snippet"))


# Render plans

_RENDER = r""",
pl AS (SELECT *, CASE flag WHEN 'A' THEN 'podcast' WHEN 'N' THEN CASE WHEN clip_no % 2 = 0 THEN 'gaming' ELSE 'interview' END ELSE 'irl' END AS profile,
  CASE clip_no % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'up' END AS bias FROM clip),
fi AS (SELECT *, 'scale=iw*1.15:ih*1.15,crop=min(iw\,ih*9/16):min(ih\,iw*16/9)' AS zoom FROM pl),
ar AS (SELECT *, CASE profile
  WHEN 'gaming' THEN '-filter_complex [0:v]scale=608:1080:force_original_aspect_ratio=increase,crop=608:1080,gblur=sigma=20[bg];[0:v]scale=608:-2[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[base];'
    || '[0:v]crop=iw*0.25:ih*0.35:iw*0.75:ih*0.65,scale=182:-2[cam];[base][cam]overlay=W-w-20:H-h-20[vout] -map [vout] -map 0:a?'
  WHEN 'interview' THEN '-vf ' || zoom || ':' || CASE bias WHEN 'left' THEN '0' WHEN 'right' THEN 'iw-ow' ELSE '(iw-ow)/2' END || ':0,scale=608:1080'
  WHEN 'irl' THEN '-vf ' || zoom || ',scale=608:1080,eq=contrast=1.05:saturation=1.15' ELSE '-vf ' || zoom || ',scale=608:1080' END AS args,
  profile NOT IN ('gaming', 'irl') AS captions, CASE profile WHEN 'podcast' THEN '0.12' WHEN 'irl' THEN '0.15' END AS vol, 'clip_' || clip_no AS n FROM fi)"""


@query(O.sql(O.CLIPS + _RENDER, r"""SELECT job_id, clip_no, profile, n || '_edited.mp4' AS edited, n || '_captioned.mp4' AS captioned, n || '_final.mp4' AS final, captions, vol IS NOT NULL AS music,
  CASE WHEN end_s > start_s THEN 'ffmpeg -y -ss ' || printf('%.3f', start_s) || ' -i raw.mp4 -t ' || printf('%.3f', end_s - start_s) || ' ' || args || ' -c:v h264_videotoolbox -b:v 8M -c:a aac ' || n || '_edited.mp4' END AS trim,
  CASE WHEN captions THEN 'ffmpeg -y -i ' || n || '_edited.mp4 -vf subtitles=' || n || '.srt:force_style=Bold=1\,Outline=2 -c:v h264_videotoolbox -b:v 8M -c:a copy ' || n || '_captioned.mp4' END AS burn,
  CASE WHEN vol IS NOT NULL THEN 'ffmpeg -y -i ' || n || CASE WHEN captions THEN '_captioned.mp4' ELSE '_edited.mp4' END || ' -stream_loop -1 -i ' || profile || '.mp3 -filter_complex [1:a]atrim=end=' || printf('%.3f', end_s - start_s)
    || ',volume=' || vol || '[m];[0:a][m]amix=inputs=2:duration=first:dropout_transition=0[aout] -map 0:v -c:v copy -map [aout] -c:a aac ' || n || '_final.mp4' END AS mix,
  CASE WHEN end_s - start_s > 0 THEN least(end_s - start_s, 60.0::DOUBLE) END AS length FROM ar"""))
def render_plan(spark, sf_dir):
    """Every argument of the commands of a clip."""
    no = F.col("clip_no")
    profile = F.when(F.col("flag") == "A", "podcast").when((F.col("flag") == "N") & (no % 2 == 0), "gaming").when(F.col("flag") == "N", "interview").otherwise("IRL")
    bias = F.when(no % 4 == 0, "left").when(no % 4 == 1, "right").when(no % 4 == 2, "up")
    return V.render_plan(X.line_clips(spark, sf_dir).withColumns({"profile": profile, "crop_bias": bias})).drop("start_s", "end_s")


@query(O.sql(O.CLIPS, r"""SELECT job_id, clip_no, 'ffmpeg -y -ss ' || printf('%.3f', start_s) || ' -i raw.mp4 -t ' || printf('%.3f', end_s - start_s) || ' -filter_complex [0:v]scale=608:1080:force_original_aspect_ratio=increase,crop=608:1080,gblur=sigma=20[bg];[0:v]scale=608:-2[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[base];[0:v]crop=iw*'
  || CASE flag WHEN 'R' THEN '0.25:ih*0.35:iw*0.75:ih*0.65' ELSE CASE clip_no % 2 WHEN 0 THEN '0.5' ELSE '0.25' END || ':ih*' || (clip_no * 0.125::DOUBLE)::VARCHAR || ':iw*0.0:ih*' || CASE flag WHEN 'A' THEN '0.65' ELSE '0.25' END END
  || ',scale=182:-2[cam];[base][cam]overlay=W-w-20:H-h-20[vout] -map [vout] -map 0:a? -c:v h264_videotoolbox -b:v 8M -c:a aac clip_' || clip_no || '_edited.mp4' AS trim FROM clip"""))
def facecam_plan(spark, sf_dir):
    """Gaming clips with a region of the face camera each: none (the default), whole, or with ratios left out."""
    no, flag = F.col("clip_no"), F.col("flag")
    region = F.struct(F.when(no % 2 == 0, 0.5).alias("width_ratio"), (no * 0.125).alias("height_ratio"), F.lit(0.0).alias("x_ratio"), F.when(flag != "A", 0.25).alias("y_ratio"))
    clips = X.line_clips(spark, sf_dir).withColumns({"profile": F.lit("Gaming"), "facecam_region": F.when(flag != "R", region)})
    return V.render_plan(clips).select("job_id", "clip_no", "trim")


@query("""WITH s AS (SELECT p_partkey, p_size * 40 + 100 AS w, p_partkey % 1900 + 100 AS h FROM part),
c AS (SELECT *, abs(w::DOUBLE / h - 9.0::DOUBLE / 16) > 0.02::DOUBLE AS crops, CAST(trunc(h * (9.0::DOUBLE / 16)) AS INTEGER) AS cw, least(CAST(trunc(w / (9.0::DOUBLE / 16)) AS INTEGER), h) AS ch FROM s),
d AS (SELECT *, CASE WHEN NOT crops OR cw > w THEN w ELSE cw END AS crop_w, CASE WHEN NOT crops OR cw <= w THEN h ELSE ch END AS crop_h FROM c)
SELECT p_partkey, crops, crop_w::INTEGER AS crop_w, crop_h::INTEGER AS crop_h, greatest(0, (w - crop_w) // 2)::INTEGER AS crop_x, greatest(0, (h - crop_h) // 2)::INTEGER AS crop_y FROM d""")
def crop_geometry(spark, sf_dir):
    sizes = X.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 100).alias("w"), (F.col("p_partkey") % 1900 + 100).alias("h"))
    return V.crop_geometry(sizes).select("p_partkey", "crops", "crop_w", "crop_h", "crop_x", "crop_y")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 900 THEN 1 WHEN p_retailprice * 2000 / 4000 <= 900 THEN 2 WHEN p_retailprice * 1000 / 4000 <= 900 THEN 3 ELSE 3 END AS attempt FROM part")
def bitrate_attempts(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", V.encode_attempt(F.col("p_retailprice"), 900.0).alias("attempt"))


@query(O.sql(O.JOBS, "SELECT id, state, submitted_at FROM job WHERE state = 'queued'"))
def queue_stream_drain(spark, sf_dir):
    import uuid

    from reelspan.sources.stores import shared_folder
    from reelspan.streaming.queue import drained

    base = shared_folder(spark)
    return drained(spark, sf_dir, f"{base.rstrip('/')}/queue-{uuid.uuid4().hex}")


