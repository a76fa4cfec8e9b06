"""Windows scored by batches with audio and comments against the plain joins, the thinned walk, texts by rows."""

import random

from pyspark.sql import functions as F

from reelspan.operators import audio as A
from reelspan.operators import social as C
from reelspan.operators import windows as W
from reelspan.operators.select import select_moments
from reelspan.plans import detect as D
from reelspan.settings import Settings

SEG = "video_id long, seg_idx int, start double, end double, text string"
LOW = Settings().overlay({"min_clip_score": 0.3, "sponsor_keywords": ["purchase"]})


def made(spark, seed):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(["Why", "Anna", "amazing", "we went", "$5", "here's why", "so.", "The truth is", "[laughter]"]) for _ in range(r.choice([2, 5, 9])))
    segs = [(v, i, i * 4.0, i * 4.0 + 4.0, text() + r.choice([".", "", "?"])) for v, n in ((1, 420), (2, 20), (3, 160), (4, 9)) for i in range(n)] + [(3, 900 + i, 2400.0 + i * 5, 2405.0 + i * 5, text()) for i in range(12)]
    comments = [(v, i, r.choice(["purchase", "nice"]), sorted(r.randrange(0, 1700) for _ in range(r.choice([0, 1, 1, 2, 5])))) for v in (1, 3, 3, 5) for i in range(150)] + [(None, 1, "purchase", [5]), (1, 900, "nice", [10, 10, 600, 601])]
    frames = [(v, i, i * 2.5, None if i == 7 else r.choice([0.0, 0.1, r.random()]), r.random()) for v, n in ((1, 640), (4, 20), (5, 90)) for i in range(n)]
    return (spark.createDataFrame(segs, SEG).repartition(3), spark.createDataFrame(comments, "video_id long, comment_id long, text string, timestamps array<int>"), spark.createDataFrame(frames, "video_id long, frame_idx int, t double, rms double, zcr double"))


def test_audio_and_comments_beside_segments(spark):
    segs, comments, frames = made(spark, 1)
    gaps = A.silence_gaps(frames, LOW)
    signals = W.window_signals(segs, LOW).cache()
    key = lambda x: (x.video_id, x.anchor, x.len_idx)
    for said, heard in ((comments, frames), (comments, None), (None, frames)):
        pauses = gaps if heard is not None else None
        plain = {key(x): x.score for x in D._fused(D._content(signals, heard, pauses, LOW), said, LOW).collect()}
        found = {key(x): x.score for x in W.scored_windows(segs, LOW, None, *D._beside(said, heard, pauses, LOW)).collect()}
        assert found == plain and len({round(x, 2) for x in plain.values()}) > 20
    assert C.with_social(signals, comments, LOW).where("multiplier < 1").count() > 0 < C.with_social(signals, comments, LOW).where("social > 0").count()


def test_best_windows_are_those_of_the_greedy_walk(spark):
    """Over the edges of chunks, in videos of one and several chunks and with a gap between them; few and many."""
    segs, _, _ = made(spark, 2)
    for k in (1, 6, 40):
        own = Settings().overlay({"min_clip_score": 0.3, "top_k": k})
        rows = W.scored_windows(segs, own, own.min_clip_score)
        want, got = ({tuple(x) for x in m.collect()} for m in (select_moments(rows, k), W.best(segs, own)))
        assert got == want and len(got) >= 4 * min(k, 2) - 2


def test_times_before_zero(spark):
    """Segments that begin before 0 are windows' too, and none is copied for a chunk before the first."""
    segs = spark.createDataFrame([(1, i, i * 5.0 - 700, i * 5.0 - 695, f"Part {i}. ") for i in range(300)], SEG)
    plain = {(x.anchor, x.len_idx): [x[n] for n in W.SIGNALS] for x in W.signals(W.window_texts(segs)).collect()}
    assert {(x.anchor, x.len_idx): [x[n] for n in W.SIGNALS] for x in W.window_signals(segs).collect()} == plain and len(plain) > 1700
    own = Settings().overlay({"min_clip_score": 0.2})
    assert {tuple(x) for x in W.best(segs, own).collect()} == {tuple(x) for x in select_moments(W.scored_windows(segs, own, 0.2), 6).collect()}
    copies = W._copied(W.timed(segs.where("start >= 0 AND start < 500")), own).where("start IS NOT NULL")
    assert copies.count() == 100


def test_texts_by_rows(spark):
    segs, _, _ = made(spark, 3)
    rows = segs.unionByName(spark.createDataFrame([(9, 0, 0.0, 0.0, ""), (9, 1, 0.0, 0.0, " \n "), (9, 2, 0.0, 0.0, "is it\nAnna. Who is"), (9, 3, 1.0, 2.0, "So?! Anna")], SEG))
    assert {tuple(x) for x in W.text_signals(rows).collect()} == {tuple(x) for x in W.signals(rows).collect()}
