"""Interval, cluster, selection, audio, caption, job and render operators on hand-built frames."""

import pytest
from pyspark.sql import functions as F

from reelspan.operators import audio, captions, jobs, refine, render, social, windows
from reelspan.operators.select import select_moments
from reelspan.plans import detect as D
from reelspan.settings import DEFAULTS, Settings

SEG = "video_id long, seg_idx int, start double, end double, text string"


def segments(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], SEG)


STRONG = [(k * 5, k * 5 + 5, t) for k, t in enumerate(["The truth is amazing.", "Why did $500,000 vanish?", "Nobody talks about Alice.", "It was insane and shocking!", "Here's why Bob lost 37% love."])]


def test_lengths():
    assert DEFAULTS.lengths() == [20, 25, 30, 35, 40, 45]
    assert Settings(window_min_s=20, window_max_s=33).lengths() == [20, 25, 30, 33]


def test_anchored_clusters(spark):
    rows = spark.createDataFrame([(1, i, "", [t]) for i, t in enumerate([0, 10, 20, 30])] + [(2, 9, "", [0, 15, 16])], "video_id long, comment_id long, text string, timestamps array<int>")
    got = sorted((r.video_id, r.start_s, r.end_s, r["count"]) for r in social.clusters(rows).collect())
    assert got == [(1, 0, 10, 2), (1, 20, 30, 2), (2, 0, 15, 2), (2, 16, 16, 1)]


def test_touching_moments_are_both_kept(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 20.0, 0.5), (1, 1, 0, 20.0, 40.0, 0.5), (1, 2, 0, 10.0, 30.0, 0.4)], "video_id long, anchor int, len_idx int, start_s double, end_s double, score double")
    assert [(r.start_s, r.rank) for r in select_moments(rows, 6).orderBy("rank").collect()] == [(0, 1), (20, 2)]
    assert select_moments(rows, 0).count() == 0


def test_short_timeline_has_no_window(spark):
    assert windows.candidate_windows(segments(spark, [(0, 19.9, "x")])).count() == 0


def test_strict_overlap(spark):
    lines = windows.timeline(segments(spark, [(0, 5, "a"), (5, 10, "b"), (10, 15, "c")]))
    assert lines.select(windows.joined_text(windows.overlapping(F.col("segs"), F.lit(5.0), F.lit(10.0)))).first()[0] == "b"


def test_detection_invariants(spark):
    filler = [(25 + k * 5, 30 + k * 5, "and so it goes on and on") for k in range(20)]
    second = [(125 + a, 125 + b, t) for a, b, t in STRONG]
    rows = segments(spark, STRONG + filler + second)
    got = D.detect(rows).orderBy("rank").collect()
    assert 2 <= len(got) <= 3 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert all(a.end_s <= b.start_s or b.end_s <= a.start_s for a in got for b in got if a.rank < b.rank)
    assert D.detect(rows, max_clips=0).count() == 0
    plain = spark.createDataFrame([(1, k, "check out", []) for k in range(50)], "video_id long, comment_id long, text string, timestamps array<int>")
    assert [(r.start_s, r.score) for r in D.detect(rows, plain).orderBy("rank").collect()] == [(r.start_s, r.score) for r in got]
    low = segments(spark, [(k * 5, k * 5 + 5, "and it was so") for k in range(20)])
    assert D.detect(low).count() == 0


def test_sponsor_share_is_strict(spark):
    make = lambda n, k: spark.createDataFrame([(1, i, "use code X" if i < k else "fine", [10]) for i in range(n)], "video_id long, comment_id long, text string, timestamps array<int>")
    value = lambda c: social.sponsor_rows(c, DEFAULTS.sponsor_keywords).select(social.sponsor_multiplier(F.col("said"), F.lit(0.0), F.lit(20.0))).first()[0]
    assert value(make(4, 3)) == 0.3 and value(make(4, 1)) == 1.0 and value(make(10, 3)) == 1.0


def test_zero_snap_keeps_the_raw_start(spark):
    lines = windows.timeline(segments(spark, [(0, 30, "a"), (30, 60, "b.")]))
    assert lines.select(refine.snapped_start(F.col("segs"), F.lit(4.0), 10.0)).first()[0] == 4.0


def test_silence(spark):
    rms = [0.0, 0.0, 1.0, 1.0, 0.0]
    rows = spark.createDataFrame([(1, i, i * 0.5, r, 0.5) for i, r in enumerate(rms)], "video_id long, frame_idx int, t double, rms double, zcr double")
    assert [(r.gap_start, r.gap_end) for r in audio.silence_gaps(rows).collect()] == [(0.0, 1.0)]
    silent = rows.withColumn("rms", F.lit(0.0))
    assert audio.normalised(silent).agg(F.max("energy")).first()[0] == 0 and audio.silence_gaps(silent).first().gap_end == 2.0


def test_frame_features(spark):
    import numpy as np

    pcm = np.ones(4096, "<f4").tobytes()
    got = audio.frame_features(spark.createDataFrame([(1, bytearray(pcm)), (2, None)], "video_id long, pcm binary")).orderBy("frame_idx").collect()
    assert len(got) == 9 and got[4].rms == pytest.approx(1.0) and got[4].zcr == 0 and got[1].t == pytest.approx(0.032)


def test_captions(spark):
    words = spark.createDataFrame([(1, k, f"w{k}", 10 + k * 0.5, 10.4 + k * 0.5) for k in range(13)] + [(1, 99, "x", None, None)], "video_id long, word_idx int, word string, start double, end double")
    blocks = captions.srt(captions.caption_lines(words, 6, 10.0)).orderBy("line_no").collect()
    assert len(blocks) == 3 and blocks[0].block.startswith("1\n00:00:00,000 --> 00:00:02,900\nw0 w1")
    holes = captions.segment_srt(segments(spark, [(0, 1, "a"), (1, 2, " "), (2, 3, "b")])).orderBy("line_no").collect()
    assert [r.line_no for r in holes] == [1, 3]


def test_jobs(spark):
    rows = spark.createDataFrame([("a", "queued", 3, None), ("b", "queued", 1, None), ("c", "detecting", 2, "downloading")], "id string, state string, submitted_at int, last_stage_completed string").withColumn("submitted_at", F.timestamp_seconds("submitted_at"))
    assert jobs.next_job(rows).first().id == "b"
    assert jobs.resume_index(jobs.resumable(rows)).first().resume_index == 1
    assert [r.stage for r in jobs.pending_stages(rows).orderBy("step").collect()] == ["detecting", "editing", "captioning", "formatting"]
    changed = jobs.updated(rows, spark.createDataFrame([("a", "failed")], "id string, state string"))
    assert {r.id: r.state for r in changed.collect()} == {"a": "failed", "b": "queued", "c": "detecting"}
    legal = spark.range(1).select(jobs.legal(F.lit("failed"), F.lit("queued")), jobs.legal(F.lit("queued"), F.lit("complete")), jobs.legal(F.lit("?"), F.lit("queued"))).first()
    assert list(legal) == [True, False, False]


def test_job_files(spark, tmp_path):
    from reelspan.sources import stores

    for name, text in (("a", '{"id": "a",\n "state": "queued", "options": {}}'), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    rows = stores.read_jobs(spark, str(tmp_path))
    assert [r.id for r in rows.collect()] == ["a"] and "options" in rows.columns
    assert stores.read_table(spark, str(tmp_path / "none"), "id string").count() == 0


def test_render(spark):
    assert render.bitrate_ladder() == [4000, 2000, 1000]
    rows = spark.createDataFrame([("gaming",), (None,), (" Interview ",)], "p string").select(render.profile(F.col("p")).alias("p"), render.filter_args(F.col("p"), F.lit("left")).alias("f")).collect()
    assert [r.p for r in rows] == ["gaming", "default", "interview"] and ":0:0,scale" in rows[2].f


def test_report_rows(spark):
    """Null and boundary rows of the report."""
    from pyspark.sql import functions as F

    from reelspan.operators import report as P

    rows = spark.createDataFrame([(3600.0, 0.5, None), (3600.5, 1.5, 0.2), (7200.5, None, None), (None, 0.0, -0.1)], "d double, a double, b double")
    got = [tuple(r) for r in rows.select(P.length_guard(F.col("d")), P.signals_in_range(["a", "b"])).collect()]
    assert got == [("PASS", "PASS"), ("WARN", "FAIL"), ("FAIL", "PASS"), ("PASS", "FAIL")]
    videos = spark.createDataFrame([(1, 100.0, None), (2, 100.0, 70.0), (3, 100.0, 90.0)], "video_id long, duration double, audio_duration double")
    found = spark.createDataFrame([(1, 10.0, 5.0, 2), (3, 50.0, 45.0, 2), (3, 80.0, 75.0, 2)], "video_id long, center_s double, start_s double, count long")
    assert sorted(map(tuple, P.dry_run_window(videos, found).collect())) == [(1, 0.0, 60.0), (2, 40.0, 70.0), (3, 30.0, 90.0)]
    said = spark.createDataFrame([("a" * 52,), ("a" * 53,), ("Hi\nyou. Then",), (None,), ("",)], "t string")
    assert [r[0] for r in said.select(P.short_snippet(F.col("t"))).collect()] == ["a" * 52, "a" * 49 + "...", "Hi you", "", ""]
