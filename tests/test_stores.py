"""The store, the queue and updates with odd rows; routing of videos; reaction tags; text helpers."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.operators import audio, jobs, refine, windows
from reelspan.plans import detect as D
from reelspan.settings import Settings
from reelspan.sources import stores

JOB = "id string, state string, submitted_at timestamp_ntz"


def test_queue_keeps_jobs_without_a_time(spark):
    rows = spark.createDataFrame([("a", "queued", None), ("b", "queued", None), ("c", "complete", None)], JOB).unionByName(
        spark.sql("SELECT 'd' AS id, 'queued' AS state, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS submitted_at UNION ALL SELECT 'e', 'queued', TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    assert {r.id: r.position for r in jobs.queue_positions(rows).collect()} == {"a": 1, "b": 2, "e": 3, "d": 4}
    assert jobs.next_job(rows).first().id == "a"


def test_updates(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, error string, n int")
    changes = spark.createDataFrame([("a", None, 5), ("a", None, 4)], "id string, error string, n int")
    assert sorted(jobs.updated(rows, changes).collect()) == [("a", "x", 5), ("b", "y", 2)]
    assert sorted(jobs.updated(rows, changes, clear=("error",)).collect(), key=str) == sorted([("a", None, 5), ("b", "y", 2)], key=str)


def test_posts(spark):
    clips = spark.createDataFrame([("c1", "j1", "f"), ("c2", "j2", ""), ("c3", "j3", "f")], "id string, job_id string, file_path string")
    posts = jobs.created_posts(clips, ("one", "two"))
    assert posts.count() == 6 and posts.select("id").distinct().count() == 6 and {r.status for r in posts.collect()} == {"pending"}
    assert {(r.clip_id, r.job_id) for r in jobs.with_job(posts, clips).collect()} == {("c1", "j1"), ("c2", "j2"), ("c3", "j3")}
    assert [r.id for r in jobs.eligible(clips, spark.createDataFrame([("j3",)], "job_id string")).collect()] == ["c1"]


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    assert stores.current(spark, path, "id string, n int").count() == 0
    stores.overwrite(spark.createDataFrame([("a", 1)], "id string, n int"), path)
    old = stores.current(spark, path, "id string, n int")
    stores.overwrite(old.withColumn("n", F.col("n") + 1), path)  # made from what it replaces
    assert stores.current(spark, path, "id string, n int").collect() == [("a", 2)] and old.collect() == [("a", 1)]


def test_unknown_job(spark):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    assert stores.job_by_id(rows, "a").collect() == [("a", 1)]
    with pytest.raises(PySparkException, match="no job b"):
        stores.job_by_id(rows, "b").collect()


def test_comment_pages_are_limited_by_video(spark, tmp_path):
    for video in ("v1", "v2"):
        (tmp_path / video).mkdir()
        for page in (2, 10):
            items = [{"snippet": {"topLevelComment": {"snippet": {"textDisplay": f"{page}.{k} at 1:0{k}", "likeCount": None if k else 3}}}} for k in range(4)]
            (tmp_path / video / f"page{page}.json").write_text(json.dumps({"items": items}))
    got = stores.comment_pages(spark, str(tmp_path), 6).orderBy("video_id", "rank").collect()
    assert [r.video_id for r in got] == ["v1"] * 6 + ["v2"] * 6 and [r.text.split()[0] for r in got[:6]] == ["2.0", "2.1", "2.2", "2.3", "10.0", "10.1"]
    assert got[0].like_count == 3 and got[1].like_count == 0 and got[1].timestamps == [61]


def test_videos_without_transcript_go_by_audio(spark):
    frames = spark.createDataFrame([(9, k, k * 0.5, 0.0 if k % 7 == 0 else 0.9, 0.5) for k in range(200)], "video_id long, frame_idx int, t double, rms double, zcr double")
    said = spark.createDataFrame([(1, 0, 0.0, 30.0, "Nobody talks about the amazing $500 truth.")], "video_id long, seg_idx int, start double, end double, text string")
    low = Settings(min_clip_score=0.1)
    assert {r.video_id for r in D.detect(said, None, frames, low).collect()} == {1, 9}
    long = spark.createDataFrame([(9, 120.0)], "video_id long, duration double")
    ends = lambda d: D.detect_audio(frames, None, low, 9, d).agg(F.max("end_s")).first()[0]
    assert ends(None) <= 99.5 < ends(long) <= 120.0


def test_overlapping_segments(spark):
    """Windows by position are those by filter, also where segments run long after others begin."""
    import random

    random.seed(4)
    rows = sorted((random.uniform(0, 120), random.uniform(0, 90)) for _ in range(60))
    rows = [(1, k, a, a + d, f"s{k}.") for k, (a, d) in enumerate(rows)]
    segs = spark.createDataFrame(rows, "video_id long, seg_idx int, start double, end double, text string")
    got = windows.window_texts(segs).collect()
    for r in got:
        assert r.text == " ".join(t for _, _, a, b, t in rows if a < r.end_s and b > r.start_s)
    assert len(got) == sum(a + x <= max(e for *_, e, _ in rows) + 1e-9 for _, _, a, _, _ in rows for x in (20, 25, 30, 35, 40, 45))


def test_audio_sums(spark):
    frames = spark.createDataFrame([(1, k, float(k), float(k % 5), (k % 3) / 3) for k in range(50)], "video_id long, frame_idx int, t double, rms double, zcr double")
    gaps = spark.createDataFrame([(1, 9.0, 11.0, 10.0)], "video_id long, gap_start double, gap_end double, mid double")
    wins = spark.createDataFrame([(1, 10.0, 20.0), (1, 10.5, 30.0), (1, 60.0, 70.0), (2, 0.0, 5.0)], "video_id long, start_s double, end_s double")
    got = {(r.video_id, r.start_s): r for r in audio.window_features(wins, frames, gaps).collect()}
    twice = audio.window_features(wins.unionByName(wins.where("video_id = 1")), frames, gaps).collect()
    assert len(twice) == 7 and set(twice) == set(got.values())
    inside = [k for k in range(10, 20)]
    assert got[1, 10.0].audio_energy == pytest.approx(sum(k % 5 / 4 for k in inside) / 10) and got[1, 10.0].audio_laughter == pytest.approx(sum(k % 5 / 4 * (k % 3) / 2 for k in inside) / 10)
    assert [got[k].audio_pause for k in ((1, 10.0), (1, 10.5), (1, 60.0), (2, 0.0))] == [pytest.approx(1 / 3), pytest.approx(1 / 3), 0, 0] and got[1, 60.0].audio_energy == 0 == got[2, 0.0].audio_energy


def test_reaction_tags(spark):
    row = spark.createDataFrame([(1, 0, 0.0, 10.0, "Well."), (1, 1, 11.0, 14.0, "so [Laughter] and [APPLAUSE]")], "video_id long, seg_idx int, start double, end double, text string")
    line = windows.timeline(row)
    assert line.select(refine.laughter_end(F.col("segs"), F.lit(10.0), Settings())).first()[0] == 15.5
    assert line.select(refine.laughter_end(F.col("segs"), F.lit(2.0), Settings())).first()[0] == 2.0
    assert [r[0] for r in row.select(T.text_laughter(F.col("text"))).collect()] == [0.0, 1.0]


def test_small_texts(spark):
    row = spark.createDataFrame([("a:b\\c", '<"&>', 0.5, 1)], "p string, h string, s double, n int")
    got = row.select(T.escape_filter_path(F.col("p")), T.escape_html(F.col("h")), T.score_bar(F.col("s"), 4), T.plural_message(F.col("n")), T.plural_message(F.col("n") + 1)).first()
    assert list(got) == ["a\\:b\\\\c", "&lt;&quot;&amp;&gt;", "██░░", "1 clip found", "2 clips found"]
