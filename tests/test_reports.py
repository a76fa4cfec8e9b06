"""Reports with signals, words of speech output, face-cam regions, and the store's small operators."""

from pyspark.sql import functions as F

from reelspan.operators import jobs, quality, render
from reelspan.plans import detect as D
from reelspan.settings import DEFAULTS, Settings
from reelspan.sources import stores

SEG = "video_id long, seg_idx int, start double, end double, text string"


def test_signal_check(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0), (2, -0.1, 0.5), (3, None, 0.5), (4, 0.5, 1.1)], "id int, a double, b double")
    rows = rows.withColumns({"start_s": F.lit(0.0), "end_s": F.lit(20.0), "score": F.lit(0.5), "duration": F.lit(60.0), "snippet": F.lit("x")})
    checked = quality.clip_checks(rows, ("a", "b"))
    assert {r.id: r.signal_check for r in checked.collect()} == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL"}
    assert {r.id: (r["pass"], r.fail, r.overall) for r in quality.tally(checked, ["id"]).collect()} == {1: (6, 0, "PASS"), 2: (5, 1, "FAIL"), 3: (6, 0, "PASS"), 4: (5, 1, "FAIL")}
    assert quality.tally(quality.clip_checks(rows), ["id"]).select("pass").distinct().collect() == [(5,)]  # without signals there are five checks


def test_clip_report(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 30.0, "The truth is amazing!"), (1, 1, 30.0, 60.0, "$5 for Alice.")], SEG)
    clips = spark.createDataFrame([(1, 0.0, 20.0, 0.7), (1, 40.0, 70.0, 1.2), (2, 0.0, 20.0, None)], "video_id long, start_s double, end_s double, score double")
    got = {(r.video_id, r.start_s): r for r in D.clip_report(clips, segs).collect()}
    one, two, none = got[1, 0.0], got[1, 40.0], got[2, 0.0]
    assert one.snippet == "The truth is amazing!" and one.sentiment > 0 and {one[c] for c in quality.CHECKS} == {"PASS"}
    assert two.snippet == "$5 for Alice." and two.score_check == "FAIL" and two.bounds_check == "FAIL" and two.signal_check == "PASS"
    assert none.snippet == "" and none.snippet_check == "WARN" and none.score_check == "FAIL" == none.bounds_check and none.signal_check == "PASS"


def test_words_of_speech(spark):
    words = "array<struct<word:string,start:double,end:double>>"
    rows = [
        (1, [(0.0, 2.0, "a b", [(" a ", 0.0, 1.0), (" b", None, 2.0), (None, 1.0, 2.0)]), (2.0, 3.0, "", None), (3.0, 4.0, "c", [("c", 3.0, 4.0), ("d", 3.0, None)])]),
        (2, []), (3, None),
    ]
    raw = spark.createDataFrame(rows, f"video_id long, segments array<struct<start:double,end:double,text:string,words:{words}>>")
    assert sorted(stores.whisper_words(raw).collect()) == [(1, 0, "a", 0.0, 1.0), (1, 1, "", 1.0, 2.0), (1, 2, "c", 3.0, 4.0)]
    assert [(r.video_id, r.seg_idx, r.text) for r in stores.whisper_segments(raw).orderBy("seg_idx").collect()] == [(1, 0, "a b"), (1, 1, ""), (1, 2, "c")]


def test_facecam_region(spark):
    rows = spark.sql("SELECT 'gaming' AS p, CAST(NULL AS STRUCT<width_ratio: DOUBLE, height_ratio: DOUBLE, x_ratio: DOUBLE, y_ratio: DOUBLE>) AS r UNION ALL SELECT 'gaming', named_struct('width_ratio', 0.5D, 'height_ratio', 1D, 'x_ratio', NULL, 'y_ratio', 0D) UNION ALL SELECT 'irl', named_struct('width_ratio', 0.5D, 'height_ratio', 1D, 'x_ratio', 0D, 'y_ratio', 0D)")
    got = [r[0] for r in rows.select(render.filter_args(F.col("p"), F.lit(None).cast("string"), F.col("r"))).collect()]
    plain = rows.select(render.filter_args(F.col("p"), F.lit(None).cast("string"))).first()[0]
    assert got[0] == plain and "[0:v]crop=iw*0.25:ih*0.35:iw*0.75:ih*0.65,scale" in plain
    assert got[1] == plain.replace("iw*0.25:ih*0.35:iw*0.75:ih*0.65", "iw*0.5:ih*1.0:iw*0.75:ih*0.0") and "cam" not in got[2]


def test_a_command_without_a_path_is_null(spark):
    rows = spark.createDataFrame([("a.mp4", "b.srt"), (None, "b.srt"), ("a.mp4", None)], "p string, s string")
    made = rows.select(render.burn_command(F.col("p"), F.col("s"), F.lit("x"), F.lit("o.mp4")).alias("c")).collect()
    assert made[0].c.startswith("ffmpeg -y -i a.mp4 -vf subtitles=b.srt") and [r.c for r in made[1:]] == [None, None]


def test_enqueue(spark):
    old = spark.createDataFrame([("a", "u", "failed", 2, "x")], "id string, youtube_url string, state string, retry_count int, error_message string")
    new = spark.sql("SELECT 'b' AS id, 'v' AS youtube_url, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS submitted_at, named_struct('max_clips', 2) AS options")
    got = {r.id: r for r in jobs.enqueued(old, new).collect()}
    assert (got["a"].state, got["a"].retry_count, got["a"].options) == ("failed", 2, None)
    assert (got["b"].state, got["b"].retry_count, got["b"].error_message, got["b"].options.max_clips) == ("queued", 0, None, 2)


def test_clips_are_saved_and_added(spark, tmp_path):
    path, kind = f"file://{tmp_path}/clips", "id string, job_id string, start_s double, end_s double, status string, created_at timestamp_ntz"
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    first = spark.createDataFrame([(None, "j", 0.0, 20.0, None, None), ("c", "j", 20.0, 40.0, "posted", None)], kind)
    stores.overwrite(jobs.with_clip_defaults(first, now), path)
    more = jobs.with_clip_defaults(spark.createDataFrame([(None, "j", 50.0, 70.0, None, None)], kind), now)
    stores.overwrite(stores.current(spark, path, kind).unionByName(more), path)
    got = stores.current(spark, path, kind).orderBy("start_s").collect()
    assert [r.status for r in got] == ["ready", "posted", "ready"] and got[1].id == "c" and len({r.id for r in got}) == 3 and all(r.created_at.year == 2024 for r in got)


def test_saved_transcripts(spark):
    raw = spark.createDataFrame([(1, " b ", 2.0, None), (1, "a", None, 1.5), (2, None, 1.0, 1.0)], "video_id long, text string, start double, duration double")
    got = sorted(stores.normalise_transcript(raw).collect(), key=lambda r: (r.video_id, r.seg_idx))
    assert got == [(1, 0, 0.0, 1.5, "a"), (1, 1, 2.0, 2.0, "b"), (2, 0, 1.0, 2.0, None)] or got[2].text in (None, "")


def test_files_and_tracks(spark):
    files = spark.createDataFrame([("j", "j/b.mp4"), ("j", "j/raw.mp4"), ("j", "j/a.mp4"), ("k", "k/b.mp4"), ("k", "k/a.webm"), ("k", "k/draw.mp4")], "job_id string, path string")
    assert sorted(stores.locate_video(files).collect()) == [("j", "j/raw.mp4"), ("k", "k/a.webm")]
    tracks = spark.createDataFrame([("irl", f"t{k}.mp3") for k in range(20)] + [("podcast", "p.mp3")], "profile string, path string")
    picks = [{r.profile: r.path for r in stores.pick_track(tracks, str(seed)).collect()} for seed in range(6)]
    assert picks[0] == {r.profile: r.path for r in stores.pick_track(tracks, "0").collect()} and {p["podcast"] for p in picks} == {"p.mp3"} and len({p["irl"] for p in picks}) > 1


def test_settings_from_yaml(tmp_path):
    assert Settings.from_yaml(str(tmp_path / "none.yaml")) == DEFAULTS
    got = DEFAULTS.overlay({"top_k": "4", "min_clip_score": "0.3", "sponsor_keywords": ["buy"], "weights": {"hook": "1"}, "other": 1, "cluster_s": None})
    assert (got.top_k, got.min_clip_score, got.sponsor_keywords, got.weights.hook, got.cluster_s) == (4, 0.3, ("buy",), 1.0, DEFAULTS.cluster_s)
