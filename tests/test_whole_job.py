"""Queries over rows that the given tables don't have: long videos, times below 0, texts without a length."""

import pytest
from pyspark.sql import functions as F


def test_audio_windows_of_a_long_video(spark, tmp_path):
    from reelspan.queries import QUERIES

    rows = spark.range(1234).select(F.col("id").alias("event_id"), F.when(F.col("id") < 1200, 1).otherwise(2).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 10 >= 8, 0.0).otherwise(1.0 + F.col("id") % 3).alias("value"), F.lit('{"k": 5}').alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.video_id, r.start_s): r for r in QUERIES["audio_by_window"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, k * 40.0) for k in range(120)} | {(2, k * 40.0) for k in range(4)}
    for k in range(120):  # ten frames a window, the last two silent
        want = sum((1 + i % 3) / 3 for i in range(k * 10, k * 10 + 8)) / 10
        assert got[1, k * 40.0].audio_energy == pytest.approx(want, abs=1e-6) and got[1, k * 40.0].audio_pause == pytest.approx(1 / 3, abs=1e-6)
    near = {(r.video_id, r.start_s): r.silence for r in QUERIES["nearest_silence"](spark, str(tmp_path)).collect()}
    assert set(near) == set(got)
    assert all(near[1, k * 40.0] == (k * 40.0 - 4 if k else 0.0) for k in range(120))


def test_rows_without_a_time_or_length(spark, tmp_path):
    from reelspan.queries import QUERIES

    spark.createDataFrame([(1, -5.0), (2, None), (3, 61.5)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.srt, r.clock) for r in QUERIES["srt_timestamp"](spark, str(tmp_path)).collect()}
    assert got == {1: ("00:00:00,000", "00:00"), 2: ("00:00:00,000", "00:00"), 3: ("00:01:01,500", "01:01")}
    spark.createDataFrame([(1, "One two.", 0), (2, "One two.", None), (3, "One two.", 8)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.video_id: (r.coverage, r.verdict) for r in QUERIES["transcript_coverage"](spark, str(tmp_path)).collect()}
    assert got == {1: (0.0, "WARN"), 2: (0.0, "WARN"), 3: (1.5, "PASS")}
