"""Expected values of the text functions, on small frames."""

import pytest
from pyspark.sql import functions as F

from reelspan.functions import text as T


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("text"))).collect()]


def test_timestamps(spark):
    texts = ["at 1:23", "1:02:45", "0:00", "0:30 then 1:00:00", "1:00 and 1:00", "99:99", "0:60", "0:59", "2:00:00", "", None]
    assert values(spark, T.parse_timestamps, texts) == [[83], [3765], [0], [30, 3600], [60, 60], [], [], [59], [7200], [], []]


def test_first_sentence(spark):
    assert values(spark, T.first_sentence, ["", "  padded text  ", "One. Two!", "Really?! Yes", "no end", None]) == ["", "padded text", "One", "Really", "no end", ""]


def test_hook_and_coherence(spark):
    assert values(spark, T.hook_quality, ["", "And then we left", "The truth is simple", " ".join(["word"] * 21), "but I lost $500 here"]) == pytest.approx([0, 0.5, 1.0, 0.8, 0.9])
    assert values(spark, T.coherence, ["", "He left", "The plan works", "Nothing else", "As I said before"]) == [0.6, 0.1, 0.8, 0.6, 0.1]


def test_counts(spark):
    assert values(spark, T.specificity, ["", "$500,000", "37%", "we met Alice in Paris"]) == pytest.approx([0, 1.0, 2 / 3, 2 / 3])
    assert values(spark, T.curiosity, ["", "why? here's why", "nothing"]) == pytest.approx([0, 2 / 6 + 0.25, 0])
    assert values(spark, T.sentiment, ["", "amazing", "a b c d e f g h i j k l m n o amazing"]) == pytest.approx([0, 1.0, 0.5])
    assert values(spark, T.text_laughter, ["[Laughter] [applause]", "(laughter)", "[laughs]"]) == [1.0, 0.0, 0.5]


def test_srt_time(spark):
    rows = spark.createDataFrame([(12.5,), (61.25,), (3661.0,), (-5.0,), (0.0005,), (0.0015,)], "x double")
    assert [r[0] for r in rows.select(T.srt_time(F.col("x"))).collect()] == ["00:00:12,500", "00:01:01,250", "01:01:01,000", "00:00:00,000", "00:00:00,000", "00:00:00,002"]


def test_urls(spark):
    texts = [" https://www.youtube.com/watch?v=abcdefghijk ", "https://youtu.be/abcdefghijk", "ftp://youtu.be/x", None]
    assert values(spark, T.is_video_url, texts) == [True, True, False, False]
    assert values(spark, T.video_id, texts) == ["abcdefghijk", "abcdefghijk", None, None]
