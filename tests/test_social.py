"""Social scores and sponsor shares by stretches of time against the plain forms over a video's whole arrays."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import social as C
from reelspan.settings import DEFAULTS


@pytest.mark.parametrize("longest", [None, 20.0])
def test_stretches_equal_whole_videos(spark, longest):
    """Comments that name many moments, equal ones, ones without a moment; windows with edges at moments, before 0 and past the end."""
    r = random.Random(9)
    rows = []
    for i in range(600):
        v = r.choice([1, 1, 2, 3])
        times = [r.choice([r.randrange(400), 60, 65, 130, 40]) for _ in range(r.choice([0, 1, 1, 1, 2, 5, 12]))]
        rows.append((v, i, r.choice(["use code A", "fine", "check OUT", None]), times))
    comments = spark.createDataFrame(rows, "video_id long, comment_id long, text string, timestamps array<int>").repartition(4)
    length = longest or 60.0
    spans = [(v, a, a + x) for v in (1, 2, 3, 4) for a in [0.0, 5.0, 55.0, 60.0, 64.5, 390.0, 1000.0, *[r.uniform(0, 420) for _ in range(40)]] for x in (0.0, 20.0, r.uniform(1, length)) if x <= length]
    windows = spark.createDataFrame([(*w, k) for k, w in enumerate(spans)], "video_id long, start_s double, end_s double, n int")
    got = {x.n: (x.social, x.confidence, x.multiplier) for x in C.with_social(windows, comments, DEFAULTS, longest).collect()}
    joined = windows.join(C.social_rows(comments), "video_id", "left").join(C.sponsor_rows(comments, DEFAULTS.sponsor_keywords), "video_id", "left")
    a, b = F.col("start_s"), F.col("end_s")
    plain = joined.select("n", F.coalesce(C.social_score(F.col("clusters"), F.col("max_count"), a, b), F.lit(0.0)), F.coalesce("confidence", F.lit(0.0)), F.coalesce(C.sponsor_multiplier(F.col("said"), a, b), F.lit(1.0)))
    want = {x[0]: tuple(x)[1:] for x in plain.collect()}
    assert got == want and len(got) == len(spans) and {x[2] for x in got.values()} == {0.3, 1.0}
    counted = {k: sum(any(s - 5 <= t <= e + 5 for t in times) for v2, _, _, times in rows if v2 == v) for k, (v, s, e) in enumerate(spans)}
    sponsored = {k: sum(any(s - 5 <= t <= e + 5 for t in times) for v2, _, text, times in rows if v2 == v and text in ("use code A", "check OUT")) for k, (v, s, e) in enumerate(spans)}
    assert all(got[k][2] == (0.3 if counted[k] and sponsored[k] / counted[k] > 0.3 else 1.0) for k in got)
    assert C.with_social(windows, comments.where("video_id = 99"), DEFAULTS).agg(F.sum("social"), F.min("multiplier")).first() == (0.0, 1.0)
