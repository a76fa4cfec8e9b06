"""Windows by chunks against plain ones: texts, signals, spread over tasks, and the greedy walk with ties."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import windows as W
from reelspan.operators.select import select_moments
from reelspan.settings import Settings

SEG = "video_id long, seg_idx int, start double, end double, text string"
PARTS = ["Who is", "it", "the truth", "is it", "amazing. ", "Alice met Bob. Then Carl", "", " ", " \n ", "Are", "you sure?", "why\nhow", "$5 and 7% of 12", "[laughter] Wild", "here's why", "Can", "this changes", "everything", "No. ", "Anna", "x?", "\nwhat", "WHAT. Is", "it. \n", "can you", "Dora ends."]


def brute(rows, lengths):
    """(anchor, length, text) of each window."""
    rows = sorted((a or 0.0, i, b or 0.0, t or "") for i, a, b, t in rows)
    last = max(b for _, _, b, _ in rows)
    return {(k, x): " ".join(t for s, _, e, t in rows if s < a + x and e > a) for k, (a, *_) in enumerate(rows) for x in lengths if a + x <= last + 1e-9}


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_change_nothing(spark, seed):
    """Over chunk edges, with long, empty and inverted segments, blank texts, new lines and openers across segments."""
    r = random.Random(seed)
    videos = {}
    for v in (1, 2):
        rows = []
        for i in range(250 if v == 1 else 90):
            a = r.choice([r.uniform(0, 2500), r.uniform(560, 640), 600.0, 595.0]) if v == 1 else i * 1.5
            rows.append((i, a, a + r.choice([0.0, -2.0, r.uniform(0, 12), r.uniform(0, 12), 5.0, 900.0 if r.random() < 0.05 else 3.0]), r.choice(PARTS)))
        videos[v] = [*rows, (900, None, 4.0, "Null starts"), (901, 30.0, None, "never"), (902, 40.0, 50.0, None)]
    segs = spark.createDataFrame([(v, *x) for v, rows in videos.items() for x in rows], SEG).repartition(5)
    lengths = Settings().lengths()
    want = {(v, *k): t for v, rows in videos.items() for k, t in brute(rows, lengths).items()}
    texts = W.window_texts(segs).cache()
    got = {(x.video_id, x.anchor, x.length): x.text for x in texts.collect()}
    assert got == want
    assert {(x.video_id, x.anchor, x.length) for x in W.candidate_windows(segs).collect()} == set(want)
    plain = {(x.video_id, x.anchor, x.length): [x[n] for n in W.SIGNALS] for x in W.signals(texts).collect()}
    found = {(x.video_id, x.anchor, x.length): [x[n] for n in W.SIGNALS] for x in W.window_signals(segs).collect()}
    assert found.keys() == plain.keys()
    for k in plain:
        assert found[k] == pytest.approx(plain[k]), (k, want[k])
    assert W.window_signals(segs.where("video_id = 9")).count() == 0


WIDE = ["Café Paris 5é 7", "RéRo Ana\u0301 Bo", "_Ana 5_ Eve", "I lo\u017ft", "\u212anow. \u0130s it", "the truth", "No one talks. No  one KNOWS", "x\u0301Bob 12\u0661", "²5 Ⅷ9 Ab²", "so... ", "Well ...", "And?! \u00a0Ed", "as i said", "li\u212ae i mentioned", "here's\nwhy", "here's why", "\u0301Ana", "80%. $,", "1.5% 2.%", "most people", "Anna", "[LAUGHS] Ed", "Hmm. Therefore we", "because", "é. who", "I", "quit", "nobody talks about", "unbelievable o'clock wild", "\u2028who", "\x1cwhy \x85", "Zoë", "\U0001f600Bob", "Bob\U0001f600.", "a" * 30 + ". It"]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_read_texts_as_expressions_do(spark, seed):
    """Letters, digits and marks of other alphabets at the edges of words, folded letters, hooks over segments; groups over batches of rows."""
    r = random.Random(seed)
    rows = [(v, i, i * 2.0, i * 2.0 + 2.0, " ".join(r.choice(WIDE if r.random() < 0.8 else PARTS) for _ in range(r.choice([1, 1, 2, 4]))) + r.choice(["", ".", "?!", " "])) for v in range(12) for i in range(r.choice([25, 60, 340]))]
    segs = spark.createDataFrame(rows, SEG).repartition(3)
    key = lambda x: (x.video_id, x.anchor, x.length)
    texts = W.window_texts(segs).cache()
    plain = {key(x): x for x in W.signals(texts).withColumn("score", F.round(W.content_score(), 9)).collect()}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = {key(x): x for x in W.window_signals(segs).collect()}
        scores = {(x.video_id, x.anchor, x.len_idx): x.score for x in W.scored_windows(segs).collect()}
        best = {(x.video_id, x.anchor, x.len_idx): x.score for x in W.scored_windows(segs, least=0.4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert found.keys() == plain.keys()
    for k, x in plain.items():
        assert [found[k][n] for n in W.SIGNALS] == [x[n] for n in W.SIGNALS], (k, x.text)
    lengths = Settings().lengths()
    assert scores == {(v, a, lengths.index(n)): x.score for (v, a, n), x in plain.items()}
    assert best == {k: s for k, s in scores.items() if s >= 0.4} and 0 < len(best) < len(scores)


def test_sentences_are_those_of_the_expression(spark):
    """A document's segments as the pattern splits them, also of blank, missing and long texts."""
    from reelspan.functions import text as T
    from reelspan.operators.batches import sentences

    r = random.Random(5)
    docs = [(i, None if i == 3 else "".join(r.choice(["a", "É", ".", "?", "!", " ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "W"]) for _ in range(r.choice([0, 1, 5, 40, 400])))) for i in range(400)] + [(400, "Go on. " * 700_000), (401, " \n "), (None, "No id. ")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    want = df.select("id", F.posexplode(F.split(T.strip(F.col("text")), T.SENTENCE_END)).alias("seg_idx", "text")).withColumn("n", F.size(T.tokens(F.col("text"))))
    got = df.mapInArrow(sentences, "id long, seg_idx int, first long, last long, text string").selectExpr("id", "seg_idx", "text", "int(last - first) AS n", "first")
    assert got.drop("first").exceptAll(want).count() == 0 and want.exceptAll(got.drop("first")).count() == 0
    assert got.where("id = 400").agg(F.max("first")).first()[0] == 2 * 699_999


def test_many_windows_are_scored_in_time(spark):
    """270,000 windows, for which the expressions took 16 s on four cores."""
    import time

    text = F.concat_ws(" ", F.array(*[F.concat(F.lit("Thing"), (F.col("id") * k % 97).cast("string"), F.lit(" went by")) for k in (3, 5, 7)]))
    segs = spark.range(48_000).select(F.floor(F.col("id") / 200).alias("video_id"), (F.col("id") % 200).cast("int").alias("seg_idx"), (F.col("id") % 200 * 4).cast("double").alias("start"), (F.col("id") % 200 * 4 + 4).cast("double").alias("end"), F.concat(text, F.lit(". ")).alias("text"))
    W.window_signals(segs.where("video_id < 4")).count()
    began = time.time()
    assert W.window_signals(segs).agg(F.count("*"), F.sum("specificity")).first()[0] > 270_000
    assert time.time() - began < 10


def test_a_long_video_spreads(spark):
    """One video with a third of all segments is scored by many tasks, none with three times the median of windows."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 200 + 1).alias("video_id"), F.col("id").cast("int").alias("seg_idx"), F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.floor(F.col("id") / 200)).cast("double").alias("start"))
    segs = rows.selectExpr("video_id", "seg_idx", "start * 4 AS start", "start * 4 + 4 AS end", "'So we went.' AS text")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        tasks = W.anchored(segs).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max((F.col("video_id") == 0).cast("int")).alias("hot")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    sizes = sorted(r.n for r in tasks)
    assert sum(r.hot for r in tasks) >= 10 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def walk(rows, k):
    kept = []
    for neg, a, anchor, x, b in sorted(rows):
        if len(kept) < k and not any(a < d and b > c for c, d in kept):
            kept.append((a, b))
    return kept


@pytest.mark.parametrize("k", [1, 6, 50])
def test_thinned_selection_is_the_greedy_walk(spark, k):
    """On windows with many equal scores, in chunks short against the windows and long ones."""
    r = random.Random(k)
    videos = {}
    for v in range(40):
        starts = sorted(r.choice([r.uniform(0, 900), float(r.randrange(0, 900, 5))]) for _ in range(r.choice([1, 30, 150])))
        steps = r.choice([3, 40, 1000])
        videos[v] = [(-round(r.randrange(steps) / steps, 3), a, i, j, a + x) for i, a in enumerate(starts) for j, x in enumerate((20.0, 25.0, 45.0))]
    rows = spark.createDataFrame([(v, anchor, x, a, b, -neg) for v, found in videos.items() for neg, a, anchor, x, b in found], "video_id long, anchor int, len_idx int, start_s double, end_s double, score double")
    want = {v: walk(found, k) for v, found in videos.items()}
    for span in (60.0, 300.0):
        chosen = select_moments(rows.withColumn("chunk", F.floor(F.col("start_s") / span)), k, longest=45.0, span=span).collect()
        got = {v: [(x.start_s, x.end_s) for x in sorted((y for y in chosen if y.video_id == v), key=lambda y: y.rank)] for v in videos}
        assert got == want
