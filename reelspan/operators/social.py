"""Comment signals: timestamp clusters, social score, sponsor multiplier, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.settings import DEFAULTS, Settings

CLUSTER = "struct<start_s:int,end_s:int,total:bigint,count:bigint>"


def mentions(comments: DataFrame) -> DataFrame:
    """video_id, ts, n: how often each second is named. Seconds are bounded by the video, however many comments."""
    return comments.select("video_id", F.explode("timestamps").alias("ts")).groupBy("video_id", "ts").agg(F.count("*").alias("n"))


def clusters(comments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Anchored clusters: a mention joins the open cluster if it lies at most ``cluster_s`` after the cluster's first.
    video_id, center_s (mean), start_s, end_s, count."""
    times = mentions(comments).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("m"))
    empty = F.struct(F.array().cast(f"array<{CLUSTER}>").alias("done"), F.lit(None).cast(CLUSTER).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["ts"].alias("start_s"), x["ts"].alias("end_s"), (x["ts"] * x["n"]).cast("long").alias("total"), x["n"].alias("count")).cast(CLUSTER)
        held = acc["open"]
        joined = F.struct(held["start_s"].alias("start_s"), x["ts"].alias("end_s"), (held["total"] + x["ts"] * x["n"]).alias("total"), (held["count"] + x["n"]).alias("count")).cast(CLUSTER)
        stays = held.isNotNull() & (x["ts"] - held["start_s"] <= settings.cluster_s)
        done = F.when(held.isNull() | stays, acc["done"]).otherwise(F.concat(acc["done"], F.array(held)))
        return F.struct(done.alias("done"), F.when(stays, joined).otherwise(one).alias("open"))

    found = times.select("video_id", F.explode(F.aggregate(F.col("m"), empty, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))).alias("c"))
    return found.select("video_id", (F.col("c.total") / F.col("c.count")).alias("center_s"), F.col("c.start_s").cast("double").alias("start_s"), F.col("c.end_s").cast("double").alias("end_s"), F.col("c.count").alias("count"))


def confidence(n: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(settings.social_cap), F.lit(0.2) + n / F.lit(50.0) * 0.45))


def social_rows(comments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A row per video: clusters (array), max_count, mentions, confidence."""
    found = clusters(comments, settings)
    packed = found.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("center_s", "count"))).alias("clusters"), F.max("count").alias("max_count"), F.sum("count").alias("mentions"))
    return packed.withColumn("confidence", confidence(F.col("mentions"), settings))


def social_score(packed: Column, max_count: Column, start: Column, end: Column) -> Column:
    """The largest cluster whose centre lies in the closed window, as a share of the largest of all."""
    best = F.array_max(F.transform(F.filter(packed, lambda c: (c["center_s"] >= start) & (c["center_s"] <= end)), lambda c: c["count"]))
    return F.when(max_count.isNull() | (max_count <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0)) / max_count))


def sponsor_rows(comments: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """A row per video: comments with moments as (timestamps, sponsored). Equal ones are counted, not repeated."""
    flagged = comments.where(F.size("timestamps") > 0).select("video_id", "timestamps", T.contains_any(F.col("text"), keywords).alias("sponsored"))
    counted = flagged.groupBy("video_id", "timestamps", "sponsored").agg(F.count("*").alias("n"))
    return counted.groupBy("video_id").agg(F.collect_list(F.struct("timestamps", "sponsored", "n")).alias("said"))


def sponsor_multiplier(said: Column, start: Column, end: Column, settings: Settings = DEFAULTS) -> Column:
    """0.3 where more than 30 % of the comments near the window name a sponsor, each comment once, else 1."""
    near = F.filter(said, lambda c: F.exists(c["timestamps"], lambda t: (t >= start - settings.proximity_s) & (t <= end + settings.proximity_s)))
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    share = F.try_divide(count(F.filter(near, lambda c: c["sponsored"])).cast("double"), count(near).cast("double"))
    return F.when(share > settings.sponsor_ratio, settings.sponsor_multiplier).otherwise(1.0)


#: Rows of a video's totals that its windows are dealt to.
SALTS = 16


def video_totals(found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """max_count and confidence of each video, from its clusters."""
    totals = found.groupBy("video_id").agg(F.max("count").alias("max_count"), F.sum("count").alias("mentions"))
    return totals.select("video_id", "max_count", confidence(F.col("mentions"), settings).alias("confidence"))


def named_seconds(comments: DataFrame, keywords: tuple[str, ...], span: float) -> tuple[DataFrame, DataFrame]:
    """Seconds (video_id, t, n, sponsored) and pairs of seconds at most ``span`` apart that a comment names one after the other
    (video_id, t, u, n, sponsored): the comments that name them, and those of them that name a sponsor."""
    own = comments.select("video_id", F.array_sort(F.array_distinct("timestamps")).alias("ts"), T.contains_any(F.col("text"), keywords).cast("int").alias("s")).where(F.size("ts") > 0)
    own = own.groupBy("video_id", "ts", "s").agg(F.count("*").alias("n"))
    tally = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("sponsored")]
    seconds = own.select("video_id", "n", "s", F.explode("ts").alias("t")).groupBy("video_id", "t").agg(*tally)
    steps = F.transform(F.slice("ts", F.lit(2), F.size("ts")), lambda u, i: F.struct(F.get(F.col("ts"), i).alias("t"), u.alias("u")))
    pairs = own.select("video_id", "n", "s", F.explode(steps).alias("p")).select("video_id", "n", "s", "p.*").where(F.col("u") - F.col("t") <= span).groupBy("video_id", "t", "u").agg(*tally)
    return seconds, pairs


def social_parts(comments: DataFrame, found: DataFrame, keywords: tuple[str, ...], span: float) -> DataFrame:
    """What windows need of stretches of ``span`` seconds, in rows of bounded size: video_id, part, and of this stretch and the next
    clusters (center_s, count), seconds (t, n and sponsored mentions) and pairs (t, u, n, sponsored: seconds that a comment names one
    after the other). However many comments there are, a stretch has no more seconds than its length and no more pairs than its square."""
    seconds, pairs = named_seconds(comments, keywords, span)

    def placed(rows: DataFrame, at: str, name: str, fields: list[str]) -> DataFrame:
        part = F.floor(F.col(at) / span)
        return rows.select("video_id", F.explode(F.array(part - 1, part)).alias("part"), F.struct(*fields).alias(name))

    both = placed(found, "center_s", "cluster", ["center_s", "count"]).unionByName(placed(seconds, "t", "second", ["t", "n", "sponsored"]), allowMissingColumns=True)
    both = both.unionByName(placed(pairs, "t", "pair", ["t", "u", "n", "sponsored"]), allowMissingColumns=True)
    return both.groupBy("video_id", "part").agg(F.collect_list("cluster").alias("clusters"), F.collect_list("second").alias("seconds"), F.collect_list("pair").alias("pairs"))


def with_social(windows: DataFrame, comments: DataFrame, settings: Settings = DEFAULTS, longest: float | None = None) -> DataFrame:
    """windows(video_id, start_s, end_s, ...) with social (the largest cluster whose centre lies in the closed window, as a share of the
    video's largest), confidence and multiplier. No window is longer than ``longest``, by default the longest window or clip.

    A comment's seconds in an interval follow one another, so the seconds named in it less the pairs of such seconds are the
    comments near a window, each once. Windows meet two bounded rows: their stretch's, and their video's totals, which are repeated
    for as many shares of the windows."""
    reach = (max(settings.max_clip_s, settings.window_max_s) if longest is None else longest) + 2 * settings.proximity_s
    found = clusters(comments, settings)
    totals = video_totals(found, settings).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    keyed = windows.withColumns({"_salt": F.pmod(F.xxhash64("start_s", "end_s"), F.lit(SALTS)).cast("int"), "part": F.floor((F.col("start_s") - settings.proximity_s) / reach)})
    joined = keyed.join(totals, ["video_id", "_salt"], "left").join(social_parts(comments, found, settings.sponsor_keywords, reach), ["video_id", "part"], "left")
    low, high = F.col("start_s") - settings.proximity_s, F.col("end_s") + settings.proximity_s
    inside = F.filter("seconds", lambda x: (x["t"] >= low) & (x["t"] <= high))
    again = F.filter("pairs", lambda x: (x["t"] >= low) & (x["u"] <= high))
    total = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    near = lambda name: (total(inside, name) - total(again, name)).cast("double")
    share = F.try_divide(near("sponsored"), near("n"))
    return joined.withColumns({
        "social": F.coalesce(social_score(F.col("clusters"), F.col("max_count"), F.col("start_s"), F.col("end_s")), F.lit(0.0)),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "multiplier": F.when(share > settings.sponsor_ratio, settings.sponsor_multiplier).otherwise(1.0),
    }).drop("_salt", "part", "max_count", "clusters", "seconds", "pairs")


def fused(content: Column, social: Column, conf: Column, multiplier: Column) -> Column:
    return T.clamp((social * conf + content * (F.lit(1.0) - conf)) * multiplier)
