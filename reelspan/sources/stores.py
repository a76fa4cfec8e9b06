"""The job store: one pretty-printed JSON file for each job, and Parquet tables for clips and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import schemas
from reelspan.sources import tables


def read_jobs(spark: SparkSession, root: str, keep_corrupt: bool = False) -> DataFrame:
    """``root/*/job.json``; files that don't parse are passed over unless they are asked for."""
    rows = spark.read.schema(schemas.JOBS).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/*/job.json")
    return rows if keep_corrupt else rows.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    """One row; an unknown id is an error when the row is asked for."""
    found = jobs.where(F.col("id") == job_id).agg(F.first(F.struct(*jobs.columns)).alias("j"))
    known = F.when(F.col("j").isNull(), F.raise_error(F.lit(f"no job {job_id}"))).otherwise(F.col("j"))
    return found.select(known.alias("j")).select("j.*")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master, whose tasks share the driver's disk, may do without."""
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="reelspan-")


def overwrite(rows: DataFrame, path: str) -> None:
    """Make ``rows`` the next version of a table (``tables``), from which they may be made; of two writers at once the second fails."""
    tables.overwrite(rows, path)


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version of a table, empty where there is none yet."""
    return tables.read(spark, path, schema)


def comment_pages(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """video_id, rank, text, like_count, timestamps of saved API pages ``<path>/<video_id>/<page>.json``: of each video the
    first ``most`` in the pages' order (a page's number counts as a number); null text is "", null likes 0."""
    from pyspark.sql import Window

    from reelspan.functions.text import parse_timestamps

    name = F.input_file_name()
    items = spark.read.schema(schemas.COMMENT_PAGE).option("multiLine", True).json(f"{path}/*/*.json")
    items = items.select(F.regexp_extract(name, r"([^/]+)/[^/]*$", 1).alias("video_id"), F.regexp_extract(name, r"([^/]*)$", 1).alias("page"), F.posexplode("items").alias("k", "i"))
    s = "i.snippet.topLevelComment.snippet"
    order = Window.partitionBy("video_id").orderBy(F.regexp_extract("page", r"(\d+)", 1).try_cast("long").asc_nulls_last(), "page", "k")
    rows = items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = rows.select("video_id", "rank", F.coalesce(f"{s}.textOriginal", f"{s}.textDisplay", F.lit("")).alias("text"), F.coalesce(f"{s}.likeCount", F.lit(0)).alias("like_count"))
    return rows.withColumn("timestamps", parse_timestamps(F.col("text")))


def normalise_transcript(raw: DataFrame) -> DataFrame:
    """raw(video_id, text, start, duration) as segments: nulls are 0, end = start + duration, stripped, ordered by start."""
    from pyspark.sql import Window

    from reelspan.functions.text import strip

    start = F.coalesce("start", F.lit(0.0)).cast("double")
    rows = raw.select("video_id", start.alias("start"), (start + F.coalesce("duration", F.lit(0.0))).alias("end"), strip(F.col("text")).alias("text"))
    order = Window.partitionBy("video_id").orderBy("start", "end", "text")
    return rows.withColumn("seg_idx", (F.row_number().over(order) - 1).cast("int")).select("video_id", "seg_idx", "start", "end", "text")


def whisper_segments(raw: DataFrame) -> DataFrame:
    """raw(video_id, segments: array of (start, end, text)) as segments."""
    rows = raw.select("video_id", F.posexplode("segments").alias("seg_idx", "s"))
    return rows.select("video_id", "seg_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.trim("s.text").alias("text"))


def whisper_words(raw: DataFrame) -> DataFrame:
    """raw(video_id, segments: array of (..., words: array of (word, start, end))) as words(video_id, word_idx, word, start, end):
    in the segments' order, stripped, without those that have no start or no end, numbered from 0 by video. A segment without
    words has none, a null word is empty; a video without segments has no row."""
    from reelspan.functions.text import strip

    said = F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.array().cast("array<struct<word:string,start:double,end:double>>"))))
    timed = F.filter(said, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    rows = raw.select("video_id", F.posexplode(timed).alias("word_idx", "w"))
    return rows.select("video_id", "word_idx", strip(F.coalesce("w.word", F.lit(""))).alias("word"), F.col("w.start").cast("double").alias("start"), F.col("w.end").cast("double").alias("end"))


def locate_video(files: DataFrame) -> DataFrame:
    """files(job_id, path): the file named raw.mp4, else the first by path."""
    exact = F.min(F.when(F.col("path").rlike(r"(^|/)raw\.mp4$"), F.col("path")))
    return files.groupBy("job_id").agg(F.coalesce(exact, F.min("path")).alias("path"))


def pick_track(tracks: DataFrame, seed: str) -> DataFrame:
    """tracks(profile, path): one of each profile, by a seeded hash."""
    return tracks.groupBy("profile").agg(F.min_by("path", F.struct(F.xxhash64("path", F.lit(seed)), "path")).alias("path"))


def write_srt(texts: DataFrame, path: str) -> None:
    texts.select("video_id", "value").write.mode("overwrite").partitionBy("video_id").text(path)
