"""The driver's tables as the relations of the engine, by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.operators.batches import sentences

SLOT_S = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    """segments from (video_id, seg_idx, text): half a second for each word, end to end."""
    length = F.regexp_count("text", F.lit(r"\S+")) * SLOT_S
    upto = Window.partitionBy("video_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("length", length).withColumn("end", F.sum("length").over(upto))
    return timed.select("video_id", "seg_idx", (F.col("end") - F.col("length")).alias("start"), "end", "text")


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of a document is a segment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.mapInArrow(sentences, f"video_id {docs.schema['doc_id'].dataType.simpleString()}, seg_idx int, first long, last long, text string")
    return found.select("video_id", "seg_idx", (F.col("first") * SLOT_S).alias("start"), (F.col("last") * SLOT_S).alias("end"), "text")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation is a segment."""
    turns = table(spark, sf_dir, "conversations")
    return _timed(turns.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), F.coalesce("text", F.lit("")).alias("text")))


def event_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a comment that names a moment of its user's video."""
    s = F.pmod(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(180))
    said = F.concat(F.col("event_type"), F.lit(" at "), F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("comment_id"), said.alias("text"))
    return rows.withColumn("timestamps", T.parse_timestamps(F.col("text")))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order are audio frames, four seconds apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    zcr = F.get_json_object("props", "$.k").cast("double") / 100
    rows = table(spark, sf_dir, "events").withColumn("frame_idx", F.row_number().over(order) - 1)
    return rows.select(F.col("user_id").alias("video_id"), "frame_idx", (F.col("frame_idx") * 4.0).alias("t"), F.col("value").alias("rms"), F.coalesce(zcr, F.lit(0.0)).alias("zcr"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(T.tokens(F.col("text"))).alias("word_idx", "word"))
    return words.select("video_id", "word_idx", "word", (F.col("word_idx") * SLOT_S).alias("start"), ((F.col("word_idx") + 1) * SLOT_S).alias("end"))


def document_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, segments of a document as a speech model writes them: words with a space before them, half a second each; those
    of nine characters or more have no end."""
    said = document_segments(spark, sf_dir)
    begin = lambda i: F.col("start") + i * SLOT_S
    word = lambda w, i: F.struct(F.concat(F.lit(" "), w).alias("word"), begin(i).alias("start"), F.when(F.char_length(w) < 9, begin(i + 1)).alias("end"))
    item = F.struct("seg_idx", "start", "end", "text", F.transform(T.tokens(F.col("text")), word).alias("words"))
    return said.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for x in ("O", "queued", "F", "complete", "P", "downloading")])
    stage = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("string")).otherwise(F.get(F.array(*[F.lit(x) for x in ("downloading", "detecting", "editing", "captioning", "formatting")]), (F.col("o_orderkey") % 5).cast("int")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state[F.col("o_orderstatus")].alias("state"), F.col("o_orderdate").alias("submitted_at"), stage.alias("last_stage_completed"))


def line_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("clip_no"), F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + 10 + F.col("l_linenumber") * 5).alias("end_s"), (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("flag"))
