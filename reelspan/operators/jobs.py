"""Queries and updates of the job table; every update is a new frame, to be written by a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.settings import STAGES, TRANSITIONS

# States that end a job, progress in per cent, labels.
TERMINAL = ("complete", "failed", "cancelled")
PROGRESS = {"queued": 5, "downloading": 33, "detecting": 66, "complete": 100}
LABELS = {"queued": "Queued…", "downloading": "Downloading video…", "detecting": "Detecting clips…", "complete": "Done!", "failed": "Failed.", "cancelled": "Cancelled."}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def queued(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state") == "queued")


def next_job(jobs: DataFrame) -> DataFrame:
    """The head of the queue: earliest submitted, then smallest id."""
    return queued(jobs).orderBy("submitted_at", "id").limit(1)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Each queued job's place. Days are ranked in parallel and moved by the jobs of the days before; jobs without a time of
    submission are first, as in ``next_job``."""
    own = queued(jobs).withColumn("day", F.to_date("submitted_at"))
    days = own.groupBy("day").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = days.select(F.col("day").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("day").orderBy("submitted_at", "id"))
    return own.withColumn("local", local).join(ahead, F.col("day").eqNullSafe(F.col("d"))).select("id", "submitted_at", (F.col("local") + F.col("ahead")).alias("position"))


def resumable(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("state").isin(*TERMINAL, "queued"))


def resume_index(jobs: DataFrame) -> DataFrame:
    """Index of the stage after the last complete one; 0 where that is null or unknown."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("last_stage_completed"))
    return jobs.withColumn("resume_index", F.coalesce(at, F.lit(0)))


def pending_stages(jobs: DataFrame) -> DataFrame:
    """The stages that a resumable job still has to run, in order."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    return resume_index(resumable(jobs)).select("id", F.posexplode(F.slice(stages, F.col("resume_index") + 1, len(STAGES))).alias("step", "stage"))


def job_status(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """State, progress, label and number of clips of each job."""
    counts = clips.groupBy("job_id").agg(F.count("*").alias("clip_count"))
    rows = jobs.join(counts, jobs["id"] == counts["job_id"], "left")
    return rows.select("id", "state", F.coalesce(F.try_element_at(_map(PROGRESS), F.col("state")), F.lit(0)).alias("progress"), F.coalesce(F.try_element_at(_map(LABELS), F.col("state")), F.col("state")).alias("label"), F.coalesce("clip_count", F.lit(0)).alias("clip_count"))


def legal(from_state: Column, to_state: Column) -> Column:
    """Whether the transition is allowed; unknown states have none."""
    table = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(y) for y in b]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, from_state), to_state), F.lit(False))


def updated(rows: DataFrame, changes: DataFrame, key: str = "id", clear: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the columns of ``changes`` by key; other rows as they are. A null leaves a value, but in the columns ``clear``
    it takes it away. Of several changes of a key the largest by their columns in order counts."""
    names = [c for c in changes.columns if c != key]
    one = changes.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*names)).alias("_new"))
    joined = rows.join(one, rows[key] == F.col("_key"), "left")
    new = lambda c: F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"_new.{c}", c)
    return joined.select(*[new(c).alias(c) if c in names else F.col(c) for c in rows.columns])


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` and the new ones (id, youtube_url, submitted_at, options), queued, with every default."""
    made = new.withColumns({"state": F.lit("queued"), "retry_count": F.lit(0)})
    return jobs.unionByName(made, allowMissingColumns=True)


def with_clip_defaults(clips: DataFrame, created_at: Column) -> DataFrame:
    """Missing status is "ready", missing created_at the given time, missing id a hash of the row's place."""
    key = F.sha2(F.concat_ws("/", "job_id", F.col("start_s").cast("string"), F.col("end_s").cast("string")), 256)
    return clips.withColumns({"id": F.coalesce("id", key), "status": F.coalesce("status", F.lit("ready")), "created_at": F.coalesce("created_at", created_at)})


def created_posts(clips: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """A pending post for each clip and platform; its id is a hash of both, so that making it again is the same post."""
    rows = clips.select(F.col("id").alias("clip_id"), F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))
    none = {"posted_at": "timestamp_ntz", "post_url": "string", "error": "string"}
    return rows.select(F.sha2(F.concat_ws("/", "clip_id", "platform"), 256).alias("id"), "clip_id", "platform", F.lit("pending").alias("status"), *[F.lit(None).cast(k).alias(n) for n, k in none.items()], F.lit(0).alias("retry_count"))


def with_job(posts: DataFrame, clips: DataFrame) -> DataFrame:
    """posts(clip_id, ...) with their clip's job_id; posts without a clip have none."""
    return posts.join(clips.select(F.col("id").alias("clip_id"), "job_id"), "clip_id", "left")


def eligible(clips: DataFrame, downloads: DataFrame) -> DataFrame:
    """Clips that can be posted: those that have a file, of jobs that aren't only downloads (downloads(job_id))."""
    return clips.where("file_path IS NOT NULL AND file_path <> ''").join(downloads.select("job_id"), "job_id", "left_anti")


def post_outcomes(posts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """posts after outcomes(id, post_url, error, at): success with the URL and time, or failed with the error."""
    changes = outcomes.select("id", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.col("at")).alias("posted_at"), "post_url", "error")
    return updated(posts, changes)


def jobs_that_fail(clips: DataFrame) -> DataFrame:
    """Jobs with eligible clips of which none succeeded: clips(job_id, eligible, succeeded)."""
    tally = clips.groupBy("job_id").agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("succeeded")).alias("succeeded"))
    return tally.withColumn("fails", (F.col("eligible") > 0) & (F.col("succeeded") == 0))


def preflight(videos: DataFrame, limit_s: float = 21_600.0) -> DataFrame:
    """The first rule that a video breaks: videos(url, accessible, kind, is_live, duration)."""
    from reelspan.functions.text import is_video_url

    verdict = F.when(~is_video_url(F.col("url")), "bad url").when(~F.coalesce("accessible", F.lit(False)), "inaccessible").when(F.coalesce("kind", F.lit("")) == "playlist", "playlist")
    verdict = verdict.when(F.coalesce("is_live", F.lit(False)), "live").when(F.coalesce("duration", F.lit(0)) > limit_s, "too long").otherwise("ok")
    return videos.withColumn("verdict", verdict)
