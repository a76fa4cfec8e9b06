"""The job queue as a stream of job files: each batch is drained first in, first out, and written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import schemas
from reelspan.operators import jobs as J


def drain(spark: SparkSession, source: str, checkpoint: str, sink: str, schema: str | None = None, fmt: str = "json", once: bool = True, work: Callable[[DataFrame], DataFrame] | None = None):
    """Start the query. A file source is not in order of submission, so each batch is ordered by (submitted_at, id). A
    batch overwrites its own folder, so that running it again leaves one copy; one query runs for a checkpoint."""
    rows = spark.readStream.schema(schema or schemas.JOBS).format(fmt)
    rows = rows.option("multiLine", True).load(source) if fmt == "json" else rows.load(source)

    def put(batch: DataFrame, batch_id: int) -> None:
        ready = J.queued(batch)
        ordered = (work or (lambda x: x))(ready).orderBy("submitted_at", "id").withColumn("batch_id", F.lit(batch_id))
        ordered.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def drained(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Drain the queued orders of the driver's tables, and read what was written."""
    from reelspan.sources.adapters import order_jobs

    source, sink = f"{folder}/queue", f"{folder}/drained"
    order_jobs(spark, sf_dir).write.mode("overwrite").parquet(source)
    schema = "id long, state string, submitted_at timestamp_ntz, last_stage_completed string"
    drain(spark, source, f"{folder}/checkpoint", sink, schema, "parquet").awaitTermination()
    return spark.read.parquet(f"{sink}/batch=*").select("id", "state", "submitted_at")
