"""What the operators of this subpackage share: the shared folder, staged tables, files on any store."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``. Only a local master, whose tasks share the driver's disk, may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="reelspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Where each staged table was written.
_STAGED: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor
    costs nothing but the tasks that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let the driver drop the shuffle files of jobs that ended."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_STAGED.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, hot: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, whose keys are unique and whose column copies counts the rows of a key. Keys of more than
    1/``hot`` of ``total`` rows, fewer than ``hot``, are broadcast; their rows go through the join of the others dealt by a number, so no
    key is more than that share of a task's rows. Where ``how`` is "left", rows without a fact stay."""
    many, value = F.col("copies") * hot > total, F.struct(*[c for c in facts.columns if c not in (*keys, "copies")])
    top = facts.where(many).select(*keys, value.alias("_top"))
    rest = facts.where(~many).select(*[F.col(k).alias(f"_{k}") for k in keys], value.alias("_rest"))
    dealt = rows.join(F.broadcast(top), keys, "left").withColumn("_cold", F.col("_top").isNull())
    dealt = dealt.withColumn("_deal", F.when(F.col("_cold"), F.col(keys[0])).otherwise(F.monotonically_increasing_id()))
    on = (F.col("_deal") == F.col(f"_{keys[0]}")) & F.col("_cold")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_{k}"))
    found = dealt.join(rest, on, "left").select(*rows.columns, F.coalesce("_top", "_rest").alias("_fact"))
    return (found.where("_fact IS NOT NULL") if how == "inner" else found).select(*rows.columns, "_fact.*")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a worker makes of long texts at once stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
        pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path there; works on any executor. Hadoop's names of S3
    (s3a, s3n) are Arrow's s3."""
    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1) if uri.startswith("file:") else os.path.abspath(uri))


def text_of(column: str = "text"):
    """A text column, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = batch.column(column)
    wide = pa.types.is_large_string(kind.type) or pa.types.is_large_binary(kind.type)
    return [x or b"" for x in kind.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_slices(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield rows_batch(held, schema)
            held = []
    if held:
        yield rows_batch(held, schema)
