"""Tables with a commit log: Parquet files that a version names, versions that exist once their log entry does.

A writer puts its files in a folder of its own, so nothing that another one has written is touched, and then creates the entry of the
next version, which lists the table's files. Entries are created only where none is: of two writers that began with the same version
the second fails (``Conflict``) and its files belong to no version; a writer that crashes leaves such files too, and nothing else. A
reader holds the files of one version and sees no other.

Files are clustered by the table's key and the entry has each file's least and largest key, so a look-up reads the files
that may hold the key, and an update rewrites those alone. Entries hold names and bounds of files, no rows.

Entries are made by renaming a whole file, which local disks (by hard link) and HDFS refuse where the name is taken; object stores
without that need a store in front that does. Keys that are null lie in the files without bounds. An empty table has a version without files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer made the version first."""


@dataclass(frozen=True)
class File:
    """A data file by its name below the table's folder, with the bounds of its keys as text in JSON; None where it has none."""

    name: str
    rows: int
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Version:
    number: int
    key: str | None
    files: tuple[File, ...]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    place, fs = _fs(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file of that name, unless there is one; whether it was created."""
    jvm = spark._jvm
    place, fs = _fs(spark, path)
    draft, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (place, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            mode[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, mode)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def latest(spark: SparkSession, path: str) -> Version:
    """The last version; number 0 without files where there is none."""
    pattern, fs = _fs(spark, f"{path}/_log/*.json")
    names = sorted(x.getPath().getName() for x in (fs.globStatus(pattern) or []))
    if not names:
        return Version(0, None, ())
    found = json.loads(_read(spark, f"{path}/_log/{names[-1]}"))
    return Version(found["number"], found["key"], tuple(File(**x) for x in found["files"]))


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    text = json.dumps({"number": version.number, "key": version.key, "files": [asdict(f) for f in version.files]})
    if not put_if_absent(spark, f"{path}/_log/{version.number:020d}.json", text):
        raise Conflict(f"version {version.number} of {path} was made by another writer")
    return version


def _written(rows: DataFrame, path: str, key: str | None, files: int | None) -> tuple[File, ...]:
    """Write rows in a new folder, clustered by key; one row of bounds for each file comes back."""
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    if key is not None:
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, key).sortWithinPartitions(key)
    writer = rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true") if key is not None else rows.write
    writer.parquet(f"{path}/{folder}")
    name = F.concat(F.lit(f"{folder}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
    of = F.col(f"`{key}`") if key is not None else F.lit(None).cast("string")
    bound = lambda f: F.to_json(F.struct(f(of).alias("k")))
    found = spark.read.schema(rows.schema).parquet(f"{path}/{folder}").groupBy(name.alias("name")).agg(F.count("*").alias("rows"), bound(F.min).alias("low"), bound(F.max).alias("high"), F.count_if(of.isNull()).alias("unknown"))
    return tuple(File(r.name, r.rows, None if r.unknown else r.low, None if r.unknown else r.high) for r in found.collect())


def overwrite(rows: DataFrame, path: str, key: str | None = None, base: Version | None = None, files: int | None = None) -> Version:
    """Make ``rows`` the table's next version after ``base`` (the last one by default, as it is before the rows are computed)."""
    spark = rows.sparkSession
    base = base or latest(spark, path)
    return _commit(spark, path, Version(base.number + 1, key, _written(rows, path, key, files)))


def append(rows: DataFrame, path: str, base: Version | None = None, files: int | None = None) -> Version:
    """The next version has the files of the last one and those of ``rows``."""
    spark = rows.sparkSession
    base = base or latest(spark, path)
    return _commit(spark, path, Version(base.number + 1, base.key, base.files + _written(rows, path, base.key, files)))


def _open(spark: SparkSession, path: str, files: tuple[File, ...], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f.name}" for f in files]) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str, version: Version | None = None) -> DataFrame:
    """The rows of a version, of the last one by default."""
    return _open(spark, path, (version or latest(spark, path)).files, schema)


def _bounds(spark: SparkSession, files: tuple[File, ...], kind: str) -> DataFrame:
    """name, low, high of files by the type of the key; one row for each file of the log entry."""
    rows = spark.createDataFrame([(f.name, f.low, f.high) for f in files], "name string, low string, high string")
    value = lambda c: F.from_json(c, f"k {kind}")["k"]
    return rows.select("name", value("low").alias("low"), value("high").alias("high"))


def holding(spark: SparkSession, version: Version, keys: DataFrame) -> tuple[File, ...]:
    """The files that may hold any of ``keys`` (one column): the bounds, of which there are as many as files, are broadcast."""
    if not version.files:
        return ()
    name, field = keys.columns[0], keys.schema[0]
    bounds = _bounds(spark, version.files, field.dataType.simpleString())
    hit = keys.join(F.broadcast(bounds), F.col("low").isNull() | F.col(f"`{name}`").between(F.col("low"), F.col("high"))).select("name").distinct()
    names = {r["name"] for r in hit.collect()}
    return tuple(f for f in version.files if f.name in names)


def lookup(spark: SparkSession, path: str, schema: str, value: object, version: Version | None = None) -> DataFrame:
    """The rows whose key is ``value``, from the files that may hold it."""
    version = version or latest(spark, path)
    if version.key is None:
        raise ValueError("the table has no key")
    kind = spark.createDataFrame([], schema).schema[version.key].dataType
    keys = spark.range(1).select(F.lit(value).cast(kind).alias("k"))
    return _open(spark, path, holding(spark, version, keys), schema).where(F.col(version.key) == F.lit(value).cast(kind))


def update(changes: DataFrame, path: str, schema: str, clear: tuple[str, ...] = (), base: Version | None = None) -> Version:
    """Apply ``changes(key, ...)`` as ``jobs.updated`` does, rewriting the files that may hold their keys; the others are kept."""
    from reelspan.operators.jobs import updated

    spark = changes.sparkSession
    base = base or latest(spark, path)
    if base.key is None:
        raise ValueError("the table has no key")
    old = holding(spark, base, changes.select(base.key))
    if not old:
        return base
    rows = updated(_open(spark, path, old, schema), changes, base.key, clear)
    kept = tuple(f for f in base.files if f not in old)
    return _commit(spark, path, Version(base.number + 1, base.key, kept + _written(rows, path, base.key, len(old))))


def vacuum(spark: SparkSession, path: str, version: Version | None = None) -> int:
    """Delete the data folders that ``version`` (the last one by default) has no file of; to be run while nobody writes, or reads an older
    version. The number of folders deleted."""
    used = {f.name.split("/")[0] for f in (version or latest(spark, path)).files}
    pattern, fs = _fs(spark, f"{path}/data-*")
    gone = [x.getPath() for x in (fs.globStatus(pattern) or []) if x.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
