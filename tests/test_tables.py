"""The commit log: crashed writers, two writers at once, readers across a switch, files read by key."""

import threading

import pytest
from pyspark.sql import functions as F

from reelspan.sources import stores, tables

SCHEMA = "id string, n int"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def values(df):
    return sorted((r.id, r.n) for r in df.collect())


def test_a_crashed_writer_blocks_nobody(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.overwrite(rows(spark, [("a", 1)]), path)
    broken = rows(spark, [("b", 2)]).withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("crash")).cast("int")))
    with pytest.raises(Exception, match="crash"):
        tables.overwrite(broken, path)
    # Another one dies after its files are whole and before its version is made.
    rows(spark, [("c", 3)]).write.parquet(f"{path}/data-dead")
    (tmp_path / "t/_log/00000000000000000002.json.123.draft").write_text("{")
    assert values(stores.current(spark, path, SCHEMA)) == [("a", 1)]
    stores.overwrite(rows(spark, [("d", 4)]), path)
    assert values(stores.current(spark, path, SCHEMA)) == [("d", 4)]
    assert tables.vacuum(spark, path) >= 2 and values(stores.current(spark, path, SCHEMA)) == [("d", 4)]


def test_of_two_writers_one_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = tables.overwrite(rows(spark, [("a", 0)]), path)
    done, gate = [], threading.Barrier(4)

    def write(k):
        gate.wait()
        try:
            tables.overwrite(rows(spark, [(x, k) for x in "pqr"]).repartition(3), path, base=base)
            done.append(k)
        except tables.Conflict:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and values(tables.read(spark, path, SCHEMA)) == [(x, done[0]) for x in "pqr"]
    assert tables.latest(spark, path).number == 2
    with pytest.raises(tables.Conflict):
        tables.append(rows(spark, [("z", 1)]), path, base)


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.overwrite(rows(spark, [("a", 1)]), path)
    old = tables.read(spark, path, SCHEMA)
    tables.overwrite(old.withColumn("n", F.col("n") + 1), path)
    tables.append(rows(spark, [("b", 7)]), path)
    assert values(old) == [("a", 1)] and values(tables.read(spark, path, SCHEMA)) == [("a", 2), ("b", 7)]
    assert tables.read(spark, f"{path}-none", SCHEMA).count() == 0
    tables.overwrite(rows(spark, []), path)
    assert tables.read(spark, path, SCHEMA).count() == 0


def test_one_key_one_file(spark, tmp_path):
    """A look-up and an update of one key read one file of many, and the other files stay as they are."""
    path = f"file://{tmp_path}/t"
    wide = spark.range(2000).select(F.format_string("k%05d", "id").alias("id"), F.col("id").cast("int").alias("n"))
    base = tables.overwrite(wide, path, key="id", files=16)
    assert len(base.files) == 16 and sum(f.rows for f in base.files) == 2000
    found = tables.lookup(spark, path, SCHEMA, "k00777")
    assert len(found.inputFiles()) == 1 and values(found) == [("k00777", 777)]
    assert tables.lookup(spark, path, SCHEMA, "zzz").count() == 0 and tables.lookup(spark, path, SCHEMA, None).count() == 0
    new = tables.update(rows(spark, [("k00777", -1), ("nobody", 5)]), path, SCHEMA)
    kept = {f.name for f in base.files} & {f.name for f in new.files}
    assert len(kept) >= 15 and new.number == base.number + 1
    after = dict(values(tables.read(spark, path, SCHEMA)))
    assert len(after) == 2000 and after["k00777"] == -1 and after["k00776"] == 776
    # A row without a key lies in a file without bounds, which any look-up reads.
    tables.append(rows(spark, [(None, 9), ("k00777", 8)]), path, files=1)
    assert values(tables.lookup(spark, path, SCHEMA, "k00777")) == [("k00777", -1), ("k00777", 8)]
    with pytest.raises(ValueError):
        tables.overwrite(rows(spark, [("a", 1)]), f"{path}2")
        tables.lookup(spark, f"{path}2", SCHEMA, "a")
