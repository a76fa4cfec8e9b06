"""The state of each job over a stream of its transitions, kept in the state store and taken up from the job table.

Jobs are dealt to ``SHARES`` shares by a hash of their ids. The keyed value state of a share is a table of its jobs: state, last complete
stage, retries and the number of the last event. A batch costs a call for each share that it names, not one for each job, and
writes these shares anew. Events of a batch are applied by number, those of different jobs at once; one whose number is not above the last is a repetition and changes nothing, so files may be read twice. A
transition that the state machine doesn't allow is refused and counted. A job that the store knows begins with the store's state, so
a stream that starts anew goes on where the jobs are; ``recovered`` gives the work that is left of these, before new files are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from reelspan.operators import jobs as J
from reelspan.settings import STAGES, TRANSITIONS

#: number: the event's place among its job's events; state: the state that it asks for.
EVENTS = "id long, number long, state string"
STORED = "state string, last_stage_completed string, retry_count int, refused int, number long"
STATES = f"id long, {STORED}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(held: tuple | None, number: int | None, to: str | None) -> tuple:
    """(state, last stage, retries, refused, number) after an event. A job's first event must queue it; an event without a
    number is refused. A job that leaves a stage for the next or for the end has completed it."""
    state, last, retries, refused, at = held or (None, None, 0, 0, None)
    if number is not None and at is not None and number <= at:
        return state, last, retries, refused, at
    at = at if number is None else number
    if number is None or to not in (TRANSITIONS.get(state, ()) if state else ("queued",)):
        return state, last, retries, refused + 1, at
    if state in STAGES and (to in STAGES or to == "complete"):
        last = state
    return to, last, retries + (state == "failed"), refused, at


#: Fixed for a stream: its states are kept by share.
SHARES = 1024
HELD = pa.schema([("id", pa.int64()), ("state", pa.string()), ("last_stage_completed", pa.string()), ("retry_count", pa.int32()), ("refused", pa.int32()), ("number", pa.int64())])


def _shared(rows: DataFrame) -> DataFrame:
    """rows with their share; ids and numbers are never null, but there are flags of those that are (else pandas makes floats of them)."""
    longs = [x for c in ("id", "number") if c in rows.columns for x in (F.coalesce(c, F.lit(0)).alias(c), F.col(c).isNull().alias(f"no_{c}"))]
    rest = [c for c in rows.columns if c not in ("id", "number")]
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share"), *longs, *rest)


def _slots(known: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ids and which are null, known and new ones: all jobs' ids, which is null, and the places of both among these."""
    ids, null = (np.concatenate([a, b]) for a, b in zip(known, new, strict=True))
    found, back = np.unique(ids[~null], return_inverse=True)
    place = np.full(len(ids), len(found))
    place[~null] = back
    some = int(null.any())
    return np.append(found, np.zeros(some, np.int64)), np.arange(len(found) + some) >= len(found), place[: len(known[0])], place[len(known[0]) :]


def applied_all(held: pa.Table, events: pd.DataFrame) -> tuple[pa.Table, np.ndarray]:
    """Jobs after their events (id, no_id, number, no_number, state), each job's by number as by ``applied``, and which of them had any."""
    null = held.column("id").is_null().to_numpy()
    ids, no_id, old, slot = _slots((held.column("id").fill_null(0).to_numpy(), null), (events["id"].to_numpy(np.int64), events["no_id"].to_numpy(bool)))
    asked, states, lasts = (pc.dictionary_encode(x, null_encoding="encode") for x in (pa.array(events["state"], pa.string(), from_pandas=True), *(held.column(c).combine_chunks() for c in ("state", "last_stage_completed"))))
    names = [None, *sorted({*TRANSITIONS, *(n for x in (asked, states, lasts) for n in x.dictionary.to_pylist())} - {None})]
    code = {n: k for k, n in enumerate(names)}
    coded = lambda x: np.array([code[n] for n in x.dictionary.to_pylist()], np.int64)[x.indices.to_numpy()]
    legal = np.array([[b is not None and b in (TRANSITIONS.get(a, ()) if a else ("queued",)) for b in names] for a in names])
    stage, ends = np.array([n in STAGES for n in names]), np.array([n in STAGES or n == "complete" for n in names])

    def start(values: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(ids), kind)
        out[old] = values
        return out

    state, last = (start(coded(x), np.int64) for x in (states, lasts))
    retries, refused, at = (start(held.column(c).fill_null(0).to_numpy(), np.int64) for c in ("retry_count", "refused", "number"))
    numbered = start(held.column("number").is_valid().to_numpy(), bool)
    to, number, no_number = coded(asked), events["number"].to_numpy(np.int64), events["no_number"].to_numpy(bool)
    order = np.lexsort((to, number, no_number, slot))
    to, number, no_number, by = to[order], number[order], no_number[order], slot[order]
    first = np.flatnonzero(np.diff(by, prepend=-1))
    turn = np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by)))
    round_of = np.argsort(turn, kind="stable")
    for e in np.split(round_of, np.cumsum(np.bincount(turn))[:-1]):
        s, asks, n, none = by[e], to[e], number[e], no_number[e]
        was = state[s]
        again = ~none & numbered[s] & (n <= at[s])
        ok = ~again & ~none & legal[was, asks]
        refused[s] += ~again & ~ok
        at[s] = np.where(again | none, at[s], n)
        numbered[s] |= ~none
        last[s] = np.where(ok & stage[was] & ends[asks], was, last[s])
        retries[s] += ok & (was == code["failed"])
        state[s] = np.where(ok, asks, was)
    named = np.zeros(len(ids), bool)
    named[slot] = True
    words = pa.array(names, pa.string())
    columns = [pa.array(ids, mask=no_id), words.take(pa.array(state)), words.take(pa.array(last)), pa.array(retries.astype(np.int32)), pa.array(refused.astype(np.int32)), pa.array(at, mask=~numbered)]
    return pa.Table.from_arrays(columns, schema=HELD), named


class JobStates(StatefulProcessor):
    def init(self, handle) -> None:
        self.jobs = handle.getValueState("jobs", "held binary")

    def held(self) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.jobs.get()[0])).read_all() if self.jobs.exists() else HELD.empty_table()

    def keep(self, held: pa.Table) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, HELD) as writer:
            writer.write_table(held)
        self.jobs.update((out.getvalue().to_pybytes(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState
        text = lambda c: pa.array([x if isinstance(x, str) else None for x in r[c]], pa.string())
        zero = np.zeros(len(r), np.int32)
        new = [pa.array(r["id"].to_numpy(np.int64), mask=r["no_id"].to_numpy(bool)), text("state"), text("last_stage_completed"), pa.array(r["retry_count"].to_numpy(np.int32)), pa.array(zero), pa.nulls(len(r), pa.int64())]
        self.keep(pa.concat_tables([self.held(), pa.Table.from_arrays(new, schema=HELD)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, named = applied_all(self.held(), pd.concat(list(rows)))
        self.keep(held.combine_chunks())
        yield held.filter(pa.array(named)).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def close(self) -> None:
        pass


def recovered(jobs: DataFrame) -> DataFrame:
    """What is left of jobs that were under way: id, turn (first in, first out), step, stage. Each goes on after its last complete stage."""
    from pyspark.sql import Window

    left = J.pending_stages(jobs)
    order = Window.partitionBy("day").orderBy("submitted_at", "id")
    own = J.resumable(jobs).select("id", "submitted_at", F.to_date("submitted_at").alias("day"))
    return left.join(own.withColumn("turn", F.row_number().over(order)).drop("submitted_at"), "id").select("id", "day", "turn", "step", "stage")


def follow(spark: SparkSession, source: str, checkpoint: str, sink: str, jobs: DataFrame | None = None, once: bool = True):
    """Start the query over Parquet files of EVENTS. Before it reads any, the work left of the jobs in the table is written to
    ``<sink>/recovered`` if the stream is new. Each batch writes the latest state of the jobs that it names to a folder of its own
    (again, if it runs again). The state store's kind is set for this query's session only."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    first = None
    if jobs is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            recovered(jobs).write.mode("overwrite").parquet(f"{sink}/recovered")
        table = f"{sink}/known"
        jobs.select(F.col("id").cast("long").alias("id"), "state", "last_stage_completed", F.coalesce("retry_count", F.lit(0)).alias("retry_count") if "retry_count" in jobs.columns else F.lit(0).alias("retry_count")).write.mode("overwrite").parquet(table)
        first = _shared(own.read.parquet(table)).groupBy("share")
    events = own.readStream.schema(EVENTS).parquet(source)
    kind = T.StructType.fromDDL(STATES)
    states = _shared(events).groupBy("share").transformWithStateInPandas(JobStates(), kind, "Update", "None", first)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/states/batch={batch_id}")

    writer = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """The last state of each job that the stream has named."""
    rows = spark.read.option("basePath", f"{sink}/states").schema(f"{STATES}, batch long").parquet(f"{sink}/states")
    names = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("id", "s.*")
