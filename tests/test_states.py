"""State per job over a stream: legal and refused transitions, repeated files, a restart from the checkpoint, and jobs of the store taken up first."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from reelspan.settings import STAGES, TRANSITIONS
from reelspan.streaming import states

JOBS = "id long, state string, submitted_at timestamp_ntz, last_stage_completed string, retry_count int"


def feed(spark, tmp_path, events, jobs=None):
    """Add a file of events, run the query to its end, and read the latest states."""
    spark.createDataFrame(events, states.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    states.follow(spark, f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/sink", jobs).awaitTermination()
    return {r.id: (r.state, r.last_stage_completed, r.retry_count, r.refused) for r in states.latest(spark, f"file://{tmp_path}/sink").collect()}


def test_transitions():
    """Against the table itself, on random walks."""
    r = random.Random(3)
    for _ in range(300):
        held, state, retries, refused = None, None, 0, 0
        for n in range(r.randrange(1, 12)):
            to = r.choice([*TRANSITIONS, "nonsense", None])
            held = states.applied(held, n, to)
            if (state is None and to == "queued") or (state and to in TRANSITIONS[state]):
                retries, state = retries + (state == "failed"), to
            else:
                refused += 1
            assert (held[0], held[2], held[3], held[4]) == (state, retries, refused, n)
            assert states.applied(held, n, "queued") == held and states.applied(held, n - 1, "failed") == held
        assert states.applied(held, None, "queued")[3] == refused + 1


def test_jobs_of_a_share_at_once():
    """As the events one by one: many jobs, null ids and numbers, repeated and unknown ones, states that the table doesn't know; large numbers."""
    import pandas as pd

    r = random.Random(4)
    held, want = states.HELD.empty_table(), {}
    start = [(7, "editing", "detecting", 2), (None, "odd", None, 0), (2**60 + 1, "", "gone", 1), (9, None, None, 0)]
    held = pa.Table.from_pylist([{"id": i, "state": s, "last_stage_completed": x, "retry_count": n, "refused": 0, "number": None} for i, s, x, n in start], states.HELD)
    want = {i: (s, x, n, 0, None) for i, s, x, n in start}
    for _ in range(6):
        events = [(r.choice([None, 7, 9, 2**60, 2**60 + 1, *range(20)]), r.choice([None, *range(8), 2**60 + r.randrange(3)]), r.choice([*TRANSITIONS, *list(STAGES), "nonsense", "", None])) for _ in range(r.choice([1, 150]))]
        frame = pd.DataFrame({"id": [i or 0 for i, _, _ in events], "no_id": [i is None for i, _, _ in events], "number": [n or 0 for _, n, _ in events], "no_number": [n is None for _, n, _ in events], "state": [s for _, _, s in events]})
        held, named = states.applied_all(held, frame)
        for i, n, to in sorted(events, key=lambda e: (e[1] is None, e[1] or 0, e[2] or "")):
            want[i] = states.applied(want.get(i), n, to)
        rows = held.to_pylist()
        assert {x["id"]: tuple(x.values())[1:] for x in rows} == want and len(rows) == len(want)
        assert {x["id"] for x, k in zip(rows, named.tolist(), strict=True) if k} == {i for i, _, _ in events}


def test_many_jobs_are_followed_in_time(spark, tmp_path):
    """Three batches of 200,000 jobs (a call by job took 89 s on eight cores for two batches of 150,000)."""
    import time

    spark.range(10).selectExpr("id", "0L AS number", "'queued' AS state").write.parquet(f"file://{tmp_path}/events")
    began = time.time()
    for number, state in enumerate(("queued", "downloading", "detecting")):
        spark.range(200_000).selectExpr("id", f"{number}L AS number", f"'{state}' AS state").write.mode("append").parquet(f"file://{tmp_path}/events")
        states.follow(spark, f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/sink").awaitTermination()
    took = time.time() - began
    found = states.latest(spark, f"file://{tmp_path}/sink").groupBy("state", "last_stage_completed", "refused", "number").count().collect()
    assert [tuple(x) for x in found] == [("detecting", "downloading", 0, 2, 200_000)] and took < 90


def test_states_go_on_after_a_restart(spark, tmp_path):
    got = feed(spark, tmp_path, [(1, 1, "downloading"), (1, 0, "queued"), (2, 0, "queued"), (2, 1, "editing"), (3, 5, "failed"), (None, 0, "queued")])
    assert got == {1: ("downloading", None, 0, 0), 2: ("queued", None, 0, 1), 3: (None, None, 0, 1), None: ("queued", None, 0, 0)}
    # A new query from the same checkpoint, with a repeated event: states are those of before.
    got = feed(spark, tmp_path, [(1, 1, "downloading"), (1, 2, "detecting"), (1, 3, "failed"), (1, 4, "queued"), (2, 2, "cancelled"), (2, 3, "queued")])
    assert got[1] == ("queued", "downloading", 1, 0) and got[2] == ("cancelled", None, 0, 2) and got[3] == (None, None, 0, 1)
    assert feed(spark, tmp_path, []) == got


def test_jobs_of_the_store_are_taken_up_first(spark, tmp_path):
    stamp = "CAST('2024-01-0{} 00:00:00' AS TIMESTAMP_NTZ)"
    jobs = spark.createDataFrame([(7, "editing", "detecting", 2), (8, "queued", None, 0), (9, "complete", "formatting", 0), (5, "captioning", "editing", None)], "id long, state string, last_stage_completed string, retry_count int")
    jobs = jobs.withColumn("submitted_at", F.expr(f"CASE WHEN id = 7 THEN {stamp.format(1)} ELSE {stamp.format(2)} END"))
    got = feed(spark, tmp_path, [(7, 1, "captioning"), (9, 1, "queued"), (8, 1, "downloading")], jobs)
    work = [(r.id, r.stage) for r in spark.read.parquet(f"file://{tmp_path}/sink/recovered").orderBy("day", "turn", "step").collect()]
    assert work == [(7, s) for s in STAGES[2:]] + [(5, s) for s in STAGES[3:]]
    assert got[7] == ("captioning", "editing", 2, 0) and got[9] == ("complete", "formatting", 0, 1) and got[8] == ("downloading", None, 0, 0)
    # On a restart the checkpoint's states count, not the table's, and nothing is recovered anew.
    before = (tmp_path / "sink/recovered/_SUCCESS").stat().st_mtime_ns
    assert feed(spark, tmp_path, [(7, 2, "formatting")], jobs.where("id <> 5"))[7] == ("formatting", "captioning", 2, 0)
    assert (tmp_path / "sink/recovered/_SUCCESS").stat().st_mtime_ns == before
