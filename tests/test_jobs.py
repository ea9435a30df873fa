import random

import pytest
from pyspark.sql import functions as F

from scriba.operators import jobs
from scriba.streaming import jobs as streams

KINDS = [jobs.STARTED, jobs.PROGRESS, jobs.SEGMENT, jobs.SEGMENT, jobs.DISCARDED, jobs.FINAL, jobs.FAILED, jobs.CANCELLED, jobs.FINISHED]


def events(spark, rows):
    return spark.createDataFrame(rows, "job long, seq long, kind string, position double, fraction double")


def test_retraction_counters_and_outcomes(spark):
    rows = [(1, 0, jobs.STARTED, None, None), (1, 1, jobs.SEGMENT, None, None), (1, 2, jobs.PROGRESS, 5.0, 0.5), (1, 3, jobs.DISCARDED, None, None), (1, 4, jobs.SEGMENT, None, None), (1, 5, jobs.FINAL, None, None), (1, 6, jobs.FINISHED, None, None), (2, 7, jobs.STARTED, None, None), (2, 8, jobs.CANCELLED, None, None)]
    e = events(spark, rows)
    assert {r.job: (r.segments, r.position) for r in jobs.counters(e).collect()} == {1: (2, 5.0), 2: (0, None)}
    assert {r.job: (r.state, r.segments) for r in jobs.outcomes(e).collect()} == {1: ("done", 1), 2: ("cancelled", 0)}
    assert jobs.sequence_violations(e).count() == 0
    bad = events(spark, [(1, 0, jobs.SEGMENT, None, None), (1, 1, jobs.FINAL, None, None), (1, 2, jobs.SEGMENT, None, None)])
    assert sorted(r.seq for r in jobs.sequence_violations(bad).collect()) == [0, 2]


def test_reducer_in_pieces_equals_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(8), k, rng.choice(KINDS), float(k), None) for k in range(300)]
    batch = {r.job: tuple(r) for r in streams.reduce_batch(events(spark, rows)).collect()}
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["job", "seq", "kind", "position", "fraction"])
    for job, pdf in frame.groupby("job"):
        held = streams._NEW
        for at in range(0, len(pdf), 7):
            held = streams.fold(held, pdf.iloc[at : at + 7].sample(frac=1, random_state=1))
        assert (job, *held) == batch[job]


def test_stream_gives_the_batch_state(spark, tmp_path):
    rng = random.Random(5)
    types = ["signup", "view", "click", "error", "purchase"]
    rows = [(k, k, rng.randrange(6), rng.choice(types), float(k % 100), "{}") for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.timestamp_seconds(F.col("s") * 600).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    for k in range(4):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    from scriba.plans.jobs import job_events

    live = streams.reduce_jobs(job_events(streams.read_events(spark, str(tmp_path / "events.parquet"), "*.parquet")))
    got = {r.job: (r.state, r.segments, r.position, r.last_seq) for r in streams.latest_updates(streams.drain(live, "t", "update"), "job").collect()}
    want = {r.job: (r.state, r.segments, r.position, r.last_seq) for r in streams.reduce_batch(job_events(df)).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1, 3, 32])
def test_admission_equals_a_plain_fold(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("ab"), k, rng.choice(["submit", "submit", "start", "cancel"]), rng.randrange(k + 1) if rng.random() < 0.3 else k) for k in range(200)]
    got = {r.seq: (r.admitted, r.waiting) for r in jobs.admit(spark.createDataFrame(rows, "service string, seq long, op string, job long"), limit).collect()}
    queues = {"a": [], "b": []}
    for s, k, op, job in rows:
        q = queues[s]
        if op == "submit":
            ok = len(q) < limit
            if ok and job not in q:
                q.append(job)
        elif op == "start":
            ok = bool(q)
            if ok:
                q.pop(0)
        else:
            ok = job in q
            if ok:
                q.remove(job)
        assert got[k] == (ok, len(q))


def test_throttle_reports_steps_and_the_last(spark):
    rows = [("f", k, k * 10, 1000) for k in range(11)] + [("g", 0, 5, None)]
    got = jobs.throttled(spark.createDataFrame(rows, "file string, seq long, received long, total long"), 35).orderBy("file", "seq").collect()
    assert [(r.file, r.received) for r in got] == [("f", 40), ("f", 80), ("f", 100), ("g", 5)]


def test_retention_and_loads(spark):
    rows = [(k, "done" if k % 2 else "running") for k in range(10)]
    assert sorted(r.job for r in jobs.retained(spark.createDataFrame(rows, "job long, state string"), 2).collect()) == [0, 2, 4, 6, 7, 8, 9]
    uses = spark.createDataFrame([(1, 0, "a"), (1, 100, "a"), (1, 200, "b"), (1, 500, "b"), (1, 799, "b")], "worker int, s long, identity string").withColumn("ts", F.timestamp_seconds("s"))
    assert tuple(jobs.loads(uses).first()) == (1, 3, 2)
