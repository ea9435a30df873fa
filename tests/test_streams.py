import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriba.operators import jobs, segmenters, signal
from scriba.sources import pcm
from scriba.streaming import changes, ordered
from scriba.streaming import jobs as streams

SECOND = 1_000_000


def fed(spark, rows, schema, folder, parts, **options):
    """A stream over files that ``rows`` are dealt into one after the other."""
    df = spark.createDataFrame(rows, schema)
    for k in range(parts):
        df.where(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(df.drop("part").schema)
    for name, value in options.items():
        stream = stream.option(name, value)
    return stream.parquet(f"{folder}/*")


def some_frames(seed):
    """Frames of a second, in parts that are a little out of order."""
    rng, out = random.Random(seed), []
    for job in range(4):
        loud = False
        for k in range(300):
            loud = loud if rng.random() < 0.75 else not loud
            out.append((job, 1000 + k + (100 if job == 3 else 0), 0.9 if loud else 0.01, min(3, max(0, k // 75 + (rng.random() < 0.05)))))
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_spans_of_a_stream_are_those_of_the_segmenter(spark, tmp_path, restart):
    frames = some_frames(restart)
    schema = "job int, s long, score double, part int"
    kwargs = {"silence": 3 * SECOND, "shortest": 2 * SECOND, "longest": 6 * SECOND}
    out = None
    for upto in (2, 4) if restart else (4,):
        rows = [r for r in frames if r[3] < upto and (upto == 2 or not restart or r[3] >= 2)]
        folder = str(tmp_path / "in")
        stream = fed(spark, rows, schema, f"{folder}/{upto}", 4)
        stream = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        loud = stream.where("score >= 0.05").select("job", F.timestamp_seconds("s").alias("ts"), F.lit(SECOND).cast("long").alias("n"))
        out = streams.drain(ordered.speech_spans(loud, delay="200 seconds", **kwargs), "spans", "update", str(tmp_path / "at"))
    got = sorted((r.job, r.start, r.n) for r in ordered.so_far(out, "job").collect())
    batch = spark.createDataFrame([(j, s * SECOND, SECOND, x) for j, s, x, _ in frames], "job int, start long, n long, score double")
    want = segmenters.segmented(batch, lambda: segmenters.Gaps(0.05, kwargs["silence"], kwargs["shortest"], kwargs["longest"]), "job")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 40
    assert got == sorted(map(tuple, signal.voice_spans(batch, 0.05, file="job", **kwargs).collect()))
    settled = out.where("settled").count()
    assert 0 < settled < len(got)  # the last of a job are open until something later comes


def test_timers_settle_what_no_frame_follows(spark, tmp_path):
    """Another job's later frames move the watermark; the first job hears of it by its timer alone."""
    rows = [(1, 110, 0), (1, 111, 0), (2, 111, 0), (2, 5000, 1), (2, 9000, 2)]
    stream = fed(spark, rows, "job int, s long, part int", str(tmp_path / "in"), 3, maxFilesPerTrigger=1)
    frames = stream.select("job", F.timestamp_seconds("s").alias("ts"), F.lit(SECOND).cast("long").alias("n"))
    out = streams.drain(ordered.speech_spans(frames, 3 * SECOND, SECOND, 60 * SECOND, delay="1 minute"), "timers", "update")
    assert [(r.start, r.n) for r in out.where("job = 1 and settled").collect()] == [(110 * SECOND, 2 * SECOND)]


def test_loads_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(5), 1000 + k * 40 + rng.randrange(30), rng.choice("aab"), min(2, k // 100 + (rng.random() < 0.1))) for k in range(300)]
    rows = list({(w, s): (w, s, i, p) for w, s, i, p in rows}.values())
    stream = fed(spark, rows, "worker int, s long, identity string, part int", str(tmp_path / "in"), 3, maxFilesPerTrigger=1)
    uses = stream.select("worker", F.timestamp_seconds("s").alias("ts"), "identity")
    out = ordered.so_far(streams.drain(ordered.model_loads(uses, idle=300, delay="2 hours"), "loads", "update"), "worker")
    batch = jobs.loads(spark.createDataFrame(rows, "worker int, s long, identity string, part int").withColumn("ts", F.timestamp_seconds("s")))
    assert sorted((r.worker, r.loads, r.reuses) for r in out.collect()) == sorted(map(tuple, batch.collect()))


def test_state_is_read_and_written_once_for_a_buckets_keys():
    class Handle:
        value, reads, writes, timers = None, 0, 0, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.writes, self.value = self.writes + 1, value

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, loads = Handle(), ordered.Loads(300 * SECOND)
    loads.init(handle)
    came = pd.DataFrame([(k, at * SECOND, "a") for k in range(1000) for at in (1000 + k, 900, 1250)], columns=["key", "at", "identity"])
    (out,) = loads.handleInputRows((7,), iter([came[:1500], came[1500:]]), Times(0))
    assert (handle.reads, handle.writes, handle.timers) == (1, 1, [1250 * 1000 + 1]) and len(out) == 1000
    assert list(out.query("key == 999")[["loads", "reuses", "loaded", "settled", "revision"]].iloc[0]) == [3, 0, 1, False, 0]  # 900, 1250 and 1999
    assert list(out.query("key == 0")[["loads", "reuses"]].iloc[0]) == [1, 2]
    (out,) = loads.handleExpiredTimer((7,), Times(1_600_000), None)
    assert set(out["key"]) == set(range(600)) and set(out["revision"]) == {1}  # all uses of these were before that
    assert handle.timers[1:] == [1_600_001]
    assert list(loads.handleExpiredTimer((7,), Times(1_600_000), None)) == [] and handle.writes == 2


def test_keys_that_share_a_bucket_have_states_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    rng = random.Random(11)
    rows = [(rng.choice([None, *(2**60 + k for k in range(40))]), 1000 + k * 7, rng.choice("aab"), k // 200) for k in range(600)]
    stream = fed(spark, rows, "worker long, s long, identity string, part int", str(tmp_path / "in"), 3, maxFilesPerTrigger=1)
    uses = stream.select("worker", F.timestamp_seconds("s").alias("ts"), "identity")
    out = ordered.so_far(streams.drain(ordered.model_loads(uses, idle=300, delay="10 minutes"), "shared", "update"), "worker")
    batch = jobs.loads(spark.createDataFrame(rows, "worker long, s long, identity string, part int").withColumn("ts", F.timestamp_seconds("s")))
    got = [(r.worker, r.loads, r.reuses) for r in out.collect()]
    assert sorted(got, key=str) == sorted(map(tuple, batch.collect()), key=str) and len(got) == 41


@pytest.mark.parametrize("n", [7, 4000])
def test_parts_of_several_files_are_batches(spark, tmp_path, monkeypatch, n):
    """Each part is written by several tasks, and its files, empty ones too, make up one batch."""
    from scriba.plans import streams as plans

    monkeypatch.setattr(plans, "_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(0, n, 1, 4).where("id <= 3 or id > 5").selectExpr("id", "id div 2 as v")  # of the smaller one, a part has two rows or none
    out = streams.drain(plans._in_parts(rows, 4, "id"), "drained", "append")
    width = (n - 1) // 4 + 1
    got = [(r.id, r.v, r.batch) for r in out.collect()]
    assert sorted(got) == [(k, k // 2, k // width) for k in range(n) if k not in (4, 5)]
    assert [len(list(x.glob("*.parquet"))) for x in sorted((tmp_path / "parts").iterdir())] == [4] * 4


@pytest.mark.parametrize("n", [1, 4, 1000])
def test_retention_of_a_stream_is_that_of_the_batch(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.choice("ab"), k, rng.choice(["done", "failed", "running", "queued"]), rng.randrange(3)) for k in range(200)]
    stream = fed(spark, rows, "service string, job long, state string, part int", str(tmp_path / "in"), 3, maxFilesPerTrigger=1)
    out = streams.latest_updates(streams.drain(ordered.retained_jobs(stream, n), "kept", "update"), "job").where("kept")
    want = jobs.retained(spark.createDataFrame(rows, "service string, job long, state string, part int"), n, "service")
    assert sorted((r.service, r.job, r.state) for r in out.collect()) == sorted((r.service, r.job, r.state) for r in want.collect())


def test_changes_fold_to_what_complete_mode_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None, f"n{k}"]), rng.randrange(9), rng.randrange(5)) for k in range(150)]
    out = whole = None
    for every, name in ((3, "changes"), (1, "whole")):
        stream = fed(spark, rows, "k string, v int, part int", str(tmp_path / name), 5, maxFilesPerTrigger=1)
        result = stream.groupBy("k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).where("v % 3 <> 0")
        if every == 3:
            out = changes.drain_changes(result, name, "k", every=every)
        else:
            whole = streams.drain(result, name, "complete")
    batches = sorted(r.batch for r in whole.select("batch").distinct().collect())
    assert len(batches) == 5
    for b in batches:
        got = changes.folded(out, "k", upto=b)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in whole.where(f"batch = {b}").drop("batch").collect()), key=str)
    kinds = {(r.snapshot, r.op) for r in out.select("snapshot", "op").distinct().collect()}
    assert kinds == {(True, "insert"), (False, "insert"), (False, "update"), (False, "delete")}
    assert out.where("not snapshot").count() < whole.count()


def test_chunks_of_growing_files_come_once(spark, tmp_path):
    pcm.register(spark)
    folder, at = tmp_path / "pcm", str(tmp_path / "at")
    folder.mkdir()
    rng = np.random.default_rng(1)
    files = {f"{k}.f32": rng.random(n, dtype=np.float32) for k, n in enumerate((5 * pcm.CHUNK + 7, 3 * pcm.CHUNK, 10))}
    out, seen = None, []
    for share in (0.0, 0.4, 0.4, 1.0):
        for name, x in files.items():
            if share or name == "0.f32":
                (folder / name).write_bytes(x[: int(len(x) * share)].tobytes())
        out = streams.drain(spark.readStream.format("pcm").load(str(folder)), "pcm", "append", at)
        seen.append(out.count())
    assert seen[0] == 0 and 0 < seen[1] == seen[2] < seen[3] == 8
    got = {(r.file_id.rsplit("/", 1)[-1], r.seq): (r.start, r.samples) for r in out.collect()}
    assert len(got) == 8
    assert all(start == k * pcm.CHUNK and np.array_equal(np.float32(s), files[f][start : start + pcm.CHUNK]) for (f, k), (start, s) in got.items())
