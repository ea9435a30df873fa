"""Streams of job events: counters, a state per job, and sessions.

Events come as ``(job, seq, ts, kind, position, fraction)``. The reducer and its batch
twin in ``scriba.operators.jobs`` give the same state for the same events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriba.operators.jobs import CANCELLED, DISCARDED, FAILED, FINAL, PROGRESS, SEGMENT, STARTED
from scriba.scratch import scratch_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: How long a job without events keeps its state, in milliseconds.
FORGOTTEN_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream over a folder's event files; the time is a timestamp, as watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def live_counters(events: DataFrame) -> DataFrame:
    """For update mode: each job's segments so far and its latest position and fraction."""
    at = F.when(F.col("kind") == PROGRESS, F.col("seq"))
    return events.groupBy("job").agg(F.count_if(F.col("kind") == SEGMENT).alias("segments"), F.max_by("position", at).alias("position"), F.max_by("fraction", at).alias("fraction"), F.max("seq").alias("last_seq"))


STATE = "job long, state string, segments long, position double, last_seq long"


_SETTLES = {FINAL: "done", FAILED: "failed", CANCELLED: "cancelled"}


def fold(held: tuple, events: pd.DataFrame) -> tuple:
    """``(state, segments, position, last_seq)`` after more events, in the order of ``seq``.

    Segments are counted until they are retracted. A job that is settled ignores what
    still comes, and so does one whose start was never seen.
    """
    state, segments, position, last = held
    for r in events.sort_values("seq").itertuples(index=False):
        last = max(last, int(r.seq))
        if r.kind == STARTED:
            state, segments, position = "running", 0, None
        elif state != "running":
            continue
        elif r.kind == PROGRESS:
            position = float(r.position)
        elif r.kind == SEGMENT:
            segments += 1
        elif r.kind == DISCARDED:
            segments = 0
        else:
            state = _SETTLES.get(r.kind, state)
    return state, segments, position, last


_NEW = (None, 0, None, -1)


def _row(key: tuple, held: tuple) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *held)], columns=["job", "state", "segments", "position", "last_seq"]).astype({"position": "float64"})


class JobReducer(StatefulProcessor):
    """Folds a job's events into its state; those of later batches must be later ones. State without events may expire."""

    def __init__(self, forgotten_ms: int | None):
        self.forgotten_ms = forgotten_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state string, segments long, position double, last_seq long", self.forgotten_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = fold(tuple(self.state.get()) if self.state.exists() else _NEW, pd.concat(list(rows)))
        self.state.update(held)
        yield _row(key, held)

    def close(self) -> None:
        pass


def reduce_jobs(events: DataFrame, forgotten_ms: int | None = None) -> DataFrame:
    """A stream of job states, one row for each job that a batch has events of.

    Its state is held in RocksDB, off the heap. With ``forgotten_ms``, as in
    ``FORGOTTEN_MS``, a live stream forgets jobs that have had no event for so long;
    such a stream has timers, so it doesn't end by itself under ``availableNow``.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = events.select("job", "seq", "kind", "position").groupBy("job")
    return dealt.transformWithStateInPandas(JobReducer(forgotten_ms), STATE, "Update", "ProcessingTime" if forgotten_ms else "None")


def reduce_batch(events: DataFrame) -> DataFrame:
    """The batch twin of ``reduce_jobs``: folds each job's events in order, as a sorted stream, so that a job of any length is never held whole."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, _NEW
        for pdf in pdfs:
            done = []
            for job, part in pdf.groupby("job", sort=False):
                if key is not None and key != (job,):
                    done.append(_row(key, held))
                    held = _NEW
                key, held = (job,), fold(held, part)
            if done:
                yield pd.concat(done)
        if key is not None:
            yield _row(key, held)

    rows = events.select("job", "seq", "kind", "position").where("job is not null")
    return rows.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(run, STATE)


def speech_sessions(frames: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of ``frames (job, ts)``, ended by a gap; late frames are dropped after ``delay``.

    Append mode gives closed runs once, and keeps only the open ones; complete mode gives
    all of them, open ones too, whenever anything comes, and so keeps all.
    """
    late = frames.withWatermark("ts", delay)
    return late.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames")).select("job", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def drain(stream: DataFrame, name: str, mode: str, at: str | None = None) -> DataFrame:
    """Run a stream over what is there now, and read what it wrote.

    Batches are written one after the other to shared storage, numbered; a batch that is
    written again after a failure replaces itself. A stream that is drained again ``at``
    the same place goes on where its checkpoint says.
    """
    spark = stream.sparkSession
    at = at or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/n={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


def snapshot(rows: DataFrame) -> DataFrame:
    """What complete mode gave last: the whole result."""
    last = rows.agg(F.max("batch").alias("_last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")  # one row


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """The last row that update mode gave for each key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(*(F.max_by(c, "batch").alias(c) for c in rest))
