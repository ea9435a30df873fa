"""Streams whose state needs rows in the order of their time: spans of speech, loads of a model.

Rows come in any order. A key keeps those that the watermark hasn't passed in a list, and
folds the others into its state; timers of event time wake it when nothing more comes.
What it would say if no more came is given out beside what is settled, so that a reader
has the whole result at any time. Keys are dealt into buckets by a hash, and a bucket's
state is read and written once for all of its keys that a batch has something of: each
call from Python to the state store costs far more than to fold a key's rows.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriba.operators.jobs import IDLE_SECONDS, MAX_RETAINED, SETTLED
from scriba.streaming.jobs import ROCKSDB

Row = tuple
_NEVER = 1 << 62
#: Buckets that keys are dealt into; a checkpoint holds state by bucket, so it is fixed. Null keys have one of their own.
BUCKETS, _NULL = 512, -1


class InOrder(StatefulProcessor):
    """Folds the rows ``(at, ...)`` of each of a bucket's keys in the order of ``at``, in microseconds.

    A subclass says what its rows, its state and its results are. ``fold`` takes a key's
    state, rows in order and the time that is over, and gives the state and the results
    then. What a key holds is what it takes to go on: its state, and rows that others
    may still come before.
    """

    rows: list[str]
    results: list[str]
    new: Row

    def fold(self, held: Row, rows: list[Row], over: int) -> tuple[Row, list[Row]]:
        raise NotImplementedError

    def wakes(self, held: Row) -> int | None:
        """When the state has something to say though nothing comes, in microseconds."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pickled: a row of a list state, and one in an array, takes longer to convert than to fold
        self.kept = handle.getValueState("kept", "keys binary")

    def _advance(self, came: dict[object, list[Row]] | None, over: int) -> Iterator[pd.DataFrame]:
        """Fold what came, or, where a timer woke the bucket, what keys have that were to wake by now."""
        kept = self.kept.get()
        held, waiting = pickle.loads(kept[0]) if kept else ({}, {})  # by key: (wake, revision, state), and rows
        due = list(came) if came is not None else [k for k, (wake, *_) in held.items() if wake is not None and wake < over]
        if not due:
            return
        said = []
        for k in due:
            rows = sorted([*waiting.pop(k, ()), *(came or {}).get(k, ())])
            cut = bisect_left(rows, over, key=lambda r: r[0])
            _, n, state = held.get(k, (None, -1, self.new))
            state, settled = self.fold(state, rows[:cut], over)
            rest = rows[cut:]
            if rest:
                waiting[k] = rest
            wake = max((x for x in (rest[-1][0] if rest else None, self.wakes(state)) if x is not None), default=None)
            held[k] = (wake if wake is not None and wake >= over else None, n + 1, state)
            open_ = self.fold(state, rest, _NEVER)[1]
            # a row without values says that what was open before isn't any more
            said += [(k, *x, True, n + 1) for x in settled] + ([(k, *x, False, n + 1) for x in open_] or [(k, *[None] * len(self.results), False, n + 1)])
        self.kept.update((pickle.dumps((held, waiting), 5),))
        # one that was to wake before now has a timer, which ends in this batch or the next
        wake = min((w for w, *_ in held.values() if w is not None and w >= over), default=None)
        if wake is not None:
            self.handle.registerTimer(wake // 1000 + 1)
        yield pd.DataFrame(said, columns=["key", *self.results, "settled", "revision"]).astype({c: "Int64" for c in self.results})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = defaultdict(list)
        for pdf in rows:
            for k, *x in pdf[["key", *self.rows]].itertuples(index=False, name=None):
                came[None if key[0] == _NULL else k].append(tuple(x))
        yield from self._advance(came, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._advance(None, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, processor: InOrder) -> DataFrame:
    """``rows (key, ts, at, ...)`` in buckets; a row without a time has no place in the order."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = rows.schema[key].dataType
    bucket = F.when(F.col("key").isNull(), _NULL).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    dealt = rows.where("at is not null").withColumnRenamed(key, "key").withColumn("bucket", bucket.cast("int"))
    schema = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in processor.results), T.StructField("settled", T.BooleanType()), T.StructField("revision", T.LongType())])
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, schema, "Update", "EventTime").withColumnRenamed("key", key)


def so_far(rows: DataFrame, key: str) -> DataFrame:
    """Of what ``drain`` wrote: all that is settled, and what a key has last said to be open."""
    said = rows.withColumn("_last", F.max("revision").over(Window.partitionBy(key))).where("settled or revision = _last")
    results = [c for c in rows.columns if c not in (key, "settled", "revision", "batch")]
    return said.where(F.col(results[0]).isNotNull()).select(key, *results, "settled")


class Spans(InOrder):
    """Spans of frames of speech, in microseconds; see ``operators.signal.voice_spans``."""

    rows = ["at", "n"]
    results, new = ["start", "n"], (None, None)

    def __init__(self, silence: int, shortest: int, longest: int):
        self.silence, self.shortest, self.longest = silence, min(shortest, longest), longest

    def fold(self, held: Row, rows: list[Row], over: int) -> tuple[Row, list[Row]]:
        (begin, last), out = held, []
        for at, n in [*rows, (over, None)]:  # when that time is over, so much silence closes a span
            if begin is not None and at - last >= self.silence:
                if last - begin >= self.shortest:
                    out.append((begin, last - begin))
                begin = last = None
            if n is None:
                continue
            begin, last = (at, at + n) if begin is None else (begin, max(last, at + n))
            while last - begin > self.longest:
                out.append((begin, self.longest))
                begin += self.longest
        return (begin, last), out

    def wakes(self, held: Row) -> int | None:
        return None if held[0] is None else held[1] + self.silence


def speech_spans(frames: DataFrame, silence: int, shortest: int, longest: int, key: str = "job", delay: str = "1 hour") -> DataFrame:
    """``(key, start, n, settled, revision)`` of a stream of ``frames (key, ts, n)`` that have speech, all in microseconds.

    Frames that come later than ``delay`` are dropped. A key keeps the frames that may
    still have others before them, and the span that is open.
    """
    rows = frames.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("n").cast("long").alias("n"))
    return _in_order(rows, key, Spans(silence, shortest, longest))


class Loads(InOrder):
    """How often a worker loads its model and finds it loaded; see ``operators.jobs.loads``. After ``idle`` it is released."""

    rows = ["at", "identity"]
    results, new = ["loads", "reuses", "loaded"], (None, None, 0, 0)

    def __init__(self, idle: int):
        self.idle = idle

    def fold(self, held: Row, rows: list[Row], over: int) -> tuple[Row, list[Row]]:
        last, was, loads, reuses = held
        for at, identity in rows:
            cold = last is None or identity != was or at - last >= self.idle
            loads, reuses, last, was = loads + cold, reuses + (not cold), at, identity
        loaded = last is not None and (over == _NEVER or over - last < self.idle)
        return (last, was, loads, reuses), [(loads, reuses, int(loaded))] if over == _NEVER else []

    def wakes(self, held: Row) -> int | None:
        return None if held[0] is None else held[0] + self.idle


def model_loads(uses: DataFrame, idle: int = IDLE_SECONDS, key: str = "worker", delay: str = "1 hour") -> DataFrame:
    """``(key, loads, reuses, loaded, settled, revision)`` of a stream of ``uses (key, ts, identity)``."""
    rows = uses.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("at"), "identity")
    return _in_order(rows, key, Loads(idle * 1_000_000))


class Retention(StatefulProcessor):
    """The newest settled jobs of a service in a map; older ones are evicted."""

    def __init__(self, n: int, forgotten_ms: int | None):
        self.n, self.forgotten_ms = n, forgotten_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getMapState("settled", "job long", "state string", self.forgotten_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        said: dict[int, tuple[str, bool]] = {}
        for pdf in rows:
            for job, state in zip(pdf["job"].tolist(), pdf["state"].tolist(), strict=True):
                if state in SETTLED:
                    self.settled.updateValue((job,), (state,))
                    said[job] = state, True
                elif not self.settled.containsKey((job,)) and said.get(job, (None, True))[1]:
                    said[job] = state, True
        kept = sorted((k[0], v[0]) for k, v in self.settled.iterator())
        for job, state in kept[: max(0, len(kept) - self.n)]:
            self.settled.removeKey((job,))
            said[job] = state, False
        yield pd.DataFrame([(key[0], job, state, keep) for job, (state, keep) in said.items()], columns=["service", "job", "state", "kept"])

    def close(self) -> None:
        pass


def retained_jobs(jobs: DataFrame, n: int = MAX_RETAINED, forgotten_ms: int | None = None) -> DataFrame:
    """``(service, job, state, kept)`` of a stream of ``jobs (service, job, state)``: what is kept and, with ``kept`` false, evicted.

    A service's state is its ``n`` newest settled jobs, however many it has had; with
    ``forgotten_ms`` a settled job that isn't heard of for so long goes as well.
    """
    jobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([jobs.schema["service"], T.StructField("job", T.LongType()), T.StructField("state", T.StringType()), T.StructField("kept", T.BooleanType())])
    rows = jobs.select("service", F.col("job").cast("long").alias("job"), "state")
    return rows.groupBy("service").transformWithStateInPandas(Retention(n, forgotten_ms), schema, "Update", "ProcessingTime" if forgotten_ms else "None")
