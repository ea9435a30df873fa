"""Jobs and their events in batch: state, counters, order, queue and retention.

Rows are ``(job, seq, kind, ...)`` with an explicit order; the streaming twins are in
``scriba.streaming``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of events, and how many jobs wait and are kept.
STARTED, PROGRESS, SEGMENT, DISCARDED, FINAL = "JobStarted", "JobProgress", "TranscriptSegment", "TranscriptDiscarded", "TranscriptFinal"
FINISHED, FAILED, CANCELLED, DELTA = "JobFinished", "JobFailed", "JobCancelled", "TranscriptDelta"
MAX_QUEUED, MAX_RETAINED, IDLE_SECONDS = 32, 32, 300
SETTLED = ("done", "failed", "cancelled")


def is_settled(state: str = "state") -> Column:
    return F.col(state).isin(*SETTLED)


def counters(events: DataFrame) -> DataFrame:
    """What a service counts for each job: all its segments, also retracted ones, and its latest position and fraction."""
    at = F.when(F.col("kind") == PROGRESS, F.col("seq"))
    return events.groupBy("job").agg(F.count_if(F.col("kind") == SEGMENT).alias("segments"), F.max_by("position", at).alias("position"), F.max_by("fraction", at).alias("fraction"))


def effective_segments(events: DataFrame) -> DataFrame:
    """Segments that count: those after the job's last retraction."""
    last = events.groupBy("job").agg(F.max(F.when(F.col("kind") == DISCARDED, F.col("seq"))).alias("_last"))
    rows = events.where(F.col("kind") == SEGMENT).join(last, "job")
    return rows.where(F.col("seq") > F.coalesce("_last", F.lit(-(2**63)).cast("long"))).drop("_last")


def outcomes(events: DataFrame) -> DataFrame:
    """Each job's state from its last lifecycle event, with its effective number of segments."""
    life = events.where(F.col("kind").isin(STARTED, FINAL, FAILED, CANCELLED))
    last = life.groupBy("job").agg(F.max_by("kind", "seq").alias("kind"))
    state = F.when(F.col("kind") == FINAL, "done").when(F.col("kind") == FAILED, "failed").when(F.col("kind") == CANCELLED, "cancelled").otherwise("running")
    n = effective_segments(events).groupBy("job").agg(F.count(F.lit(1)).alias("segments"))
    return last.select("job", state.alias("state")).join(n, "job", "left").withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))


def stale(events: DataFrame, followed: DataFrame) -> DataFrame:
    """Events that no one follows any more: of a job other than the one ``followed (session, job)`` has; those of no job aren't stale."""
    return events.where(F.col("job").isNotNull()).join(followed, ["session", "job"], "left_anti")


# Which kinds may follow which; the first has none before it.
_AFTER = {
    None: (STARTED,),
    STARTED: (PROGRESS, SEGMENT, DELTA, DISCARDED, FINAL, FAILED, CANCELLED),
    PROGRESS: (PROGRESS, SEGMENT, DELTA, DISCARDED, FINAL, FAILED, CANCELLED),
    SEGMENT: (PROGRESS, SEGMENT, DELTA, DISCARDED, FINAL, FAILED, CANCELLED),
    DELTA: (PROGRESS, SEGMENT, DELTA, DISCARDED, FINAL, FAILED, CANCELLED),
    DISCARDED: (PROGRESS, SEGMENT, DELTA, FINAL, FAILED, CANCELLED),
    FINAL: (FINISHED,),
    FINISHED: (),
    FAILED: (),
    CANCELLED: (),
}


def sequence_violations(events: DataFrame) -> DataFrame:
    """Events that may not follow the one before them in their job."""
    before = F.lag("kind").over(Window.partitionBy("job").orderBy("seq"))
    rows = events.withColumn("previous", before)
    fits = F.lit(False)
    for kind, allowed in _AFTER.items():
        here = F.col("previous").isNull() if kind is None else F.col("previous") == kind
        fits = fits | (here & (F.col("kind").isin(*allowed) if allowed else F.lit(False)))
    return rows.where(~F.coalesce(fits, F.lit(False)))


def wait_and_work(jobs: DataFrame) -> DataFrame:
    """``jobs (submitted, started, finished)``, in milliseconds, with how long each waited and worked; null until both ends are known."""
    return jobs.withColumns({"queued_ms": F.col("started") - F.col("submitted"), "elapsed_ms": F.col("finished") - F.col("started")})


def retained(jobs: DataFrame, n: int = MAX_RETAINED, *by: str) -> DataFrame:
    """Unsettled jobs, and the ``n`` newest settled ones: older ones are evicted."""
    order = Window.partitionBy(*by, is_settled()).orderBy(F.desc("job"))
    return jobs.withColumn("_n", F.row_number().over(order)).where(~is_settled() | (F.col("_n") <= n)).drop("_n")


def loads(uses: DataFrame, worker: str = "worker", ts: str = "ts", identity: str = "identity", idle: int = IDLE_SECONDS) -> DataFrame:
    """How often each worker loads its model: for its first use, for other settings, and after it was idle for too long."""
    order = Window.partitionBy(worker).orderBy(ts)
    rows = uses.withColumns({"_last": F.lag(ts).over(order), "_was": F.lag(identity).over(order)})
    gap = F.col(ts).cast("timestamp").cast("double") - F.col("_last").cast("timestamp").cast("double")
    cold = F.col("_last").isNull() | ~F.col(identity).eqNullSafe(F.col("_was")) | (gap >= idle)
    return rows.groupBy(worker).agg(F.count_if(cold).alias("loads"), F.count_if(~cold).alias("reuses"))


def admit(requests: DataFrame, limit: int = MAX_QUEUED) -> DataFrame:
    """``requests (service, seq, op, job)`` in order, with ``admitted`` and ``waiting``.

    ``submit`` is refused when so many already wait, ``start`` takes the oldest that
    waits, ``cancel`` takes the named one out. Each decision depends on those before, so
    a service is one fold; its state is the jobs that wait, never over the limit.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("waiting", T.IntegerType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, dict] = {}
        for pdf in pdfs:
            admitted, counts = [], []
            for service, op, job in zip(pdf["service"], pdf["op"], pdf["job"], strict=True):
                if service not in waiting:
                    waiting.clear()  # rows come sorted, so the last service is done
                queue, ok = waiting.setdefault(service, {}), None
                if op == "submit":
                    ok = len(queue) < limit
                    if ok:
                        queue[job] = True
                elif op == "start":
                    ok = bool(queue)
                    if ok:
                        del queue[next(iter(queue))]
                elif op == "cancel":
                    ok = queue.pop(job, False)
                admitted.append(ok)
                counts.append(len(queue))
            yield pdf.assign(admitted=admitted, waiting=pd.Series(counts, dtype="int32", index=pdf.index))

    dealt = requests.repartition("service").sortWithinPartitions("service", "seq")
    return dealt.mapInPandas(run, schema)


def throttled(progress: DataFrame, step: int = 2 << 20) -> DataFrame:
    """The rows of ``progress (file, seq, received, total)`` that are reported: after a hundredth of the total since the last report, not under ``step``, and the last."""
    schema = progress.schema

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, last, held = None, 0, None
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples(index=False):
                if row.file != file:
                    if held is not None:
                        out.append(held)
                    file, last, held = row.file, 0, None
                every = step if pd.isna(row.total) else max(int(row.total) // 100, step)
                if row.received - last >= every:
                    out.append(row)
                    last, held = row.received, None
                else:
                    held = row
            yield pd.DataFrame(out, columns=pdf.columns)
        if held is not None:
            yield pd.DataFrame([held])

    return progress.repartition("file").sortWithinPartitions("file", "seq").mapInPandas(run, schema)


def admission_status(requests: DataFrame) -> DataFrame:
    """HTTP status and error kind of ``requests (readable, absolute, exists, format, model_present, queue_full)``: the first check that fails decides."""
    checks = [
        (~F.col("readable"), 400, "request"), (~F.col("absolute"), 400, "request"), (~F.col("exists"), 400, "request"),
        (F.col("format").isNotNull() & ~F.col("format").isin("srt", "txt"), 400, "request"), (~F.col("model_present"), 409, "model"), (F.col("queue_full"), 429, "queue"),
    ]
    status, kind = F.lit(202), F.lit(None).cast("string")
    for failed, code, name in reversed(checks):
        status, kind = F.when(failed, code).otherwise(status), F.when(failed, name).otherwise(kind)
    return requests.withColumns({"status": status, "error_kind": kind})


def views(jobs: DataFrame) -> DataFrame:
    """What a list shows of ``jobs (job, input, state, submitted, started, finished)``: the file's name, a state, and times; a result can be deleted once it is done and written."""
    timed = wait_and_work(jobs)
    deletable = (F.col("state") == "done") & F.col("output").isNotNull()
    return timed.select("job", F.element_at(F.split("input", "/"), -1).alias("label"), "state", "queued_ms", "elapsed_ms", is_settled().alias("settled"), deletable.alias("deletable"))


def error_body(kind: Column, message: Column) -> Column:
    """``{"error": {"kind": ..., "message": ...}}``."""
    return F.to_json(F.struct(F.struct(kind.alias("kind"), message.alias("message")).alias("error")), {"ignoreNullFields": "false"})


def durations(jobs: DataFrame, *by: str, value: str = "elapsed_ms") -> DataFrame:
    """Median (between the two middle ones, where there are two), least and most of a group's durations, and how many there are."""
    return jobs.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def renumbered(rows: DataFrame, by: str, order: str, gone: Column, name: str = "place") -> DataFrame:
    """Rows that remain, with places from 0 that close the gaps."""
    left = rows.where(~gone)
    return left.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
