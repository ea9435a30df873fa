"""Job queries: users stand for jobs, their events for what happens to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriba.operators import jobs
from scriba.plans.registry import query, table
from scriba.streaming import jobs as streams

_KINDS = {"signup": jobs.STARTED, "view": jobs.PROGRESS, "click": jobs.SEGMENT, "error": jobs.DISCARDED, "purchase": jobs.FINAL}


def _kind() -> Column:
    return F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _KINDS.items()))


def job_events(rows: DataFrame) -> DataFrame:
    """``job, seq, ts, kind, position, fraction``: a job's events in the order of their ids."""
    fraction = F.when(F.col("event_id") % 3 != 0, F.col("value") / 1000)
    return rows.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", _kind().alias("kind"), F.col("value").alias("position"), fraction.alias("fraction"))


EVENTS = """
e AS (SELECT user_id AS job, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'JobStarted' WHEN 'view' THEN 'JobProgress' WHEN 'click' THEN 'TranscriptSegment' WHEN 'error' THEN 'TranscriptDiscarded' WHEN 'purchase' THEN 'TranscriptFinal' END AS kind,
             value AS position, CASE WHEN event_id % 3 <> 0 THEN value / 1000 END AS fraction FROM events)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events(table(spark, sf_dir, "events"))


COUNTERS = f"""WITH {EVENTS}, p AS (SELECT job, position, fraction FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS k FROM e WHERE kind = 'JobProgress') WHERE k = 1),
c AS (SELECT job, count(*) FILTER (kind = 'TranscriptSegment') AS segments, max(seq) AS last_seq FROM e GROUP BY job)"""


@query(f"{COUNTERS} SELECT c.job, segments, round(position, 6) AS position, round(fraction, 9) AS fraction FROM c LEFT JOIN p ON p.job = c.job")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.counters(_events(spark, sf_dir))
    return out.withColumns({"position": F.round("position", 6), "fraction": F.round("fraction", 9)})


@query(f"""WITH {EVENTS}, d AS (SELECT job, max(seq) AS last FROM e WHERE kind = 'TranscriptDiscarded' GROUP BY job)
SELECT e.job, count(*) AS segments FROM e LEFT JOIN d ON d.job = e.job WHERE kind = 'TranscriptSegment' AND seq > coalesce(last, -1) GROUP BY e.job""")
def retraction_effective_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.effective_segments(_events(spark, sf_dir)).groupBy("job").agg(F.count(F.lit(1)).alias("segments"))


@query(f"""WITH {EVENTS}, l AS (SELECT job, arg_max(kind, seq) AS kind FROM e WHERE kind IN ('JobStarted', 'TranscriptFinal') GROUP BY job), d AS (SELECT job, max(seq) AS last FROM e WHERE kind = 'TranscriptDiscarded' GROUP BY job),
s AS (SELECT e.job, count(*) AS n FROM e LEFT JOIN d ON d.job = e.job WHERE kind = 'TranscriptSegment' AND seq > coalesce(last, -1) GROUP BY e.job)
SELECT l.job, CASE kind WHEN 'TranscriptFinal' THEN 'done' ELSE 'running' END AS state, coalesce(n, 0)::BIGINT AS segments FROM l LEFT JOIN s ON s.job = l.job""")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.outcomes(_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT seq, job FROM e WHERE job IS NOT NULL AND NOT (job % 10 = (seq % 7))")
def stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session follows the jobs whose last digit is its number."""
    events = _events(spark, sf_dir).withColumn("session", F.col("seq") % 7)
    followed = events.select((F.col("job") % 10).alias("session"), "job").distinct()
    return jobs.stale(events, followed).select("seq", "job")


@query(f"""WITH {EVENTS}, o AS (SELECT job, seq, kind, lag(kind) OVER (PARTITION BY job ORDER BY seq) AS previous FROM e)
SELECT job, seq, kind, previous FROM o WHERE NOT coalesce(CASE WHEN previous IS NULL THEN kind = 'JobStarted' WHEN previous = 'TranscriptFinal' THEN false WHEN previous = 'TranscriptDiscarded' THEN kind IN ('JobProgress', 'TranscriptSegment', 'TranscriptFinal')
  ELSE kind IN ('JobProgress', 'TranscriptSegment', 'TranscriptDiscarded', 'TranscriptFinal') END, false)""")
def job_sequence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sequence_violations(_events(spark, sf_dir)).select("job", "seq", "kind", "previous")


def orders_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs; what isn't fulfilled hasn't finished."""
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    rows = table(spark, sf_dir, "orders").select(key.alias("job"), (F.col("o_custkey") % 40).alias("service"), state.alias("state"), (key * 10).alias("submitted"))
    return rows.withColumns({"started": F.when(F.col("state") != "queued", F.col("submitted") + F.col("job") % 17), "finished": F.when(F.col("state") == "done", F.col("submitted") + 20 + F.col("job") % 23)})


JOBS = """
j AS (SELECT o_orderkey AS job, o_custkey % 40 AS service, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, o_orderkey * 10 AS submitted FROM orders),
t AS (SELECT *, CASE WHEN state <> 'queued' THEN submitted + job % 17 END AS started, CASE WHEN state = 'done' THEN submitted + 20 + job % 23 END AS finished FROM j)
"""


@query(f"WITH {JOBS} SELECT job, started - submitted AS queued_ms, finished - started AS elapsed_ms FROM t")
def wait_vs_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.wait_and_work(orders_as_jobs(spark, sf_dir)).select("job", "queued_ms", "elapsed_ms")


@query(f"WITH {JOBS}, o AS (SELECT *, row_number() OVER (PARTITION BY service, state = 'done' ORDER BY job DESC) AS k FROM t) SELECT service, job, state FROM o WHERE state <> 'done' OR k <= 32")
def settled_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retained(orders_as_jobs(spark, sf_dir), 32, "service").select("service", "job", "state")


@query("""WITH u AS (SELECT user_id AS worker, ts, event_type AS identity FROM events), l AS (SELECT *, lag(ts) OVER w AS last, lag(identity) OVER w AS was FROM u WINDOW w AS (PARTITION BY worker ORDER BY ts)),
c AS (SELECT worker, last IS NULL OR identity <> was OR epoch(ts) - epoch(last) >= 3600 AS cold FROM l) SELECT worker, count(*) FILTER (cold) AS loads, count(*) FILTER (NOT cold) AS reuses FROM c GROUP BY worker""")
def idle_reload_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of idleness, as the events are hours apart."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts", F.col("event_type").alias("identity"))
    return jobs.loads(uses, idle=3600)


@query()
def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups submit, purchases start the oldest that waits, errors cancel; a few services, so that queues fill."""
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "start").when(kind == "error", "cancel").otherwise("submit")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("service"), F.col("event_id").alias("seq"), op.alias("op"), F.when(kind == "error", F.col("event_id") - 7).otherwise(F.col("event_id")).alias("job"))
    return jobs.admit(rows)


@query()
def progress_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantities of an order's lines as downloads, reported every 40 pieces at least."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_suppkey").cast("string").alias("file"), F.row_number().over(order).alias("seq"), F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("received"), F.lit(None).cast("long").alias("total"))
    return jobs.throttled(rows, 400)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS bad, o_orderkey % 11 = 0 AS relative, o_orderkey % 7 = 0 AS gone, CASE o_orderkey % 5 WHEN 0 THEN 'doc' WHEN 1 THEN 'srt' END AS format, o_orderkey % 6 = 0 AS absent, o_orderkey % 4 = 0 AS full_queue FROM orders)
SELECT k AS o_orderkey, (CASE WHEN bad OR relative OR gone OR format = 'doc' THEN 400 WHEN absent THEN 409 WHEN full_queue THEN 429 ELSE 202 END)::INTEGER AS status, CASE WHEN bad OR relative OR gone OR format = 'doc' THEN 'request' WHEN absent THEN 'model' WHEN full_queue THEN 'queue' END AS error_kind FROM o""")
def admission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 13 != 0).alias("readable"), (k % 11 != 0).alias("absolute"), (k % 7 != 0).alias("exists"), F.when(k % 5 == 0, "doc").when(k % 5 == 1, "srt").alias("format"), (k % 6 != 0).alias("model_present"), (k % 4 == 0).alias("queue_full"))
    return jobs.admission_status(rows).select("o_orderkey", "status", "error_kind")


# -- streams ---------------------------------------------------------------


@query(f"{COUNTERS} SELECT c.job, segments, round(position, 6) AS position, round(fraction, 9) AS fraction, last_seq FROM c LEFT JOIN p ON p.job = c.job")
def stream_counters_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each job by the stream."""
    stream = streams.live_counters(job_events(streams.read_events(spark, sf_dir)))
    out = streams.latest_updates(streams.drain(stream, "counters", "update"), "job")
    return out.withColumns({"position": F.round("position", 6), "fraction": F.round("fraction", 9)})


@query()
def stream_state_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by the stream beside those of its batch twin."""
    stream = streams.reduce_jobs(job_events(streams.read_events(spark, sf_dir)))
    live = streams.latest_updates(streams.drain(stream, "states", "update"), "job")
    twin = streams.reduce_batch(_events(spark, sf_dir)).select("job", *(F.col(c).alias(f"batch_{c}") for c in ("state", "segments", "position", "last_seq")))
    both = live.join(twin, "job", "full")
    same = F.lit(True)
    for c in ("state", "segments", "position", "last_seq"):
        same = same & F.col(c).eqNullSafe(F.col(f"batch_{c}"))
    return both.select("job", "state", "segments", "position", "last_seq", same.alias("same"))


@query()
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions; the last of each job stay open until a later event passes them."""
    frames = job_events(streams.read_events(spark, sf_dir)).where("position >= 20").select("job", "ts")
    return streams.drain(streams.speech_sessions(frames, "6 hours"), "sessions", "append").drop("batch")


# -- views -----------------------------------------------------------------


@query(f"""WITH {JOBS} SELECT t.job, 'talk' || t.job || '.mp3' AS label, state, started - submitted AS queued_ms, finished - started AS elapsed_ms, state = 'done' AS settled, state = 'done' AND t.job % 3 <> 0 AS deletable FROM t""")
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("job").cast("string")
    rows = orders_as_jobs(spark, sf_dir).withColumns({"input": F.concat(F.lit("/in/talk"), key, F.lit(".mp3")), "output": F.when(F.col("job") % 3 != 0, key)})
    return jobs.views(rows)


@query("""SELECT o_orderkey, '{"error":{"kind":"' || CASE o_orderstatus WHEN 'O' THEN 'io' ELSE 'engine' END || '","message":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}}' AS body FROM orders WHERE o_orderstatus <> 'F'""")
def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    kind = F.when(F.col("o_orderstatus") == "O", "io").otherwise("engine")
    return rows.select("o_orderkey", jobs.error_body(kind, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))).alias("body"))


@query(f"WITH {JOBS} SELECT service, median(finished - started)::DOUBLE AS median, min(finished - started) AS least, max(finished - started) AS most, count(finished - started) AS n FROM t GROUP BY service")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.durations(jobs.wait_and_work(orders_as_jobs(spark, sf_dir)), "service")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS place FROM orders WHERE o_orderstatus <> 'P'")
def rows_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return jobs.renumbered(rows, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P").drop("o_orderstatus")
