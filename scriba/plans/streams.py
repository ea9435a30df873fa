"""Queries of streams whose results equal those of their batch twins, over all events or orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.plans.jobs import COUNTERS, JOBS, job_events, orders_as_jobs
from scriba.plans.registry import query, table
from scriba.scratch import scratch_dir
from scriba.sources import pcm
from scriba.streaming import changes, ordered
from scriba.streaming import jobs as streams

_HOUR = 3_600_000_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex[:12]}/{name}"


def _in_parts(rows: DataFrame, n: int, order: str) -> DataFrame:
    """A stream that gets ``rows`` in so many parts, one each batch, by the order of a number; what one holds is late by no more than that order says.

    Each part is written by as many tasks as its rows are read by, up to one a core. The
    stream takes as many files at once, by their age, so every part has just as many.
    """
    spark = rows.sparkSession
    at = _folder(spark, "parts")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // n + 1)
    files = max(1, min(spark.sparkContext.defaultParallelism, rows._jdf.queryExecution().toRdd().getNumPartitions()))
    for k in range(n):
        folder = f"{at}/n={k:04d}"
        rows.where(F.call_function("div", F.col(order) - F.lit(low), F.lit(width).cast("long")) == k).repartition(files).write.parquet(folder)
        for _ in range(files - len(spark.read.parquet(folder).inputFiles())):  # tasks without a row write no file, but for the first
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/*")


@query("""WITH f AS (SELECT user_id AS job, epoch_us(ts) AS a FROM events WHERE value >= 20),
o AS (SELECT *, CASE WHEN a - lag(a) OVER w - 60000000 >= 21600000000 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY job ORDER BY a)),
k AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY a ROWS UNBOUNDED PRECEDING) AS span FROM o),
g AS (SELECT job, min(a) AS a, max(a) + 60000000 AS b FROM k GROUP BY job, span),
p AS (SELECT job, a, b, unnest(range(0, (b - a - 1) // 14400000000 + 1)) AS part FROM g)
SELECT job, (a + part * 14400000000)::BIGINT AS start, least(b - a - part * 14400000000, 14400000000)::BIGINT AS n FROM p WHERE least(b - a - part * 14400000000, 14400000000) >= 1800000000""")
def stream_voice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a minute; six hours of silence end a span, which has half an hour at least and four hours at most."""
    events = table(spark, sf_dir, "events").where("value >= 20").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.lit(60_000_000).cast("long").alias("n"), "event_id")
    frames = _in_parts(events.withColumn("at", F.unix_micros("ts")).drop("event_id"), 4, "at")
    out = streams.drain(ordered.speech_spans(frames, 6 * _HOUR, _HOUR // 2, 4 * _HOUR), "spans", "update")
    return ordered.so_far(out, "job").drop("settled")


@query("""WITH u AS (SELECT user_id AS worker, ts, event_type AS identity FROM events), l AS (SELECT *, lag(ts) OVER w AS last, lag(identity) OVER w AS was FROM u WINDOW w AS (PARTITION BY worker ORDER BY ts)),
c AS (SELECT worker, last IS NULL OR identity <> was OR epoch(ts) - epoch(last) >= 3600 AS cold FROM l) SELECT worker, count(*) FILTER (cold) AS loads, count(*) FILTER (NOT cold) AS reuses FROM c GROUP BY worker""")
def stream_model_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's twin of ``idle_reload_count``."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("identity"))
    rows = _in_parts(uses.withColumn("at", F.unix_micros("ts")), 4, "at").drop("at")
    out = streams.drain(ordered.model_loads(rows, idle=3600), "loads", "update")
    return ordered.so_far(out, "worker").select("worker", "loads", "reuses")


@query(f"WITH {JOBS}, o AS (SELECT *, row_number() OVER (PARTITION BY service, state = 'done' ORDER BY job DESC) AS k FROM t) SELECT service, job, state FROM o WHERE state <> 'done' OR k <= 32")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's twin of ``settled_retention``."""
    rows = _in_parts(orders_as_jobs(spark, sf_dir).select("service", "job", "state"), 4, "job")
    out = streams.latest_updates(streams.drain(ordered.retained_jobs(rows, 32), "retention", "update"), "job")
    return out.where("kept").select("service", "job", "state")


@query(f"{COUNTERS} SELECT c.job, segments, round(position, 6) AS position, last_seq FROM c LEFT JOIN p ON p.job = c.job WHERE segments % 3 <> 0")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose number of segments three doesn't divide come and go; a snapshot and what changed after it give those that are there at last."""
    rows = _in_parts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), 5, "event_id")
    counters = streams.live_counters(job_events(rows)).where("segments % 3 <> 0")
    out = changes.folded(changes.drain_changes(counters, "changes", "job", every=3), "job")
    return out.select("job", "segments", F.round("position", 6).alias("position"), "last_seq")


@query("""WITH x AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
s AS (SELECT label, k * 64 + unnest(range(0, 64)) AS q, unnest(embedding)::DOUBLE AS v FROM x)
SELECT label::VARCHAR AS file, (q // 1600)::BIGINT AS seq, count(*) AS n, round(sum(v), 4) AS total FROM s GROUP BY ALL HAVING count(*) = 1600""")
def stream_pcm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as a file of samples that grows; the stream goes on from its checkpoint, and gives each chunk when it is whole."""
    at, place = _folder(spark, "pcm"), _folder(spark, "pcm-stream")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    middle = rows.agg(F.expr("percentile_approx(vec_id, 0.5)")).first()[0]
    pcm.register(spark)
    out = None
    for part in (rows.where(F.col("vec_id") <= middle), rows):
        pcm.write_samples(part, at, "label", "vec_id", "embedding")
        out = streams.drain(spark.readStream.format("pcm").load(at), "pcm", "append", place)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(F.regexp_extract("file_id", r"([^/]+)\.f32$", 1).alias("file"), "seq", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"))
