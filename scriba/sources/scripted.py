"""A scripted job: twelve segments of a second, each followed by its progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.operators import jobs

SEGMENTS = 12


def scripted_events(spark: SparkSession, count: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """``job, seq, ts, kind, position, fraction`` of so many jobs that all run through."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.array(
        F.struct(F.lit(jobs.SEGMENT).alias("kind"), i.cast("double").alias("position"), F.lit(None).cast("double").alias("fraction")),
        F.struct(F.lit(jobs.PROGRESS).alias("kind"), (i + 1).cast("double").alias("position"), ((i + 1) / segments).alias("fraction")),
    ))
    edge = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("position"), F.lit(None).cast("double").alias("fraction"))
    every = F.concat(F.array(edge(jobs.STARTED)), F.flatten(steps), F.array(edge(jobs.FINAL), edge(jobs.FINISHED)))
    rows = spark.range(1, count + 1).select(F.col("id").alias("job"), F.posexplode(every).alias("n", "e"))
    return rows.select("job", (F.col("job") * 1000 + F.col("n")).alias("seq"), F.timestamp_seconds(F.col("job") * 60 + F.col("n")).alias("ts"), "e.kind", "e.position", "e.fraction")
