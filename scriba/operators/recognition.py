"""Recognising the spans of files so that an interrupted run goes on where it was.

Spans whose result a log has are taken from there, the others go to an engine; what is
new is recorded, and all of it becomes one transcript a file. A run that was resumed gives
the rows of one that never stopped.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriba.functions import engines
from scriba.functions.digests import span_key
from scriba.operators.signal import numbered
from scriba.scratch import materialise
from scriba.sources.sinks import append_log, read_log

SAMPLE_RATE = 16_000
RECORD = "file_id string, span string, seq long, text string"


def recognise_spans(spans: DataFrame, engine: str | engines.Engine, log: str | None = None, number: int = 0, rate: int = SAMPLE_RATE) -> DataFrame:
    """``(file_id, seg_id, start, n, text, reused)`` for ``spans (file_id, start, samples)``; a span in which nothing is heard is no segment.

    With a ``log``, a span counts as done if the log has its start and samples for its
    file, whatever engine recorded it; a run's ``number`` is its own, and a run that comes
    again under its number replaces what it recorded. Recording is best effort: where it
    fails, the transcript is given all the same, with a warning.
    """
    spark = spans.sparkSession
    keyed = spans.select(F.col("file_id").cast("string").alias("file_id"), F.col("start").cast("long").alias("start"), "samples")
    if log is None:
        said = engines.recognise(keyed, engine).select("file_id", "start", F.size("samples").cast("long").alias("n"), "text", F.lit(False).alias("reused"))
        return _transcript(said)
    nanos = F.call_function("div", F.col("start") * 1_000_000_000, F.lit(rate).cast("long"))
    # the engine and the keys are Python, so both are computed once, and the samples go no further
    keyed = materialise(keyed.withColumn("span", span_key(nanos, "samples")), "spans")
    schema = spark.createDataFrame([], RECORD).schema
    known = read_log(spark, log, schema).groupBy("file_id", "span").agg(F.max_by("text", "seq").alias("text"))
    fresh = engines.recognise(keyed.join(known, ["file_id", "span"], "left_anti"), engine)
    fresh = materialise(fresh.select("file_id", "span", "start", F.size("samples").cast("long").alias("n"), "text"), "heard")
    stored = keyed.select("file_id", "span", "start", F.size("samples").cast("long").alias("n")).join(known, ["file_id", "span"])
    stored = materialise(stored.select("file_id", "span", "start", "n", "text"), "stored")
    said = stored.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
    try:
        # what was reused may be this run's own record, which is replaced; the log takes what no other run has
        append_log(said.select("file_id", "span", F.col("start").alias("seq"), "text"), log, "file_id", "span", number=number)
    except Exception as e:  # noqa: BLE001 - whatever keeps a store from taking it
        warnings.warn(f"the results weren't recorded: {e}", stacklevel=2)
    return _transcript(said)


def _transcript(said: DataFrame) -> DataFrame:
    """Segments in the order of their start, numbered over the whole of a file."""
    return numbered(said.where(F.length("text") > 0), "file_id", "start").select("file_id", "seg_id", "start", "n", "text", "reused")
