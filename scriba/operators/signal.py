"""Signals: loudness windows, coverage of a segmentation, blocks and silence-gap sessions.

Rows carry arrays of samples; what happens inside a row are array functions, what
happens between rows of a file are windows over its order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriba.functions.columns import ColumnLike, col
from scriba.operators.scans import as_of, running

# What the guard takes as silence, sound, and too little.
WINDOW_SECONDS, RANGE_DB, SILENCE_PEAK = 0.1, 25.0, 1e-3
FLOOR, MIN_ENERGETIC = 0.70, 1.0
BLOCK_SECONDS, SAMPLE_RATE = 20, 16_000
THRESHOLDS = (0.02, 1.0)
THRESHOLD, MIN_SILENCE, MIN_SPEECH, MAX_SPAN, PAD, HOP = 0.05, 0.25, 0.25, 20.0, 0.4, 512


def rms(samples: ColumnLike) -> Column:
    """The root of the mean square; 0 for no samples."""
    total = F.aggregate(col(samples), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(col(samples)) > 0, F.sqrt(total / F.size(col(samples)))).otherwise(0.0)


def blocks(samples: ColumnLike, size: int) -> Column:
    """The samples in consecutive blocks; the last may be short, and none is lost."""
    n = F.size(col(samples))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(col(samples), i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<float>>"))


def windows_of(chunks: DataFrame, size: int, file: str = "file_id", seq: str = "seq", samples: str = "samples") -> DataFrame:
    """One row for each window of each chunk: ``file, seq, window, n, rms``."""
    cut = chunks.select(file, seq, F.posexplode(blocks(samples, size)).alias("window", "block"))
    return cut.select(file, seq, "window", F.size("block").cast("long").alias("n"), rms("block").alias("rms"))


def energetic(windows: DataFrame, file: str = "file_id", range_db: float = RANGE_DB, silence: float = SILENCE_PEAK) -> DataFrame:
    """``windows (rms)`` with ``peak``, the loudest of the file, and whether each is loud enough beside it.

    The peak is an aggregate that joins back, so a file with very many windows isn't
    gathered in one task.
    """
    peak = windows.groupBy(file).agg(F.max("rms").alias("peak"))
    out = windows.join(peak, file)
    return out.withColumn("energetic", (F.col("peak") >= silence) & (F.col("rms") >= F.col("peak") * 10 ** (-range_db / 20)))


def union_length(spans: DataFrame, file: str = "file_id", seq: str = "seq", start: str = "start", n: str = "n") -> DataFrame:
    """``(file, voiced)``: samples that spans cover, in the order of their arrival; what an earlier span reached counts once."""
    rows = spans.select(file, seq, F.col(start).alias("_from"), (F.col(start) + F.col(n)).alias("_to"))
    rows = running(rows, file, seq, {"_reached": ("max", F.col("_to"))}).withColumn("_mark", F.coalesce("_reached", F.lit(0)))
    return rows.groupBy(file).agg(F.sum(F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", "_mark"))).alias("voiced"))


def coverage_ratio(voiced: ColumnLike, energetic: ColumnLike) -> Column:
    """How much of the sound a segmentation kept, 1 at most; null where there is no sound."""
    return F.when(col(energetic) > 0, F.least(col(voiced) / F.nullif(col(energetic), F.lit(0)), F.lit(1.0)))


def should_recover(voiced: ColumnLike, energetic: ColumnLike, floor: float = FLOOR, least: float = MIN_ENERGETIC) -> Column:
    """Whether a segmentation kept too little: never for a floor of 0, nor where there is too little sound to judge."""
    if floor <= 0:
        return F.lit(False)
    return F.when(col(energetic) < least, False).otherwise(F.coalesce(coverage_ratio(voiced, energetic) < floor, F.lit(False)))


def chunk_starts(chunks: DataFrame, file: str = "file_id", seq: str = "seq", n: str = "n") -> DataFrame:
    """``chunks`` with ``start``: the samples before each."""
    return running(chunks, file, seq, {"start": ("sum", F.col(n))}).withColumn("start", F.col("start").cast("long"))


def fixed_blocks(chunks: DataFrame, size: int = BLOCK_SECONDS * SAMPLE_RATE, file: str = "file_id", n: str = "n") -> DataFrame:
    """``(file, block, start, n)``: a file's samples in contiguous blocks, whatever its chunks are; the last is short."""
    total = chunks.groupBy(file).agg(F.sum(n).alias("total")).where("total > 0")
    rows = total.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("total") - 1, F.lit(size).cast("long")))))
    return rows.select(file, "block", (F.col("block") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("total") - F.col("block") * size).alias("n"))


def gap_sessions(frames: DataFrame, file: str = "file_id", ts: str = "ts", score: str = "score", threshold: float = THRESHOLD, gap: str = "250 milliseconds") -> DataFrame:
    """``(file, start, end, frames)``: runs of frames with enough speech, ended by a gap of silence."""
    speech = frames.where(F.col(score) >= threshold)
    out = speech.groupBy(file, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.select(file, "start", "end", "frames")


def frames_of(chunks: DataFrame, hop: int = HOP, file: str = "file_id", start: str = "start", samples: str = "samples") -> DataFrame:
    """``(file, frame, start, samples)``: a file's samples in frames of ``hop``, whatever its chunks are; the last may be short.

    Frames that lie inside a chunk stay where it is. Only the parts of frames at its two
    ends are brought together, so what is shuffled is the edges between chunks.
    """
    n, first = F.size(samples).cast("long"), F.col(start).cast("long")
    div = lambda x: F.call_function("div", x, F.lit(hop).cast("long"))
    cut = chunks.where(n > 0).select(file, first.alias("_at"), F.col(samples).alias("_samples"), F.explode(F.sequence(div(first), div(first + n - 1))).alias("frame"))
    low, high = F.greatest(F.col("_at"), F.col("frame") * hop), F.least(F.col("_at") + F.size("_samples"), (F.col("frame") + 1) * hop)
    cut = cut.select(file, "frame", (low - F.col("frame") * hop).alias("_offset"), F.slice("_samples", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int")).alias("samples"))
    whole = F.size("samples") == hop
    parts = cut.where(~whole).groupBy(file, "frame").agg(F.array_sort(F.collect_list(F.struct("_offset", "samples"))).alias("_parts"))
    joined = parts.select(file, "frame", F.flatten(F.transform("_parts", lambda x: x["samples"])).alias("samples"))
    both = cut.where(whole).select(file, "frame", "samples").unionByName(joined)
    return both.select(file, "frame", (F.col("frame") * hop).alias("start"), "samples")


def voice_spans(frames: DataFrame, threshold: float, silence: int, shortest: int, longest: int, file: str = "file_id") -> DataFrame:
    """``(file, start, n)``: spans of ``frames (file, start, n, score)`` with enough speech, in samples.

    A span ends where ``silence`` samples go by without speech. One that is longer than
    ``longest`` is cut; what is left, and a span as a whole, must have ``shortest``.
    Spans are numbered by running values over a file's frames, so a file of any length is
    as many tasks as it needs.
    """
    speech = frames.where(F.col("score") >= threshold).select(file, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("_end"))
    speech = running(speech, file, "start", {"_before": ("last", F.col("_end"))})
    opens = F.coalesce((F.col("start") - F.col("_before") >= silence), F.lit(True)).cast("long")
    speech = running(speech.withColumn("_opens", opens), file, "start", {"_span": ("sum", F.col("_opens"))}, through=True)
    spans = speech.groupBy(file, "_span").agg(F.min("start").alias("_from"), F.max("_end").alias("_to"))
    length = F.col("_to") - F.col("_from")
    parts = spans.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", length - 1, F.lit(longest).cast("long")))))
    begin = F.col("_from") + F.col("_part") * longest
    n = F.least(F.col("_to") - begin, F.lit(longest).cast("long"))
    return parts.where(n >= min(shortest, longest)).select(file, begin.alias("start"), n.alias("n"))


def speech_spans(sessions: DataFrame, start: str = "start_s", end: str = "end_s", shortest: float = MIN_SPEECH, longest: float = MAX_SPAN, pad: float = PAD) -> DataFrame:
    """Sessions as spans: short ones dropped, long ones split, each with some context before it."""
    long_enough = sessions.where(F.col(end) - F.col(start) >= shortest)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil((F.col(end) - F.col(start)) / longest) - 1, F.lit(0)).cast("int"))
    rows = long_enough.withColumn("part", F.explode(parts))
    begin = F.col(start) + F.col("part") * longest
    finish = F.least(F.col(end), begin + longest)
    return rows.withColumns({"span_start": F.greatest(begin - F.when(F.col("part") == 0, pad).otherwise(0.0), F.lit(0.0)), "span_end": finish})


def two_pass(first: DataFrame, second: DataFrame, verdicts: DataFrame, file: str = "file_id") -> DataFrame:
    """Segments of the first pass where it can be trusted, of the second where ``verdicts (recovered)`` says so."""
    good = first.join(verdicts.where("not recovered").select(file), file, "left_semi").withColumn("recovered", F.lit(False))
    bad = second.join(verdicts.where("recovered").select(file), file, "left_semi").withColumn("recovered", F.lit(True))
    return good.unionByName(bad)


def numbered(rows: DataFrame, file: str, order: str) -> DataFrame:
    """``rows`` with ``seg_id``, their place in a file from 0."""
    return running(rows, file, order, {"seg_id": ("count", F.lit(1))}).withColumn("seg_id", F.col("seg_id").cast("int"))


def segments_of(spans: DataFrame, file: str = "file_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Recognised spans as segments numbered from 0; a span without text is none."""
    return numbered(spans.where(F.length(text) > 0), file, seq)


def with_context(spans: DataFrame, chunks: DataFrame, pad: int, retained: int | None = None, file: str = "file_id") -> DataFrame:
    """``spans (file, span, start, n, seen)`` with ``context``: the ``pad`` samples before each, out of as many of ``chunks (file, start, samples)`` as they reach into.

    ``seen`` is how many samples had arrived when the span was closed. With ``retained``,
    history is kept as a segmenter keeps it: cut to so many samples whenever it has grown
    to over twice as many, at the end of a chunk. A span whose context begins before what is left goes
    without any.

    Chunks are joined by the blocks of samples that they touch, so a span meets the few
    chunks it needs, however many its file has.
    """
    size = max(pad, 1)
    block = lambda at: F.call_function("div", at, F.lit(size).cast("long"))
    n = F.size("samples").cast("long")
    parts = chunks.where(n > 0).select(file, F.col("start").alias("_at"), "samples", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + n - 1))).alias("_block"))
    begin = F.greatest(F.col("start") - pad, F.lit(0).cast("long"))
    wanted = spans.withColumn("_from", begin).where("_from < start")
    if retained is not None:
        ends = chunks.withColumn("_end", F.col("start") + n)
        wanted = _retained(wanted, ends, retained, file).where("_from >= _kept").drop("_kept")
    wanted = wanted.select(file, "span", "start", "_from", F.explode(F.sequence(block(F.col("_from")), block(F.col("start") - 1))).alias("_block"))
    met = wanted.join(parts, [file, "_block"]).dropDuplicates([file, "span", "_at"])
    cut = F.slice("samples", (F.greatest(F.col("_from"), F.col("_at")) - F.col("_at") + 1).cast("int"), F.greatest(F.least(F.col("start"), F.col("_at") + n) - F.greatest(F.col("_from"), F.col("_at")), F.lit(0)).cast("int"))
    found = met.groupBy(file, "span").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", cut.alias("x")))), lambda y: y["x"])).alias("context"))
    return spans.join(found, [file, "span"], "left")


def _retained(spans: DataFrame, ends: DataFrame, retained: int, file: str) -> DataFrame:
    """``spans`` with ``_kept``: the first sample that is left when so many have been ``seen``.

    Each cut depends on the one before it, so a file's chunks are one fold; it keeps two
    numbers, and gives out one row for each cut.
    """
    schema = T.StructType([ends.schema[file], T.StructField("_cut_at", T.LongType()), T.StructField("_left", T.LongType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, kept = None, 0
        for pdf in pdfs:
            out = []
            for own, end in zip(pdf[file], pdf["_end"], strict=True):
                if own != name:
                    name, kept = own, 0
                if end - kept > 2 * retained:
                    kept = end - retained
                    out.append((own, end, kept))
            yield pd.DataFrame(out, columns=schema.names)

    cuts = ends.select(file, "_end").repartition(file).sortWithinPartitions(file, "_end").mapInPandas(run, schema)
    return as_of(spans, cuts, file, "seen", "_cut_at", ["_left"]).withColumn("_kept", F.coalesce("_left", F.lit(0).cast("long"))).drop("_left")


def checked_threshold(threshold: ColumnLike) -> Column:
    """The threshold, if it is one: from 0.02 to 1. Anything else is an error."""
    value = col(threshold)
    wrong = F.raise_error(F.concat(F.lit("threshold "), F.coalesce(value.cast("string"), F.lit("null")), F.lit(" is not between 0.02 and 1")))
    return F.when(value.between(*THRESHOLDS), value).otherwise(wrong.cast("double"))


def swept(spans: DataFrame, chunks: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """What a sweep over each file's chunks gives out in order: ``file, at, ordinal, kind, seg_id``.

    After each of ``chunks (file, end)`` come the segments of the recognised ``spans
    (file, end, text)`` that it completes, those with text alone, and then the progress.
    """
    bounds = chunks.select(file, "end")
    known = numbered(spans.where(F.length(text) > 0), file, "end")
    last = chunks.groupBy(file).agg(F.max("end").alias("_last"))
    closed = known.join(last, file).select(file, F.least("end", "_last").alias("_at"), "seg_id")
    marks = bounds.select(file, F.col("end").alias("at"), F.lit(1).alias("ordinal"), F.lit("progress").alias("kind"), F.lit(None).cast("int").alias("seg_id"))
    # a span belongs to the first chunk that ends with it or after it, that is, the last one in the order of falling ends
    falling = lambda rows, number: rows.select(file, (-F.col("_at")).alias("_falling"), number.cast("int").alias("seg_id"))
    met = as_of(falling(closed, F.col("seg_id")), bounds.select(file, (-F.col("end")).alias("_since"), F.col("end").alias("at")), file, "_falling", "_since", ["at"])
    return marks.unionByName(met.select(file, "at", F.lit(0).alias("ordinal"), F.lit("segment").alias("kind"), "seg_id"))


def padded(chunks: DataFrame, pad: int, file: str = "file_id", seq: str = "seq", samples: str = "samples") -> DataFrame:
    """``chunks`` with the last ``pad`` samples of the chunk before each in front of it, as far as there are any."""
    own = F.col(samples)
    ends = F.slice(own, F.greatest(F.size(own) - pad + 1, F.lit(1)), F.lit(pad))
    rows = running(chunks, file, seq, {"_tail": ("last", F.coalesce(ends, F.array().cast(chunks.schema[samples].dataType)))})
    return rows.withColumn("padded", F.when(F.col("_tail").isNull(), own).otherwise(F.concat("_tail", own))).drop("_tail")
