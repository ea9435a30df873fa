"""Subtitles and plain text: render segments, parse files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.functions.text import is_blank, trim_ws
from scriba.functions.times import format_timestamp, parse_range


def cues(segments: DataFrame, file: str = "file_id") -> DataFrame:
    """``(file, cue, body)`` for ``segments (file, seg_id, start_ms, end_ms, text)``: blank ones are left out, and cues numbered from 1 after that."""
    shown = segments.where(~is_blank("text"))
    shown = shown.withColumn("cue", F.row_number().over(Window.partitionBy(file).orderBy("seg_id")))
    body = F.concat(F.col("cue").cast("string"), F.lit("\n"), format_timestamp("start_ms"), F.lit(" --> "), format_timestamp("end_ms"), F.lit("\n"), trim_ws("text"), F.lit("\n\n"))
    return shown.select(file, "cue", body.alias("body"))


def to_srt(segments: DataFrame, file: str = "file_id") -> DataFrame:
    """``(file, srt)``: one document for each file that has a cue. A document is one value, so a task holds it; ``sources.documents`` writes files without."""
    return cues(segments, file).groupBy(file).agg(_in_order("cue", "body", "").alias("srt"))


def _in_order(key: str, text: str, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(key, text)))
    return F.array_join(F.transform(rows, lambda x: x[text]), sep)


def to_text(segments: DataFrame, file: str = "file_id") -> DataFrame:
    """``(file, txt)``: segments a line each, with a line feed at the end unless all are empty.

    Blank segments keep their line, but empty ones at the start add none. A task holds the
    text of a file; ``sources.documents`` writes it without.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "text"))), lambda x: x["text"])
    joined = F.regexp_replace(F.array_join(lines, "\n"), "^\n+", "")
    out = segments.groupBy(file).agg(joined.alias("joined"))
    return out.select(file, F.when(F.col("joined") == "", "").otherwise(F.concat("joined", F.lit("\n"))).alias("txt"))


def parse_srt(documents: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(*keys, seg_id, start_ms, end_ms, text)``: the cues of each document, numbered from 0.

    Blocks are what blank lines separate; the first line with an arrow anchors a block,
    what stands above it is ignored, and settings after the end are too. Blocks without
    a readable range or without text are left out.
    """
    parts = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n(?:(?U)[\s&&[^\n]]*\n)+")
    rows = documents.select(*keys, F.posexplode(parts).alias("_block", "_body"))
    lines = F.split("_body", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains("-->")), True)
    rows = rows.withColumns({"_lines": lines, "_at": at.cast("int")}).where("_at > 0")
    start, end = parse_range(F.get("_lines", F.col("_at") - 1))
    body = F.array_join(F.slice("_lines", F.col("_at") + 1, F.greatest(F.size("_lines") - F.col("_at"), F.lit(0))), "\n")
    rows = rows.select(*keys, "_block", start.alias("start_ms"), end.alias("end_ms"), trim_ws(body).alias("text"))
    rows = rows.where("start_ms is not null and end_ms is not null and text <> ''")
    order = Window.partitionBy(*keys).orderBy("_block")
    return rows.select(*keys, (F.row_number().over(order) - 1).alias("seg_id"), "start_ms", "end_ms", "text")


def parses(documents: DataFrame, text: str, *keys: str) -> DataFrame:
    """``documents`` with ``cues``: how many each has; null where a text that isn't blank has none, as that is no subtitle file."""
    n = parse_srt(documents, text, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("cues"))
    out = documents.join(n, list(keys), "left")
    return out.withColumn("cues", F.when(is_blank(text), F.lit(0).cast("long")).otherwise(F.col("cues")))
