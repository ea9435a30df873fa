"""Subtitle queries: a conversation is a file, a turn a segment of 80 ms a character."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.operators import signal, subtitles
from scriba.plans.registry import query, table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh segment is blank."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_id"), F.length("text").cast("long").alias("n"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "  ").otherwise(F.col("text")).alias("text"))
    timed = signal.chunk_starts(turns, seq="seg_id")
    return timed.select("file_id", "seg_id", (F.col("start") * 80).alias("start_ms"), ((F.col("start") + F.col("n")) * 80).alias("end_ms"), "text")


SEGMENTS = r"""
t AS (SELECT conv_id AS file_id, turn AS seg_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
             CASE WHEN (conv_id + turn) % 11 = 0 THEN '  ' ELSE text END AS text FROM conversations),
g AS (SELECT file_id, seg_id, (s * 80)::BIGINT AS start_ms, ((s + n) * 80)::BIGINT AS end_ms, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS shown FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seg_id) AS cue FROM g WHERE shown <> '')
"""
STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""WITH {SEGMENTS} SELECT file_id, string_agg(cue || chr(10) || {STAMP.format("start_ms")} || ' --> ' || {STAMP.format("end_ms")} || chr(10) || shown || chr(10) || chr(10), '' ORDER BY cue) AS srt FROM q GROUP BY file_id""")
def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.to_srt(segments(spark, sf_dir))


@query(f"""WITH {SEGMENTS} SELECT file_id, regexp_replace(string_agg(text, chr(10) ORDER BY seg_id), '^\\n+', '') || CASE WHEN max(length(text)) > 0 THEN chr(10) ELSE '' END AS txt FROM g GROUP BY file_id""")
def text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.to_text(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT file_id, (cue - 1)::INTEGER AS seg_id, start_ms, end_ms, shown AS text FROM q")
def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written reads back as the segments that aren't blank."""
    return subtitles.parse_srt(subtitles.to_srt(segments(spark, sf_dir)), "srt", "file_id")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 WHEN turn % 3 = 1 THEN 1 END::BIGINT AS cues FROM conversations""")
def srt_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank text has no cue, a cue with a header, a dot and settings is one, and a text without a cue is no subtitle file."""
    turn = F.col("turn") % 3
    doc = F.when(turn == 0, " \n ").when(turn == 1, F.concat(F.lit("HEADER\n\nnote\n7\n00:00:01.000 --> 00:00:02,500 align:start\n"), "role", F.lit("\n\n"))).otherwise(F.translate("role", "-", ""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", doc.alias("doc"))
    return subtitles.parses(rows, "doc", "conv_id", "turn").select("conv_id", "turn", "cues")
