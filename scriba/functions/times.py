"""Times of transcripts: subtitle timestamps, durations and exact spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col
from scriba.functions.text import trim_ws

SAMPLE_RATE = 16_000
NANOS = 1_000_000_000


def format_timestamp(ms: ColumnLike) -> Column:
    """``HH:MM:SS,mmm``; the hours have two digits or more."""
    ms = col(ms).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_timestamp(text: ColumnLike) -> Column:
    """Milliseconds of ``H:M:S,f`` with comma or dot; the fraction is a whole number of milliseconds. Null if it is something else or too large."""
    m = r"^(\d+):(\d+):(\d+)(?:[,.](\d+))?$"
    t = trim_ws(text)
    part = [F.regexp_extract(t, m, k).try_cast("bigint") for k in (1, 2, 3)]
    fraction = F.coalesce(F.nullif(F.regexp_extract(t, m, 4), F.lit("")), F.lit("0")).try_cast("bigint")
    seconds = F.try_add(F.try_add(F.try_multiply(part[0], F.lit(3600).cast("long")), F.try_multiply(part[1], F.lit(60).cast("long"))), part[2])
    return F.when(t.rlike(m), F.try_add(F.try_multiply(seconds, F.lit(1000).cast("long")), fraction))


def parse_range(line: ColumnLike) -> tuple[Column, Column]:
    """Start and end of a cue line, in milliseconds; what follows the end is ignored."""
    line = col(line)
    at = F.instr(line, "-->")
    start = F.when(at > 0, F.substring(line, F.lit(1), at - 1))
    end = F.when(at > 0, F.regexp_extract(F.substr(line, at + 3), r"^(?U)\s*(\S+)", 1))
    return parse_timestamp(start), parse_timestamp(end)


def parse_duration_line(line: ColumnLike) -> Column:
    """Seconds of a decoder's ``Duration: HH:MM:SS.ff,`` line; null if it has none or ``N/A``."""
    m = r"Duration: *(\d+):(\d+):(\d+(?:\.\d+)?)"
    h, mins, s = (F.regexp_extract(col(line), m, k).try_cast("double") for k in (1, 2, 3))
    return F.when(col(line).rlike(m), h * 3600 + mins * 60 + s)


def timecode(ms: ColumnLike) -> Column:
    """``MM:SS``; the minutes have two digits or more."""
    ms = col(ms).cast("long")
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60)


def span_of(nanos: ColumnLike) -> Column:
    """Nanoseconds as whole seconds and the rest, which no interval type holds exactly."""
    nanos = col(nanos)
    return F.struct(F.call_function("div", nanos, F.lit(NANOS).cast("long")).alias("secs"), F.pmod(nanos, F.lit(NANOS).cast("long")).cast("int").alias("nanos"))


def nanos_of(span: ColumnLike) -> Column:
    return col(span)["secs"] * NANOS + col(span)["nanos"]


def chunk_nanos(samples: ColumnLike, rate: ColumnLike | int = SAMPLE_RATE, channels: ColumnLike | int = 1) -> Column:
    """How long a chunk of so many samples is; 0 for a rate of 0."""
    rate, channels = (F.lit(x) if isinstance(x, int) else col(x) for x in (rate, channels))
    frames = F.call_function("div", col(samples).cast("long"), F.greatest(channels, F.lit(1)).cast("long"))
    return F.when(rate == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", frames * NANOS, rate.cast("long")))
