"""Text functions, Column to Column. None of them runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col, lookup

# Language codes, and error kinds whose message gets a prefix.
LANGUAGE_CODES = {"Auto": "auto", "Chinese": "zh", "English": "en", "Cantonese": "yue", "Japanese": "ja", "Korean": "ko"}
MESSAGE_PREFIXES = {"decode": "无法读取这个文件：", "model": "模型不可用：", "network": "下载失败："}


def trim_ws(text: ColumnLike) -> Column:
    """Without any Unicode white space at both ends; ``trim`` would take spaces alone."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: ColumnLike) -> Column:
    return F.length(trim_ws(text)) == 0


def blank_to_null(text: ColumnLike) -> Column:
    """The text as it is, or null if it is blank."""
    return F.when(~is_blank(text), col(text))


def collapse_ws(text: ColumnLike) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def normalize(text: ColumnLike) -> Column:
    """What is scored: letters and digits of any script, in lower case, character by character.

    A capital sigma is lowered first, as ``lower`` would make a final one of it.
    """
    return F.lower(F.translate(F.regexp_replace(col(text), r"[^\p{IsAlphabetic}\p{N}]", ""), "Σ", "σ"))


def clean_markers(text: ColumnLike) -> Column:
    """Without ``<|...|>`` markers; an unterminated one takes the rest of the text with it."""
    return trim_ws(F.regexp_replace(F.regexp_replace(col(text), r"(?s)<\|.*?\|>", ""), r"(?s)<\|.*$", ""))


def language_code(name: ColumnLike) -> Column:
    return lookup(name, LANGUAGE_CODES)


def plural(n: ColumnLike, noun: str) -> Column:
    return F.when(col(n) == 1, F.lit(f"1 {noun}")).otherwise(F.concat(col(n).cast("string"), F.lit(f" {noun}s")))


def describe_coverage(ratio: ColumnLike, recovered: ColumnLike) -> Column:
    """What the coverage of one file means, in a few words."""
    kept = F.when(col(ratio).isNull(), "no sound to judge").otherwise(F.format_string("%.0f%% kept", col(ratio) * 100))
    return F.when(col(recovered), F.concat(kept, F.lit(", detector lost it and the file was re-read"))).otherwise(kept)


def without_newlines(text: ColumnLike) -> Column:
    """What is scored of a rendered text: its segments one after the other."""
    return F.replace(col(text), F.lit("\n"), F.lit(""))


def message_for(kind: ColumnLike, message: ColumnLike) -> Column:
    """An error's own words, after what its kind means to a user."""
    return F.concat(F.coalesce(lookup(kind, MESSAGE_PREFIXES), F.lit("")), col(message))


# How lines of a decoder's description of its input start.
BANNERS = ("Input #", "Output #", "Duration:", "Stream #", "Stream mapping:", "Press [q]")


def complaint(messages: ColumnLike) -> Column:
    """The lines of a decoder's messages that tell what went wrong."""
    lines = F.transform(F.split(col(messages), r"\r?\n"), trim_ws)

    def banner(line: Column) -> Column:
        out = line.contains("Guessed Channel Layout")
        for shape in BANNERS:
            out = out | line.startswith(shape)
        return out

    return F.array_join(F.filter(lines, lambda x: (F.length(x) > 0) & ~banner(x)), "\n")
