"""Predicates on paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col, first_that_holds, lookup

# Containers with an audio track, error kinds with their exit codes and what a user can do.
AUDIO_EXTENSIONS = ("wav", "mp3", "mp2", "m4a", "m4b", "aac", "flac", "ogg", "oga", "opus", "wma", "amr", "aiff", "aif", "caf", "ape", "wv", "mp4", "mkv", "mov", "webm", "avi", "ts")
EXIT_CODES = {"io": 3, "decode": 3, "model": 4, "registry": 4, "engine": 5, "network": 6, "cancelled": 7, "sink": 8, "internal": 1}
RECOVERIES = {"model": "get_model", "registry": "get_model", "decode": "pick_another_file", "io": "pick_another_file"}
REFUSALS = {"directory": "这是一个文件夹，不是文件。请打开它，选中里面的音频文件。", "missing": "找不到这个文件。", "not_audio": "看起来不是音频或视频文件。"}
MOST_SERIALS = 999


def last_component(path: ColumnLike) -> Column:
    """The name at the end of a path; the path itself if there is none."""
    name = F.regexp_extract(F.regexp_replace(col(path), "/+$", ""), "([^/]*)$", 1)
    return F.when(name == "", col(path)).otherwise(name)


def parent(path: ColumnLike) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def extension(path: ColumnLike) -> Column:
    """What follows the last dot of the name, in lower case; null for none and for a name that starts with its only dot."""
    return F.nullif(F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1)), F.lit(""))


def looks_like_audio(path: ColumnLike) -> Column:
    return F.coalesce(extension(path).isin(*AUDIO_EXTENSIONS), F.lit(False))


def format_of(ext: ColumnLike) -> Column:
    """``text`` or ``srt`` by extension; null for others."""
    ext = F.lower(col(ext))
    return F.when(ext.isin("txt", "text"), "text").when(ext == "srt", "srt")


def refusal(path: ColumnLike, is_directory: ColumnLike, exists: ColumnLike) -> Column:
    """Why a dropped path is refused; null if it isn't."""
    return first_that_holds([(col(is_directory), REFUSALS["directory"]), (~col(exists), REFUSALS["missing"]), (~looks_like_audio(path), REFUSALS["not_audio"])])


def serial_name(stem: ColumnLike, ext: ColumnLike, serial: ColumnLike) -> Column:
    """``stem.ext``, or ``stem (n).ext``."""
    number = F.when(col(serial).isNotNull(), F.concat(F.lit(" ("), col(serial).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(col(stem), number, F.lit("."), col(ext))


def serial_of(stem: ColumnLike) -> Column:
    return F.nullif(F.regexp_extract(col(stem), r" \((\d+)\)$", 1), F.lit("")).try_cast("int")


def url_join(base: ColumnLike, repo: ColumnLike, remote: ColumnLike) -> Column:
    """The three parts with single slashes between them."""
    return F.concat_ws("/", F.regexp_replace(col(base), "/+$", ""), F.regexp_replace(col(repo), "^/+|/+$", ""), F.regexp_replace(col(remote), "^/+", ""))


def exit_code(kind: ColumnLike) -> Column:
    """The exit code of an error kind; unknown kinds are internal errors."""
    return F.coalesce(lookup(kind, EXIT_CODES), F.lit(EXIT_CODES["internal"]))


def recovery(kind: ColumnLike) -> Column:
    return F.coalesce(lookup(kind, RECOVERIES), F.lit("retry"))


def is_inside(path: ColumnLike, root: ColumnLike) -> Column:
    """Whether a path is at or under a root, component by component."""
    a, b = (F.filter(F.split(col(x), "/"), lambda y: y != "") for x in (path, root))
    return F.slice(a, F.lit(1), F.greatest(F.size(b), F.lit(0))) == b


def safe_key(key: ColumnLike) -> Column:
    """Letters and digits of ASCII alone; an empty key passes."""
    return col(key).rlike("^[A-Za-z0-9]*$")


def safe_id(name: ColumnLike) -> Column:
    """A single normal path component."""
    return (F.length(col(name)) > 0) & ~col(name).rlike(r"[/\\]") & ~col(name).isin(".", "..")


def first_directory(*choices: ColumnLike) -> Column:
    """The first that is set; an empty one isn't."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in choices))


def tool_place(configured: ColumnLike, configured_exists: ColumnLike, bundled: ColumnLike, on_path: ColumnLike) -> Column:
    """Where a tool is taken from: the configured place, the one shipped with the program, then the search path. ``missing`` if it is nowhere, ``misconfigured`` if it isn't where it is said to be."""
    said = col(configured).isNotNull()
    return first_that_holds([(said & col(configured_exists), "configured"), (said, "misconfigured"), (col(bundled), "bundled"), (col(on_path), "path")], "missing")
