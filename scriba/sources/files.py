"""Readers of text, JSON and folders. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriba.functions.digests import file_label
from scriba.functions.paths import extension, looks_like_audio, parent
from scriba.operators.scans import running
from scriba.scratch import materialise

# The version that stored documents must have, and the columns that may hold a reference.
VERSION = 1
TRANSCRIPT_EXTENSIONS = ("srt", "txt", "text")
REFERENCE_COLUMNS = ("target_text", "original_text", "answer")

SPAN = "struct<secs: bigint, nanos: int>"
SEGMENTS = f"array<struct<id: bigint, start: {SPAN}, end: {SPAN}, text: string>>"
CACHE_ENTRY = f"version int, transcript struct<segments: {SEGMENTS}, language: string>, coverage struct<decoded_seconds: double, voiced_seconds: double, energetic_seconds: double>, recovered boolean"
RESUME_RECORD = f"span string, segments {SEGMENTS}"
HISTORY = "version int, entries array<struct<input: string, output: string, engine: string, finished_at_ms: bigint>>"
OWNERSHIP = "version int, outputs map<string, string>"
SETTINGS = "version int, close string"
PENDING = "version int, files array<string>, engine string"
JOB_REQUEST = "input string, format string, engine string, hotwords string, noCache boolean"
CATALOGUE = (
    "version int, models array<struct<id: string, display_name: string, description: string, files: array<struct<remote: string, local: string, size: bigint, sha256: string>>,"
    " requires: array<string>, mirrors: array<struct<name: string, base_url: string, repo: string>>>>"
)


#: Byte ranges whose line counts are broadcast to where the lines are; those of more are joined by a shuffle.
BROADCAST_RANGES = 100_000


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, line, value``: the lines of text files, numbered from 1 in each file.

    A large file is read in byte ranges, as Spark cuts it. A range numbers its own lines
    by the order in which a task gives ids to rows; the ranges' line counts, summed up in
    the order of the file, say where each begins. So the session must not change how files
    are cut before the rows are read. Lines end with a line feed, and keep a carriage
    return before it.
    """
    read = spark.read.option("lineSep", "\n").text(list(paths))
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"), "value")
    ranges = materialise(rows.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")), "ranges")
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = F.broadcast(starts) if ranges.count() <= BROADCAST_RANGES else starts
    return rows.join(starts, ["file", "_range"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """``dataset, line, utt_id, path, reference`` of tab-separated manifests.

    A line has three fields; further tabs belong to the reference. A line with fewer,
    also a blank one, is an error that names its number. Paths are relative to the
    manifest's folder, and the folder's name is the dataset.
    """
    rows = read_lines(spark, *paths)
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", 3)
    bad = F.raise_error(F.format_string("%s: line %d needs three fields", "file", "line"))
    rows = rows.select("file", F.col("line").cast("int").alias("line"), F.when(F.size(fields) == 3, fields).otherwise(F.when(F.size(fields) < 3, bad).cast("array<string>")).alias("x"))
    folder = parent("file")
    return rows.select(F.regexp_extract(folder, "([^/]*)$", 1).alias("dataset"), "line", F.col("x")[0].alias("utt_id"), F.concat_ws("/", folder, F.col("x")[1]).alias("path"), F.col("x")[2].alias("reference"))


def pick_reference(columns: list[str]) -> Column:
    """The first of the reference columns that a table has, even where its values are null."""
    for c in REFERENCE_COLUMNS:
        if c in columns:
            return F.col(c)
    raise ValueError(f"a corpus needs one of the columns {', '.join(REFERENCE_COLUMNS)}")


def audio_corpus(rows: DataFrame, order: str) -> DataFrame:
    """``id, bytes, reference`` of a corpus with ``audio`` or ``context`` structs; rows without bytes or reference are skipped.

    Ids have six digits and run in the order of ``order`` over what remains, numbered
    range by range.
    """
    audio = [F.col(c)["bytes"] for c in ("audio", "context") if c in rows.columns]
    kept = rows.select(order, F.coalesce(*audio).alias("bytes"), F.trim(F.regexp_replace(pick_reference(rows.columns), r"(?U)\s+", " ")).alias("reference"))
    kept = kept.where("bytes is not null and length(bytes) > 0 and reference is not null and reference <> ''")
    return numbered(kept, order).select(F.format_string("%06d", "number").alias("id"), "bytes", "reference")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in the order of a column; a large table is numbered in blocks (``operators.scans``)."""
    return running(rows.withColumn("_all", F.lit(0)), "_all", order, {"number": ("count", F.lit(1))}).drop("_all")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, size, modified`` of all files below a folder; their contents aren't read. ``identified`` tells two states of a file apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def identified(files: DataFrame) -> DataFrame:
    """``files`` with ``key``: place, size and time, in nanoseconds."""
    nanos = F.unix_micros(F.col("modified").cast("timestamp")) * 1000
    return files.withColumn("key", file_label("path", "size", nanos))


READERS = {"cache": "read_cache", "history": "read_history", "ownership": "read_ownership", "settings": "read_settings", "pending": "read_pending", "resume": "read_resume_log", "manifest": "read_manifest", "vocabulary": "read_vocabulary", "folder": "list_files"}


def source(kind: str) -> Callable[..., DataFrame]:
    """The reader of a kind of source; an unknown kind is an error that names those there are."""
    if kind not in READERS:
        raise KeyError(f"no source '{kind}'; there are {', '.join(sorted(READERS))}")
    return globals()[READERS[kind]]


def plan_outputs(inputs: list[str], output: str | None, default: str, output_is_file: bool = False) -> tuple[str | None, str | None]:
    """``(path, folder)`` of a batch: the path of a single input as it was named, else the folder that ``store.output_names`` names files in.

    ``-`` and what is, or is named like, a file hold one transcript only; more are an error.
    """
    if output is not None and len(inputs) == 1:
        return output, None
    if output == "-":
        raise ValueError(f"'-o -' writes one transcript to stdout and cannot hold {len(inputs)}")
    named = output is not None and output.rpartition("/")[2].rpartition(".")
    if output is not None and (output_is_file or (named[0] and named[2].lower() in TRANSCRIPT_EXTENSIONS)):
        raise ValueError(f"'-o {output}' names a file, but there are {len(inputs)} inputs; name a directory instead")
    return None, output if output is not None else default


def expand_inputs(spark: SparkSession, folders: list[str], named: list[str]) -> DataFrame:
    """``path`` of the audio below the folders and of the named files whatever they are, each once, in order. None at all is an error."""
    rows = spark.createDataFrame([(p,) for p in named], "path string")
    for folder in folders:
        rows = rows.unionByName(list_files(spark, folder).where(looks_like_audio("path")).select("path"))
    rows = rows.distinct()
    if rows.isEmpty():
        raise ValueError("no audio or video files to read")
    return rows.orderBy("path")


def partial_files(spark: SparkSession, folder: str) -> DataFrame:
    """Half-finished downloads, the largest first."""
    return list_files(spark, folder).where(extension("path") == "part").orderBy(F.desc("size"), "path")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Versioned JSON documents; what is corrupt or of another version is not there."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"))
    return rows.where(F.col("x.version") == VERSION).select("file", "x.*")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache entries by ``key``, the name of their file; keys of other than letters and digits are ignored."""
    rows = _stored(spark, path, CACHE_ENTRY).withColumn("key", F.regexp_replace("file", r"\.json$", ""))
    return rows.where(F.col("key").rlike("^[A-Za-z0-9]+$")).drop("file")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    rows = _stored(spark, path, HISTORY).select(F.posexplode("entries").alias("seq", "x"))
    return rows.select("seq", "x.*")


def read_ownership(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, OWNERSHIP).select(F.explode("outputs").alias("source", "output"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``file, vocabulary``: vocabulary files as they are, with their line ends and white space."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("vocabulary"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, SETTINGS).drop("file", "version")


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, PENDING).select(F.posexplode("files").alias("pos", "path"), "engine")


def read_resume_log(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each span; lines that can't be read, as a cut last one, are skipped."""
    lines = read_lines(spark, path).withColumn("file", F.regexp_extract("file", "([^/]*)$", 1))
    rows = lines.select("file", F.col("line").alias("seq"), F.from_json("value", RESUME_RECORD).alias("x")).where("x.span is not null and x.segments is not null")
    return rows.groupBy("file", F.col("x.span").alias("span")).agg(F.max_by("x.segments", "seq").alias("segments"))


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``models (id, display_name, description, requires)``, their files and their mirrors. A catalogue that can't be read, or of another version, is an error."""
    rows = spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wrong = F.raise_error(F.concat(F.lit("catalogue version "), F.coalesce(F.col("version").cast("string"), F.lit("none")), F.lit(" is not supported")))
    models = rows.select(F.explode(F.when(F.col("version") == VERSION, F.col("models")).otherwise(wrong.cast(rows.schema["models"].dataType))).alias("m"))
    return (
        models.select("m.id", "m.display_name", "m.description", F.coalesce("m.requires", F.array().cast("array<string>")).alias("requires")),
        models.select("m.id", F.explode("m.files").alias("f")).select("id", "f.*"),
        models.select("m.id", F.explode("m.mirrors").alias("f")).select("id", "f.*"),
    )


def read_job_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with the parsed ``request``; null where it isn't JSON or names no input."""
    parsed = F.from_json(body, JOB_REQUEST)
    return bodies.withColumn("request", F.when(parsed["input"].isNotNull(), parsed))


def model_folder(models: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """``(id, folder, missing)``: where a model's files are, in ``""`` or its own sub-folder; else what is missing, joined."""
    names = files.select("id", "local")
    wanted = names.select("id", "local", F.lit("").alias("folder")).unionByName(names.select("id", "local", F.col("id").alias("folder")))
    there = wanted.join(disk.select("folder", "local").withColumn("there", F.lit(True)), ["folder", "local"], "left")
    whole = there.groupBy("id", "folder").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole"))
    found = whole.where("whole").groupBy("id").agg(F.min("folder").alias("folder"))
    missing = there.where("folder = '' and there is null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("local")), "、").alias("missing"))
    out = models.select("id").join(found, "id", "left").join(missing, "id", "left")
    return out.select("id", "folder", F.when(F.col("folder").isNull(), F.col("missing")).alias("missing"))
