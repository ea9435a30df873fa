"""Writers: rendered files, line dumps, append-only logs and replaced tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriba.operators.store import HISTORY, new_records, stale
from scriba.operators.store import history as recorded
from scriba.scratch import materialise

EXTENSIONS = {"srt": "srt", "text": "txt"}


def write_rendered(documents: DataFrame, folder: str) -> DataFrame:
    """Write each of ``documents (name, content)`` as a file of its own; gives ``name`` and ``bytes``.

    A file is written under another name and moved, so that nobody reads half of one and
    a task that runs again replaces what it wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                raw, part = (content or "").encode(), f"{path}/{name}.tmp-{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(raw)
                store.move(part, f"{path}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return documents.select("name", "content").mapInArrow(run, "name string, bytes long")


def write_lines(lines: DataFrame, path: str, line: str = "line") -> None:
    """One line of text a row, in as many files as there are tasks."""
    lines.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path class and the path's file system."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    return jvm, jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of an append-only log; none where there is no log yet."""
    jvm, store = _hadoop(spark, path)
    if not store.exists(jvm(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def append_log(batch: DataFrame, path: str, *keys: str, number: int) -> None:
    """Append a batch's records of spans that the log at ``path`` hasn't, for ``foreachBatch``.

    A batch is a folder of its own, by its number: one that comes again after a failure,
    whether it was written in part or whole, replaces itself and adds nothing.
    """
    spark, own = batch.sparkSession, f"{path.rstrip('/')}/n{number:012d}"
    jvm, store = _hadoop(spark, path)
    store.delete(jvm(own), True)
    new_records(batch, read_log(spark, path, batch.schema), *keys).write.parquet(own)


def forget_log(spark: SparkSession, path: str) -> bool:
    """Remove a log, once what it is for has succeeded; whether there was one."""
    jvm, store = _hadoop(spark, path)
    return store.delete(jvm(path), True)


_CURRENT = "current"


def replace_table(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``; ``rows`` may have been read from it.

    Each version is a folder of its own, and a pointer names the one that counts. The
    pointer is replaced by one atomic rename, so a reader sees the old table or the new
    one, and so does everyone after a crash. The version before stays for who reads it.
    One writer at a time: of two that read the same version, the last to finish wins, and
    what the other changed is lost.
    """
    spark, version = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    before = _version(spark, path)
    rows.write.parquet(f"{path.rstrip('/')}/{version}")
    jvm, store = _hadoop(spark, path)
    part, pointer = (jvm(f"{path.rstrip('/')}/{x}") for x in (f"{_CURRENT}.tmp-{uuid.uuid4().hex}", _CURRENT))
    out = store.create(part, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(part, pointer, options)
    for x in store.listStatus(jvm(path)):
        if x.getPath().getName() not in (version, before, _CURRENT) and x.getPath().getName().startswith("v-"):
            store.delete(x.getPath(), True)


def _version(spark: SparkSession, path: str) -> str | None:
    jvm, store = _hadoop(spark, path)
    pointer = jvm(f"{path.rstrip('/')}/{_CURRENT}")
    return spark.read.text(pointer.toString()).first()[0] if store.exists(pointer) else None


def current_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table that was last put at ``path``; an empty one before the first."""
    version = _version(spark, path)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{version}") if version else spark.createDataFrame([], schema)


def autosave(done: DataFrame, folder: str, history: str, keep: int = HISTORY) -> DataFrame:
    """Write the transcripts of ``done (name, content, input, output, engine, finished_at_ms)`` and record them; gives ``name, bytes``.

    A transcript is there before the history says so. Each input is recorded once, with
    its latest result, the ``keep`` newest of all.
    """
    spark = done.sparkSession
    written = materialise(write_rendered(done, folder), "written")  # a file is written once
    fields = ["input", "output", "engine", "finished_at_ms"]
    rows = done.join(written.select("name"), "name", "left_semi").select(*fields)
    old = current_table(spark, history, rows.schema)
    replace_table(recorded(old.unionByName(rows), "input", "finished_at_ms", "output", n=keep), history)
    return written


def left_behind(files: DataFrame, now: str = "now") -> DataFrame:
    """Half-written files of over a day, which a sweep may delete."""
    return stale(files.withColumn(now, F.current_timestamp()), now)
