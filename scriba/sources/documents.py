"""Formats that write a file for each document, from rows that stand one after the other.

``df.write.format("srt")`` and ``format("transcript")`` take ``(name, body)``: a name's rows
must be in one partition and in order, as ``write_subtitles`` and ``write_transcripts`` deal
them out. A document is written as its rows come, so it is never held whole.

Tasks write below a folder of the job's own. Only the commit of the whole job moves what
the tasks that count have written to its place, and a job that fails leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scriba.operators.subtitles import cues

SCHEMA = "name string, body string"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the names, and where below the job's folder."""

    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, extension: str, leading: bool):
        self.target, self.extension, self.leading = options["path"].rstrip("/"), options.get("extension", extension), leading
        self.overwrite, self.job = overwrite, f"_temporary-{uuid.uuid4().hex}"
        store, path = fs.FileSystem.from_uri(self.target)
        store.create_dir(f"{path}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = fs.FileSystem.from_uri(self.target)
        own = f"{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{path}/{own}", recursive=False)  # a task that begins after its job has failed finds no place
        done, out, begun = {}, None, False
        try:
            for batch in iterator:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name is None or "/" in name or name in ("", ".", ".."):
                        raise ValueError(f"{name!r} is no file name")
                    if out is None or name != next(reversed(done)):
                        if name in done:
                            raise ValueError(f"the rows of {name!r} don't stand one after the other")
                        if out is not None:
                            out.close()
                        out, begun = store.open_output_stream(f"{path}/{own}/{name}{self.extension}", compression=None), self.leading
                        done[name] = True
                    body = body or ""
                    if not begun:  # a text doesn't begin with empty lines
                        body = body.lstrip("\n")
                        begun = bool(body)
                    out.write(body.encode())
        finally:
            if out is not None:
                out.close()
        return Written(own, list(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.target)
        found: dict[str, str] = {}
        for m in filter(None, messages):
            for name in m.names:
                if name in found:
                    self.abort(messages)
                    raise ValueError(f"{name!r} comes from more than one task")
                found[name] = f"{path}/{m.folder}/{name}{self.extension}"
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.path.endswith(self.extension) and f.base_name.removesuffix(self.extension) not in found:
                    store.delete_file(f.path)
        for name, at in found.items():
            store.move(at, f"{path}/{name}{self.extension}")
        self._clean(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.target))

    def _clean(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class SrtDataSource(DataSource):
    """Subtitle files: the bodies of a name's cues."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, ".srt", leading=True)


class TranscriptDataSource(SrtDataSource):
    """Text files: the lines of a name, without empty ones at the start."""

    @classmethod
    def name(cls) -> str:
        return "transcript"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, ".txt", leading=False)


def register(spark: SparkSession) -> None:
    for source in (SrtDataSource, TranscriptDataSource):
        spark.dataSource.register(source)


def _save(rows: DataFrame, order: str, kind: str, folder: str, mode: str) -> None:
    register(rows.sparkSession)
    rows.repartition("name").sortWithinPartitions("name", order).select("name", "body").write.format(kind).mode(mode).save(folder)


def write_subtitles(segments: DataFrame, folder: str, file: str = "file_id", mode: str = "append") -> None:
    """A ``.srt`` file for each file of ``segments (file, seg_id, start_ms, end_ms, text)`` that has a cue. ``overwrite`` removes other subtitle files."""
    _save(cues(segments, file).select(F.col(file).cast("string").alias("name"), "cue", "body"), "cue", "srt", folder, mode)


def write_transcripts(segments: DataFrame, folder: str, file: str = "file_id", mode: str = "append") -> None:
    """A ``.txt`` file for each file of ``segments (file, seg_id, text)``: segments a line each, as ``subtitles.to_text`` has them."""
    lines = segments.select(F.col(file).cast("string").alias("name"), "seg_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("body"))
    _save(lines, "seg_id", "transcript", folder, mode)
