"""A data source of raw PCM samples, as a decoder gives them.

``spark.read.format("pcm").load(folder)`` reads 16 kHz mono files of little-endian
single-precision samples as chunks of a tenth of a second: ``file_id, seq, start,
samples``. A file is a partition, or several of a fixed size; a trailing partial sample
is dropped.

``spark.readStream.format("pcm")`` gives the chunks of files that grow, each once: its
offset is how many samples of each file were read, so it is as long as the list of files.
A chunk comes when it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK = 1_600
#: Samples that one task reads.
SPLIT = CHUNK * 10_000
SCHEMA = "file_id string, seq long, start long, samples array<float>"


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    count: int


class _Files:
    """The files of a folder, and slices of them."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", ".f32")

    def sizes(self) -> dict[str, int]:
        """Samples of each file, whole ones alone."""
        store, path = fs.FileSystem.from_uri(self.folder)
        files = store.get_file_info(fs.FileSelector(path, recursive=True))
        return {f.path: f.size // 4 for f in sorted(files, key=lambda x: x.path) if f.is_file and f.path.endswith(self.suffix)}

    def slices(self, path: str, first: int, end: int) -> list[Slice]:
        return [Slice(path, at, min(SPLIT, end - at)) for at in range(first, end, SPLIT)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(part.path) as source:
            for at in range(part.first, part.first + part.count, CHUNK * 100):
                n = min(CHUNK * 100, part.first + part.count - at)
                samples = np.frombuffer(source.read_at(n * 4, at * 4), dtype="<f4")
                cuts = list(range(0, n, CHUNK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * len(cuts)), pa.array([(at + c) // CHUNK for c in cuts], pa.int64()), pa.array([at + c for c in cuts], pa.int64()), pa.array([samples[c : c + CHUNK] for c in cuts], pa.list_(pa.float32()))],
                    ["file_id", "seq", "start", "samples"],
                )


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return [x for path, n in self.sizes().items() for x in self.slices(path, 0, n)]


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return {path: n // CHUNK * CHUNK for path, n in self.sizes().items()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
        return [x for path, n in end.items() for x in self.slices(path, start.get(path, 0), n)]

    def commit(self, end: dict[str, int]) -> None:
        """The files stay."""


class PcmDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def write_samples(rows: DataFrame, folder: str, file: str, order: str, samples: str) -> None:
    """A file for each ``file`` of ``rows``: its samples in order. A file is written under another name and moved; a task streams through its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, part = None, None, f"{path}/.{uuid.uuid4().hex}"
        for batch in batches:
            for own, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != name:
                    if out is not None:
                        out.close()
                        store.move(part, f"{path}/{name}.f32")
                    name, out = own, store.open_output_stream(part, compression=None)
                out.write(values.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        if out is not None:
            out.close()
            store.move(part, f"{path}/{name}.f32")
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["file"])

    dealt = rows.select(F.col(file).cast("string").alias("file"), order, F.col(samples).cast("array<float>").alias("samples")).where("samples is not null")
    dealt.repartition("file").sortWithinPartitions("file", order).select("file", "samples").mapInArrow(run, "file string").count()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmDataSource)
