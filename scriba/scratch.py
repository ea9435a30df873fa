"""Intermediate tables in shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a local folder is made, but only on a local master: on a
    cluster, executors could not read each other's files from there.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scriba-")
        spark.conf.set("spark.checkpoint.dir", found)
    key = f"{spark.sparkContext.applicationId}:{found}"
    if key not in _made:
        _made[key] = f"{found.rstrip('/')}/scriba-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _made[key])
    return _made[key]


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system; a session that has ended leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone at interpreter exit
        return


_tables: list[str] = []


@contextmanager
def passing(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Tables that are made inside are removed at the end, but for those of the given names.

    For work whose result is written, as ``materialise`` does: what it was made of is no
    longer read. Tables are removed whether or not the work succeeds.
    """
    first = len(_tables)
    try:
        yield
    finally:
        made, _tables[first:] = _tables[first:], []
        for path in made:
            if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] in kept:
                _tables.append(path)
            else:
                _remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; this cuts the lineage.

    A lost executor costs no more than the tasks that were running there, as the
    table is in shared storage.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
