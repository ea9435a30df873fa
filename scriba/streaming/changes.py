"""A stream's whole result as a snapshot and then its changes, and a reader that folds both.

Complete mode gives all rows with every batch. Here a batch writes only what it inserts,
updates and deletes by key, and now and then everything again, so that a reader never
folds more than the batches since then.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriba.scratch import scratch_dir

INSERT, UPDATE, DELETE = "insert", "update", "delete"
#: Batches after which all rows are written again.
EVERY = 20


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`")) for n in names), F.lit(True))


def changed(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """``after``'s columns and ``op``: what makes ``after`` of ``before``; a deleted row has its last values. Keys may be null, and are there once."""
    rest = [c for c in after.columns if c not in keys]
    a, b = before.withColumn("_there", F.lit(True)).alias("a"), after.withColumn("_there", F.lit(True)).alias("b")
    both = a.join(b, _same("a", "b", list(keys)), "full")
    gone, new = F.col("b._there").isNull(), F.col("a._there").isNull()
    op = F.when(gone, DELETE).when(new, INSERT).when(~_same("a", "b", rest), UPDATE)
    return both.select(*(F.when(gone, F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in after.columns), op.alias("op")).where("op is not null")


def folded(changes: DataFrame, *keys: str, upto: int | None = None) -> DataFrame:
    """The rows after batch ``upto``, or after all: of each key the last change since the last snapshot, unless it is deleted."""
    rows = changes if upto is None else changes.where(F.col("batch") <= upto)
    start = rows.where("snapshot").agg(F.max("batch").alias("_start"))
    rows = rows.join(F.broadcast(start), F.col("batch") >= F.col("_start"))  # one row
    names = [c for c in changes.columns if c not in ("op", "snapshot", "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names, "op"), "batch").alias("_last")).select("_last.*")
    return last.where(F.col("op") != DELETE).select(*names)


def drain_changes(stream: DataFrame, name: str, *keys: str, at: str | None = None, every: int = EVERY) -> DataFrame:
    """Run a stream in complete mode over what is there now, and read the changes that it wrote: its columns, ``op, snapshot, batch``.

    A batch that comes again after a failure replaces itself, as it is compared with the
    batches before it. A stream that is drained again ``at`` the same place goes on.
    """
    spark = stream.sparkSession
    at = at or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = T.StructType([*stream.schema.fields, T.StructField("op", T.StringType()), T.StructField("snapshot", T.BooleanType()), T.StructField("batch", T.LongType())])

    def written(session: object) -> DataFrame:
        return session.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")

    def write(batch: DataFrame, number: int) -> None:
        whole = number % every == 0
        if whole:
            rows = batch.withColumn("op", F.lit(INSERT))
        else:
            rows = changed(folded(written(batch.sparkSession), *keys, upto=number - 1), batch, *keys)
        rows.withColumns({"snapshot": F.lit(whole), "batch": F.lit(number).cast("long")}).write.mode("overwrite").parquet(f"{at}/out/n={number}")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return written(spark)
