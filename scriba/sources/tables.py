"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts: what is done with their rows costs more than to deal them out.
TEXTS = ("documents", "conversations", "pages")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer pieces than there are cores is dealt out to all of them.

    A large table has more pieces than cores, so it is never shuffled here.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
