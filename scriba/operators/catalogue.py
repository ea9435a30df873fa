"""A catalogue of models and their files, and reports on batches of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SUPPORTED_VERSION = 1
POOL_STATES = ("busy", "loading", "standby", "unloaded")


def requirements(models: DataFrame) -> DataFrame:
    """``(id, needed, ordinal)``: what each of ``models (id, requires)`` needs directly; unknown names are skipped."""
    edges = models.select("id", F.posexplode("requires").alias("ordinal", "needed"))
    return edges.join(models.select(F.col("id").alias("needed")), "needed").select("id", "needed", "ordinal")


def file_states(files: DataFrame, disk: DataFrame) -> DataFrame:
    """``files (id, local, size)`` with ``complete``: there, and of the known size."""
    there = disk.select("id", "local", F.col("size").alias("_size"))
    out = files.join(there, ["id", "local"], "left")
    return out.withColumn("complete", F.col("_size").isNotNull() & (F.col("size").isNull() | (F.col("size") == F.col("_size")))).drop("_size")


def presence(models: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """``(id, present, runnable)``: whether a model's own files are all there, and those of what it needs too."""
    own = file_states(files, disk).groupBy("id").agg(F.bool_and("complete").alias("present"))
    own = models.select("id").join(own, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))
    needed = requirements(models).join(own.select(F.col("id").alias("needed"), F.col("present").alias("_there")), "needed", "left")
    needed = needed.groupBy("id").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_needs"))
    return own.join(needed, "id", "left").select("id", "present", (F.col("present") & F.coalesce("_needs", F.lit(True))).alias("runnable"))


def to_fetch(models: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """``(id, fetch, ordinal)``: a model that isn't there, then what it needs that isn't, in order."""
    absent = presence(models, files, disk).where("not present").select(F.col("id").alias("fetch"))
    wanted = models.select("id", F.col("id").alias("fetch"), F.lit(0).alias("ordinal")).unionByName(requirements(models).select("id", F.col("needed").alias("fetch"), (F.col("ordinal") + 1).alias("ordinal")))
    return wanted.join(absent, "fetch", "left_semi").select("id", "fetch", "ordinal")


def sizes(files: DataFrame) -> DataFrame:
    """``(id, known_bytes, total_bytes)``: known sizes added up; and the total, which is unknown if any size is."""
    all_known = F.when(F.count_if(F.col("size").isNull()) == 0, F.sum("size"))
    return files.groupBy("id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("known_bytes"), all_known.alias("total_bytes"))


def violations(models: DataFrame, files: DataFrame, mirrors: DataFrame) -> DataFrame:
    """``(id, problem, detail)``: what makes a catalogue unusable."""
    twice = models.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("listed twice").alias("problem"), F.col("id").alias("detail"))
    bare = models.select("id").distinct()
    no_files = bare.join(files, "id", "left_anti").select("id", F.lit("no files").alias("problem"), F.lit(None).cast("string").alias("detail"))
    no_mirrors = bare.join(mirrors, "id", "left_anti").select("id", F.lit("no mirrors").alias("problem"), F.lit(None).cast("string").alias("detail"))
    edges = models.select("id", F.explode("requires").alias("detail"))
    itself = edges.where("id = detail").select("id", F.lit("requires itself").alias("problem"), "detail")
    unknown = edges.join(models.select(F.col("id").alias("detail")), "detail", "left_anti").select("id", F.lit("requires what isn't listed").alias("problem"), "detail")
    same = files.groupBy("id", "local").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("two files of one name").alias("problem"), F.col("local").alias("detail"))
    out = twice
    for more in (no_files, no_mirrors, itself, unknown, same):
        out = out.unionByName(more)
    return out


def latest_progress(states: DataFrame, *by: str, file: str = "file", seq: str = "seq") -> DataFrame:
    """Bytes received so far: the latest state of each file replaces its earlier ones."""
    last = states.groupBy(*by, file).agg(F.max_by("received", seq).alias("received"))
    return last.groupBy(*by).agg(F.sum("received").alias("received"))


def report(results: DataFrame, *by: str) -> DataFrame:
    """Succeeded, failed, whether all is well, and the kind of the first failure in the order of ``pos``."""
    failed = ~F.col("ok")
    return results.groupBy(*by).agg(
        F.count_if("ok").alias("succeeded"), F.count_if(failed).alias("failed"), (F.count_if(failed) == 0).alias("ok"),
        F.coalesce(F.min_by(F.when(failed, F.col("kind")), F.when(failed, F.col("pos"))), F.when(F.count_if(failed) > 0, "internal")).alias("first_failure"),
    )


def until_first_failure(results: DataFrame, *by: str) -> DataFrame:
    """Results up to and with the first failed one, in the order of ``pos``."""
    first = results.where("not ok").groupBy(*by).agg(F.min("pos").alias("_first"))
    return results.join(first, list(by), "left").where(F.col("pos") <= F.coalesce("_first", "pos")).drop("_first")


def in_input_order(results: DataFrame, inputs: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``results`` with the place of their input; those of no input come last."""
    return results.join(inputs.select(key, pos), key, "left").withColumn(pos, F.coalesce(pos, F.lit(2**63 - 1)))


def pool_status(workers: DataFrame, *by: str, state: str = "state") -> DataFrame:
    """What a pool is doing: the first of busy, loading, standby, unloaded that any worker is."""
    rank = F.array_position(F.array(*map(F.lit, POOL_STATES)), F.col(state))
    return workers.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, POOL_STATES)), F.coalesce(F.min(F.when(rank > 0, rank)), F.lit(len(POOL_STATES))).cast("int")).alias("status"))


def health(workers: DataFrame, jobs: DataFrame, per_worker_bytes: int) -> DataFrame:
    """One row: loads, resident and running counts, queue lengths, and the memory that all workers may come to."""
    pool = workers.agg(F.sum("loads").alias("loads"), F.count_if(F.col("state") != "unloaded").alias("resident"), F.count(F.lit(1)).alias("workers"))
    pool = pool.withColumn("implied_peak_bytes", F.col("workers") * F.lit(per_worker_bytes).cast("long"))
    held = jobs.agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state").isin("done", "failed", "cancelled")).alias("retained"))
    return pool.withColumn("_k", F.lit(1)).join(held.withColumn("_k", F.lit(1)), "_k").drop("_k")


def to_document(rows: DataFrame, *columns: str, name: str = "document") -> DataFrame:
    """Rows as JSON with camel-case keys, where every field is there, null ones too."""

    def camel(x: str) -> str:
        head, *rest = x.split("_")
        return head + "".join(w.capitalize() for w in rest)

    fields = [F.col(c).alias(camel(c)) for c in columns or rows.columns]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def longest_prefix(paths: DataFrame, mounts: DataFrame, path: str = "path", mount: str = "mount") -> DataFrame:
    """``paths`` with the mount that is their longest prefix, component by component; null if none is.

    Each path offers all its prefixes, so that an equi-join finds the mounts.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    offered = paths.select(path, F.explode(F.transform(prefixes, lambda p: F.when(p == "", "/").otherwise(p))).alias(mount)).distinct()
    found = offered.join(mounts.select(mount).distinct(), mount).groupBy(path).agg(F.max_by(mount, F.length(mount)).alias(mount))
    return paths.join(found, path, "left")


def missing_bytes(files: DataFrame, disk: DataFrame) -> DataFrame:
    """``(id, missing_bytes)``: what a download of each model would still write; unknown where a file that isn't complete has no known size, 0 where all are."""
    absent = F.coalesce(~F.col("complete"), F.lit(True))
    unknown = F.count_if(absent & F.col("size").isNull()) > 0
    return file_states(files, disk).groupBy("id").agg(F.when(~unknown, F.coalesce(F.sum(F.when(absent, F.col("size"))), F.lit(0))).alias("missing_bytes"))


def loadable(models: DataFrame, engines: DataFrame) -> DataFrame:
    """The models that an engine is registered for."""
    return models.join(engines.select("id").distinct(), "id", "left_semi")


def usage(files: DataFrame, *by: str) -> DataFrame:
    """Bytes and number of ``files (size)``, of folders or of what a cleanup removed."""
    return files.groupBy(*by).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


def freed(files: DataFrame, removed: str = "removed", *by: str) -> DataFrame:
    """Bytes and number of the half-finished downloads that could be removed."""
    return usage(files.where(F.lower("name").endswith(".part") & F.col(removed)), *by)


def listed(files: DataFrame) -> DataFrame:
    """``(id, files)``: each model's files in the order of their relative names, as a run's settings name them."""
    return files.groupBy("id").agg(F.array_sort(F.collect_list("local")).alias("files"))
