"""Content-addressed results: cache, resume log, history and owned output names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much is kept, and when a half-written file counts as left behind.
HISTORY, MOST_SERIALS = 200, 999
STALE_HOURS = 24
VERSION = 1


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests with their cached results, and those still to be computed. Entries of another version don't count."""
    held = cache.where(F.col("version") == VERSION).drop("version")
    return requests.join(held, key), requests.join(held.select(key), key, "left_anti")


def resume(spans: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """``spans`` with the stored ``text`` of the log's last record for the span, and whether it has one."""
    last = log.groupBy(*keys).agg(F.max_by("text", "seq").alias("stored"))
    out = spans.join(last, list(keys), "left")
    return out.withColumn("reused", F.col("stored").isNotNull())


def new_records(batch: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """What a batch adds to an append-only log: the first record of each span that the log hasn't."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_n = 1").drop("_n")
    return first.join(log.select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, in the order of ``order``."""
    whole = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*").select(*rows.columns)


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows, over all: the rest is forgotten."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def history(rows: DataFrame, key: str, *order: str, n: int = HISTORY) -> DataFrame:
    """Each input once, with its latest result, the newest ``n`` of them."""
    return newest(latest(rows, key, *order), n, *order)


def forget(rows: DataFrame, key: str, gone: list) -> tuple[DataFrame, DataFrame]:
    """What remains without the given keys, and one row that says whether anything went."""
    hit = F.col(key).isin(gone)
    return rows.where(~hit), rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("changed"))


def usage(files: DataFrame) -> DataFrame:
    """Entries and half-written files of a cache folder's ``files (name, size)``, with their bytes."""
    temporary = F.col("name").rlike(r"\.tmp|\.part$")
    entry = F.col("name").endswith(".json") & ~temporary
    return files.agg(
        F.count_if(entry).alias("entries"), F.coalesce(F.sum(F.when(entry, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(temporary).alias("temporaries"), F.coalesce(F.sum(F.when(temporary, F.col("size"))), F.lit(0)).alias("temporary_bytes"),
    ).withColumn("total_bytes", F.col("bytes") + F.col("temporary_bytes"))


def stale(files: DataFrame, now: str) -> DataFrame:
    """Half-written files that are over a day old."""
    return files.where(F.col("name").rlike(r"\.tmp|\.part$") & (F.col(now).cast("long") - F.col("modified").cast("long") > STALE_HOURS * 3600))


def upserted(rows: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``changes`` recorded: the last change of each key replaces its row."""
    first = rows.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(first, key, "_new", *order).drop("_new")


def source_of(owners: DataFrame, outputs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """``outputs`` with the source that owns each, the least if several do; null where none does."""
    found = owners.groupBy(output).agg(F.min(source).alias(source))
    return outputs.join(found, output, "left")


def existing(rows: DataFrame, files: DataFrame, output: str = "output", path: str = "path") -> DataFrame:
    """The rows whose output is still there."""
    return rows.join(files.select(F.col(path).alias(output)).distinct(), output, "left_semi").select(rows.columns)


def readable(rows: DataFrame, parsed: DataFrame, output: str = "output", segments: str = "segments") -> DataFrame:
    """``rows`` with the transcript that their output holds; those of which it can't be read are dropped."""
    return rows.join(parsed.where(F.col(segments).isNotNull()).select(output, segments), output)


_ROOT = r"( \([0-9]+\))+$"


def output_names(requests: DataFrame, taken: DataFrame, most: int | None = MOST_SERIALS) -> DataFrame:
    """Where each of ``requests (dir, seq, source, stem, ext)`` writes: ``path`` and ``serial``.

    ``taken (dir, path, owner)``: names that are recorded as a source's, and, without an
    owner, files that nobody recorded. A source keeps its name in a folder; else it
    gets the plain name, or the first free number from 2 to ``most``; when all are taken,
    the plain name with the serial after ``most`` tells the caller so, for all that this
    source asks for there. Without ``most`` there is always a free number. Claims are made
    in the order of ``seq``, and one claim changes what is free for the next.

    Only a source's first request in a folder claims anything, and only names that differ
    in their numbers can be in each other's way. So claims are folded by folder, extension
    and stem without numbers, each as a sorted stream that keeps the numbers in use.
    """
    dir_source = ["dir", "source"]
    recorded = taken.where("owner is not null").groupBy("dir", F.col("owner").alias("source")).agg(F.max("path").alias("path"))
    first = requests.groupBy(*dir_source).agg(F.min_by(F.struct("seq", "stem", "ext"), "seq").alias("_x")).select(*dir_source, "_x.*")
    root = F.regexp_replace("stem", _ROOT, "").alias("root")
    claims = first.join(recorded, dir_source, "left_anti").select("dir", "ext", root, F.lit(1).alias("kind"), "seq", "source", "stem")
    name = F.substr("path", F.length("dir") + 2)
    held = taken.select("dir", F.regexp_extract(name, r"\.([^.]*)$", 1).alias("ext"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    held = held.select("dir", "ext", root, F.lit(0).alias("kind"), F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("source"), "stem")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, tried = None, set(), {}
        for pdf in pdfs:
            out = []
            for folder, ext, base, kind, source, stem in zip(*(pdf[c] for c in ("dir", "ext", "root", "kind", "source", "stem")), strict=True):
                if (folder, ext, base) != group:
                    group, used, tried = (folder, ext, base), set(), {}
                if kind == 0:
                    used.add(stem)
                    continue
                n = tried.get(stem, 1)  # numbers are never given back, so a search goes on where the last one ended
                while (most is None or n <= most) and (stem if n == 1 else f"{stem} ({n})") in used:
                    n += 1
                tried[stem] = n
                full = most is not None and n > most
                chosen = stem if n == 1 or full else f"{stem} ({n})"
                if not full:
                    used.add(chosen)
                out.append((folder, source, f"{folder}/{chosen}.{ext}", full))
            yield pd.DataFrame(out, columns=["dir", "source", "_path", "_full"])

    dealt = claims.unionByName(held).repartition("dir", "ext", "root").sortWithinPartitions("dir", "ext", "root", "kind", "seq")
    given = dealt.mapInPandas(run, "dir string, source string, _path string, _full boolean")
    rows = requests.join(recorded.select(*dir_source, F.col("path").alias("_path"), F.lit(False).alias("_full")).unionByName(given), dir_source)
    plain = F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext")
    numbered = _serial_in(F.col("_path"), F.col("dir"), F.col("stem"))
    serial = numbered if most is None else F.when(F.col("_full"), most + 1).otherwise(numbered)
    return rows.select(*requests.columns, F.when(F.col("_full"), plain).otherwise(F.col("_path")).alias("path"), serial.cast("int").alias("serial"))


def _serial_in(path: Column, folder: Column, stem: Column) -> Column:
    """The number in a recorded path that has the stem; null for none."""
    inner = F.regexp_replace(F.substr(path, F.length(folder) + 2), r"\.[^.]*$", "")
    rest = F.when(F.startswith(inner, stem), F.substr(inner, F.length(stem) + 1))
    return F.nullif(F.regexp_extract(rest, r"^ \(([0-9]+)\)$", 1), F.lit("")).try_cast("int")


def planned_outputs(batches: DataFrame, default: str, extensions: tuple[str, ...]) -> DataFrame:
    """``batches (inputs, output, output_is_file)`` with ``path``, ``folder`` and ``error``: where each batch of so many inputs writes.

    A single input goes to the path as it was named. ``-`` and what is, or is named like, a
    file hold one transcript only, so more inputs are an error. Otherwise files are named in
    a folder, the default one where none is given.
    """
    output, one = F.col("output"), (F.col("inputs") == 1) & F.col("output").isNotNull()
    name = F.regexp_extract(output, "([^/]*)$", 1)
    like_a_file = F.col("output_is_file") | F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).isin(*extensions)
    n = F.col("inputs").cast("string")
    stdout = F.concat(F.lit("'-o -' writes one transcript to stdout and cannot hold "), n)
    named = F.concat(F.lit("'-o "), output, F.lit("' names a file, but there are "), n, F.lit(" inputs; name a directory instead"))
    error = F.when(one, None).when(output == "-", stdout).when(like_a_file, named)
    return batches.withColumns({"path": F.when(one, output), "folder": F.when(~one & error.isNull(), F.coalesce(output, F.lit(default))), "error": error})
