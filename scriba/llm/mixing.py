"""Mixing sources to target weights by hash-threshold histograms.

A document's place in the order of its source is a hash of its id. Histograms of sizes
by source and hash bucket show in which bucket a source's budget ends; only the rows of
that bucket are counted again, by the next bits, until the threshold is exact. The mix
is then a filter on the hash: nothing is sorted, and a smaller budget takes a subset of
what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import columns_of, materialise

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a multiple of all sizes, and the most that a source may be repeated.
BUDGET, REPEATS = 1.5, 2
#: Bits of the hash that each histogram resolves: 60 in all.
LEVELS = (12, 16, 16, 16)


def words(text: str | Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(id_col: str) -> Column:
    """60 bits of the MD5 of the id as text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, weight, target)`` for ``sizes (source, source_size)``, one row for each source.

    The budget is shared by weight; where a target would exceed twice its source, it
    stops there and what is left is shared among the others. With the sources in the
    order of the share at which they stop, those that stop are a prefix.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(REPEATS)).withColumn("stops", F.col("cap") / F.col("weight"))
    before = every.orderBy("stops", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * BUDGET - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("share", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    share = F.min(F.when(F.col("stops") > F.col("share"), F.struct("stops", "rank", "share"))).over(every)["share"]
    ranked = ranked.withColumn("level", share)
    target = F.when(F.col("level").isNull() | (F.col("stops") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, below)``: rows of ``slim (source, size, u)`` with ``u < below`` make up each source's budget.

    ``budgets (source, rest)``; the rows taken are the longest prefix in the order of
    the hash whose size doesn't exceed the budget; rows of equal hash go together. A
    source whose rows all fit has no row here. The histograms have 65536 cells a source
    at most; levels end as soon as no boundary bucket holds more than one row.
    """
    state = budgets.select("source", F.col("rest"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("prefix"))
    rows, shift = slim, sum(LEVELS)
    for level, bits in enumerate(LEVELS):
        if level:
            # only the boundary bucket of each source is counted on
            held = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            rows = materialise(rows.join(held, rows["source"].eqNullSafe(held["s"]) & (F.shiftright("u", shift) == held["p"])).select("source", "size", "u"), "boundary")
            if (rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= 1:
                # one row is left of each source, and its budget ends there
                return rows.select("source", F.col("u").alias("below"))
        shift -= bits
        cells = rows.groupBy("source", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").cast("double").alias("sum"))
        upto = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("before", F.sum("sum").over(upto) - F.col("sum"))
        old = state.select(F.col("source").alias("s"), "rest", F.col("base").alias("b"))
        over = cells.join(old, cells["source"].eqNullSafe(old["s"])).where("b + before + sum > rest")
        found = over.groupBy("source", "rest").agg(F.min(F.struct("cell", (F.col("b") + F.col("before")).alias("base"))).alias("x"))
        state = materialise(found.select("source", "rest", "x.base", F.col("x.cell").alias("prefix")), "budget")
    return state.select("source", F.col("prefix").alias("below"))


def planned(slim: DataFrame) -> DataFrame:
    """For ``slim (source, size, u)``, a row for each source: ``s, source_size, target, whole, below``.

    The mix takes a source's rows ``whole`` times, and those with ``u < below`` once more.
    """
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = materialise(aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    ends = thresholds(slim, aims.select("source", "rest"))
    aims = aims.join(ends.withColumnRenamed("source", "s"), aims["source"].eqNullSafe(F.col("s")), "left").drop("s")
    return materialise(aims.select(F.col("source").alias("s"), "source_size", "target", "whole", "below"), "aims")


def _times(u: str = "u", whole: str = "whole", below: str = "below") -> Column:
    """How often the mix takes a row that is joined with its source's plan."""
    return F.col(whole) + F.when(F.coalesce(F.col(u) < F.col(below), F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row.

    ``taken`` counts a row's words as often as the mix takes it: 0, 1 or 2 times. A null
    text has no words, a null source is a source and comes last, a null id is hashed as
    empty text; rows that repeat an id are taken together. Texts are counted whole,
    however long; other columns are ignored. An empty table gives an empty result. Reruns
    agree, as only ids and sizes decide. One row for each source meets in one task.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), order_hash(id_col).alias("u"))
    slim = materialise(slim, "sizes")
    aims = planned(slim)
    joined = slim.join(aims, slim["source"].eqNullSafe(aims["s"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: not at all, once or twice.

    Nulls and rows that repeat an id are treated as ``mix`` does. A source without words
    has nothing to take. Columns may have any name; they and their order are kept. An
    empty table stays empty.
    """
    slim = docs.select(F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), order_hash(id_col).alias("u"))
    aims = planned(materialise(slim, "sizes"))
    rows = docs.select(F.struct(*columns_of(docs)).alias("doc"), F.col(source_col).cast("string").alias("source"), order_hash(id_col).alias("u"))
    joined = rows.join(aims, rows["source"].eqNullSafe(aims["s"]))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), _times().cast("int")))).select("doc.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, ([3, 1, 2])[k % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
o AS (SELECT *, cap / weight AS stops FROM w),
h AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
      FROM o WINDOW b AS (ORDER BY stops, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(share, (stops, k)) AS level FROM h WHERE stops > share),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR stops <= level THEN cap ELSE level * weight END AS target FROM h, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
