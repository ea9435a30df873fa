"""Running values over the order of a group, also of one that is too large for a task.

A window over a group is one task. Here a group of more than ``BLOCK_ROWS`` rows is cut
into blocks at quantiles of its order: each block gives one partial value, a window over
the blocks carries these on, and a window inside each block does the rest. Groups that are
smaller stay one block, and where there are no others the plan is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.scratch import materialise

#: Rows of a group that one task takes.
BLOCK_ROWS = 1_000_000
#: Blocks of a group at most.
BLOCKS = 256

#: What is carried on, and how what a block begins with and what it has so far make one value.
_JOINED = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
    "last": lambda before, here: F.coalesce(here, before),
}
Values = dict[str, tuple[str, Column]]


def _over(how: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if how == "last" else getattr(F, how)(value)


def _edges(rows: DataFrame, by: str, order: str, block_rows: int) -> DataFrame | None:
    """``(by, edges)``: where groups of more rows are cut; None if there are none. A row for each such group, so far fewer than ``rows``."""
    large = materialise(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block_rows), "large")
    if large.isEmpty():
        return None
    at = F.percentile_approx(order, [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS)
    own = rows.select(F.col(by).alias("_scan_group"), order)
    cuts = own.join(large, own["_scan_group"].eqNullSafe(large[by])).groupBy("_scan_group").agg(at.alias("_at"), F.first("_rows").alias("_rows"))
    parts = F.least(F.ceil(F.col("_rows") / block_rows), F.lit(BLOCKS)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_at", F.greatest((i * BLOCKS / parts).cast("int"), F.lit(1))))
    return materialise(cuts.select("_scan_group", F.array_distinct(chosen).alias("_scan_edges")), "edges")


def running(rows: DataFrame, by: str, order: str | list[str], values: Values, through: bool = False, block_rows: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values``, ``{name: (how, column)}``: over the rows of the group before this one, or up to it with ``through``.

    ``how`` is sum, count, max, min or last, the latter of values that aren't null. Blocks are
    cut by the first column of ``order``, a number or a time; rows that are equal in it
    stay in one block. Before the first row a sum and a count are 0, others null.
    """
    order = [order] if isinstance(order, str) else order
    edges = _edges(rows, by, order[0], block_rows or BLOCK_ROWS)
    end = 0 if through else -1
    if edges is None:
        before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        zero = {name: F.coalesce(_over(how, value).over(before), F.lit(0)) if how in ("sum", "count") else _over(how, value).over(before) for name, (how, value) in values.items()}
        return rows.withColumns(zero)
    block = F.coalesce(F.size(F.filter("_scan_edges", lambda e: e < F.col(order[0]))), F.lit(0))
    cut = rows.join(edges, rows[by].eqNullSafe(edges["_scan_group"]), "left").withColumn("_scan_block", F.when(F.col("_scan_edges").isNull(), 0).otherwise(block)).drop("_scan_group", "_scan_edges")
    ends = F.struct(*order)
    partial = {name: F.max_by(value, F.when(value.isNotNull(), ends)) if how == "last" else getattr(F, how)(value) for name, (how, value) in values.items()}
    blocks = cut.groupBy(F.col(by).alias("_scan_by"), F.col("_scan_block").alias("_scan_nr")).agg(*(x.alias(f"_scan_of_{name}") for name, x in partial.items()))
    carry = Window.partitionBy("_scan_by").orderBy("_scan_nr").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"count": "sum"}
    blocks = blocks.select("_scan_by", "_scan_nr", *(_over(fold.get(how, how), F.col(f"_scan_of_{name}")).over(carry).alias(f"_scan_before_{name}") for name, (how, _) in values.items()))
    both = cut.join(blocks, cut[by].eqNullSafe(blocks["_scan_by"]) & (cut["_scan_block"] == blocks["_scan_nr"]), "left")
    inside = Window.partitionBy(by, "_scan_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = both.withColumns({name: _JOINED[how](F.col(f"_scan_before_{name}"), _over(how, value).over(inside)) for name, (how, value) in values.items()})
    return out.select(*rows.columns, *values)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, since: str, values: list[str], block_rows: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` in its group whose ``since`` is not above ``at``; null where there is none.

    Both sides are one ordered sequence, over which the last row of ``right`` is carried
    on, so that no row of one meets more than one of the other.
    """
    held = F.struct(*values)
    first = right.select(F.col(by).alias("_by"), F.col(since).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    second = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_held"), F.struct("*").alias("_row"))
    carried = running(first.unionByName(second), "_by", ["_at", "_side"], {"_last": ("last", F.col("_held"))}, block_rows=block_rows)
    return carried.where("_side = 1").select(*(F.col("_row")[c].alias(c) for c in left.columns), *(F.col("_last")[c].alias(c) for c in values))
