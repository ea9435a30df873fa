"""Helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: ColumnLike, table: dict) -> Column:
    """The table's value for the key; null for others."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col(key))


def first_that_holds(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds; a null condition doesn't."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
