"""Sizes of pools and downloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col

# Fixed values.
MOST_WORKERS = 8
ASSUMED_BUDGET = 2 << 30
BUDGET_SHARE = 4
BACKOFF_MS, ATTEMPTS = 400, 3
PROGRESS_STEP = 2 << 20


def _long(x: ColumnLike | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else col(x).cast("long")


def div(a: ColumnLike | int, b: ColumnLike | int) -> Column:
    """Integer division; null by zero."""
    b = _long(b)
    return F.when(b != 0, F.call_function("div", _long(a), F.nullif(b, F.lit(0))))


def pool_size(threads: ColumnLike, per_worker: ColumnLike, budget: ColumnLike) -> Column:
    """Workers that fit the threads and the memory: one at least, eight at most."""
    fit = F.greatest(div(budget, per_worker), F.lit(1).cast("long"))
    return F.when(_long(per_worker) == 0, F.lit(1).cast("long")).otherwise(F.least(F.greatest(F.least(fit, _long(threads)), F.lit(1).cast("long")), F.lit(MOST_WORKERS).cast("long")))


def per_worker_threads(threads: ColumnLike, workers: ColumnLike) -> Column:
    return F.greatest(div(threads, F.greatest(_long(workers), F.lit(1).cast("long"))), F.lit(1).cast("long"))


def engine_threads(cores: ColumnLike) -> Column:
    """All cores but one."""
    return F.greatest(_long(cores) - 1, F.lit(1).cast("long"))


def memory_budget(total: ColumnLike) -> Column:
    """A quarter of the memory; where that is unknown, 2 GiB."""
    return F.coalesce(div(total, BUDGET_SHARE), F.lit(ASSUMED_BUDGET).cast("long"))


def tier(avx2: ColumnLike, cores: ColumnLike) -> Column:
    """Why a machine counts as weak; null if it doesn't."""
    return F.when(~col(avx2), "this CPU does not support AVX2").when(col(cores) < 2, "this machine reports a single CPU core")


def tier_notice(avx2: ColumnLike, cores: ColumnLike) -> Column:
    return F.concat(F.lit("Running in reduced mode because "), tier(avx2, cores), F.lit("."))


def download_fraction(received: ColumnLike, total: ColumnLike) -> Column:
    """From 0 to 1; null where the total is unknown or 0."""
    return F.when(col(total) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(received) / col(total))))


def progress_fraction(end: ColumnLike, total: ColumnLike) -> Column:
    """As a single-precision number, as events carry it; null where the total is unknown."""
    return F.when(col(total) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(end) / F.nullif(col(total), F.lit(0))))).cast("float")


def backoff_ms(attempt: ColumnLike) -> Column:
    """The wait before an attempt's retry; it doubles."""
    return F.lit(BACKOFF_MS).cast("long") * F.pow(F.lit(2), col(attempt)).cast("long")


def human_bytes(n: ColumnLike) -> Column:
    """Decimal units with one decimal, from KB on; a half is rounded up."""
    n = _long(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1000**k, F.format_string(f"%.1f {unit}", n / float(1000**k))).otherwise(out)
    return out


def percent(received: ColumnLike, total: ColumnLike) -> Column:
    """A whole percentage, a half rounded up; null where the total is unknown or 0."""
    return F.when(col(total) > 0, F.floor(100.0 * col(received) / F.nullif(col(total), F.lit(0)) + 0.5).cast("long"))


def megabytes(n: ColumnLike) -> Column:
    """Decimal megabytes without decimals, a half rounded up."""
    return F.format_string("%d", F.floor(_long(n) / 1_000_000 + 0.5))


def fixed(x: ColumnLike, decimals: int) -> Column:
    """``x`` with so many decimals, one to seven, rounded from its exact binary value, a tie to even, as C's ``printf`` does; ``format_string`` rounds the shortest decimal for it, half up.

    For ``x`` from 0 up to where a number has no fraction. The product's rounding error is
    computed exactly, from halves of ``x`` that have 26 bits each; it tells which side of
    a tie the exact product is on.
    """
    x, scale = col(x), 10**decimals
    product, split = x * float(scale), x * float(2**27 + 1)
    high = split - (split - x)
    error = high * float(scale) - product + (x - high) * float(scale)
    whole = F.floor(product)
    above = product - whole - 0.5
    up = (above > 0) | ((above == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    return F.when(x.isNotNull(), F.format_string(f"%d.%0{decimals}d", div(n, scale), n % scale))


def parse_setting(flag: ColumnLike, environment: ColumnLike, default: int) -> Column:
    """The flag, or else the environment's value, or else the default; an empty value is unset and one that isn't a number counts as unset."""
    read = [F.nullif(F.trim(col(x)), F.lit("")).try_cast("bigint") for x in (flag, environment)]
    return F.coalesce(*read, F.lit(default).cast("long"))
