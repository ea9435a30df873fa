"""Transcript quality: errors per file, roll-ups, percentiles and worst cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.functions.numbers import fixed
from scriba.functions.text import normalize
from scriba.scratch import materialise

#: References that are looked at to tell whether a dataset is punctuated.
PROBED = 200
WORST = 20
PERCENTILES = (0.5, 0.9, 0.99)
#: Buckets of a histogram that a rank is looked for in, and values that are sorted.
BUCKETS, SORTED = 4096, 100_000


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where there is nothing to divide by."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def scored(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with ``errors``, ``reference_len`` and ``rate``.

    Both sides are normalised once, and compared by code points. An empty reference has
    a rate of 0, but what is said against it still counts as errors.
    """
    both = pairs.withColumns({"_ref": normalize(reference), "_hyp": normalize(hypothesis)})
    both = both.withColumns({"errors": F.levenshtein("_ref", "_hyp").cast("long"), "reference_len": F.length("_ref").cast("long")})
    return both.withColumn("rate", ratio(F.col("errors"), F.col("reference_len"))).drop("_ref", "_hyp")


def roll_up(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each dataset of ``rows (errors, reference_len)``: files, errors, chars, micro error rate, exact files and their share."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("errors").alias("errors"), F.sum("reference_len").alias("chars"), F.count_if(F.col("errors") == 0).alias("exact"))
    return out.withColumns({"cer": ratio(F.col("errors"), F.col("chars")), "exact_pct": 100.0 * F.col("exact") / F.greatest(F.col("files"), F.lit(1))})


def coverage_roll_up(rows: DataFrame, *by: str) -> DataFrame:
    """Mean and least coverage of the files where it can be judged, and how many were recovered."""
    return rows.groupBy(*by).agg(F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"), F.count_if("recovered").alias("recovered"), F.count("coverage").alias("judged"))


def mean_segment_chars(rows: DataFrame, *by: str) -> DataFrame:
    """Reference characters for each recognised segment of ``rows (reference_len, segments)``."""
    return rows.groupBy(*by).agg(ratio(F.sum("reference_len"), F.sum("segments")).alias("chars_per_segment"), F.sum("segments").alias("segments"))


def percentiles(rows: DataFrame, by: str, value: str = "rate", at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``(by, p, value)``: the value at rank ``floor((n - 1) * p)`` of each group; a null value is the least.

    Exact selection without sorting a group: equal values are counted once, then each
    rank looks at a histogram of BUCKETS equal widths, and goes on inside the bucket that
    holds it, until that has SORTED values or fewer. No window sees more than these.
    """
    counts = materialise(rows.groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    nulls = F.sum(F.when(F.col("_value").isNull(), F.col("_n")).otherwise(0))
    edges = [F.count("_value").alias("_values"), F.min("_value").alias("_low"), F.max("_value").alias("_high")]
    ranks = counts.groupBy("_by").agg(F.sum("_n").alias("_all"), nulls.alias("_nulls"), *edges).withColumn("_p", F.explode(F.array(*map(F.lit, at))))
    ranks = ranks.withColumn("_rank", F.floor((F.col("_all") - 1) * F.col("_p")) - F.col("_nulls")).select(F.col("_by").alias("_of"), "_p", "_rank", "_values", "_low", "_high")
    narrow, found = (F.col("_values") <= SORTED) | (F.col("_low") == F.col("_high")) | (F.col("_rank") < 0), []

    def inside(held: DataFrame) -> DataFrame:
        return counts.join(held, counts["_by"].eqNullSafe(held["_of"]) & F.col("_value").between(F.col("_low"), F.col("_high")))

    def holding(parts: DataFrame, order: str) -> DataFrame:
        """Of each rank's parts ``(_of, _p, _rank, _n)`` the one it is in, with its rank there."""
        before = Window.partitionBy("_of", "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumn("_rank", F.col("_rank") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return placed.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))

    ranks = materialise(ranks, "ranks")
    while True:
        found.append(ranks.where(narrow))
        wide = ranks.where(~narrow)
        if wide.isEmpty():
            break
        share = (F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        buckets = inside(wide).groupBy("_of", "_p", "_rank", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("_bucket")).agg(F.sum("_n").alias("_n"), *edges)
        ranks = materialise(holding(buckets, "_bucket").select("_of", "_p", "_rank", "_values", "_low", "_high"), "ranks")
    held = found[0]
    for x in found[1:]:
        held = held.unionByName(x)
    valued = holding(inside(held).select("_of", "_p", "_rank", "_n", "_value"), "_value").select("_of", "_p", "_value")
    none = held.where("_rank < 0").select("_of", "_p", F.lit(None).cast(counts.schema["_value"].dataType).alias("_value"))
    return valued.unionByName(none).select(F.col("_of").alias(by), F.col("_p").alias("p"), F.col("_value").alias(value))


def worst(rows: DataFrame, by: str, pos: str, n: int = WORST) -> DataFrame:
    """The ``n`` files with most errors of each dataset, the longer reference first, then the earlier."""
    order = Window.partitionBy(by).orderBy(F.desc("errors"), F.desc("reference_len"), pos)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_rows(rows: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """The first ``n`` rows of each dataset, before anything is scored."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(pos))).where(F.col("_n") <= n).drop("_n")


def punctuated(rows: DataFrame, by: str, pos: str, marks: str, text: str = "reference") -> DataFrame:
    """Whether any of a dataset's first references has a mark."""
    has = F.col(text) != F.translate(text, marks, "")
    return first_rows(rows, by, pos, PROBED).groupBy(by).agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("punctuated"))


def dump_lines(rows: DataFrame) -> DataFrame:
    """A tab-separated line for each of ``rows (utt_id, errors, reference, hypothesis, coverage, recovered)``.

    Coverage has four decimals, as ``printf`` rounds it; see ``numbers.fixed``.
    """
    coverage = F.coalesce(fixed("coverage", 4), F.lit("-"))
    return rows.select("utt_id", F.concat_ws("\t", F.col("utt_id").cast("string"), F.col("errors").cast("string"), "reference", "hypothesis", coverage, F.when(F.col("recovered"), "1").otherwise("0")).alias("line"))


def coverage_bucket(coverage: str = "coverage", edges: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9, 0.99)) -> Column:
    """The first edge above a coverage, or 1; null where it can't be judged."""
    out = F.when(F.col(coverage).isNull(), F.lit(None).cast("double"))
    for e in edges:
        out = out.when(F.col(coverage) < e, F.lit(e))
    return out.otherwise(F.lit(1.0))


def guard_sweep(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """What each floor of the guard would do to ``rows (coverage, errors_first, errors_second)``.

    A file under the floor takes its second reading: how many fire, get better, stay the
    same and get worse, the errors gained or lost, and the errors of all files then.
    """
    rows = rows.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    fires = F.coalesce(F.col("coverage") < F.col("floor"), F.lit(False))
    change = F.col("errors_second") - F.col("errors_first")
    return rows.groupBy("floor").agg(
        F.count_if(fires).alias("fired"), F.count_if(fires & (change < 0)).alias("better"), F.count_if(fires & (change == 0)).alias("same"), F.count_if(fires & (change > 0)).alias("worse"),
        F.sum(F.when(fires, change).otherwise(0)).alias("net_errors"), F.sum(F.when(fires, F.col("errors_second")).otherwise(F.col("errors_first"))).alias("errors"),
    )


def _share(value: Column, decimals: int = 1) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{decimals}f%%", value * 100))


def summary_lines(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """``(by, line)``: a dataset's line of the summary, in columns of fixed width; what can't be known is a dash, and a half is rounded up.

    ``rows`` has ``files, cer, exact_pct, f1, chars_per_segment, seconds, mean_coverage,
    recovered`` of each dataset.
    """
    cells = [
        F.rpad(F.col(by), F.greatest(F.lit(20), F.length(by)), " "), *(_right(x, n) for x, n in (
            (F.col("files").cast("string"), 6), (_share(F.col("cer"), 2), 8), (_share(F.col("exact_pct") / 100), 8), (_share(F.col("f1")), 9), (F.format_string("%.1f", "chars_per_segment"), 8),
            (F.format_string("%.0fs", "seconds"), 7), (_share(F.col("mean_coverage")), 7), (F.col("recovered").cast("string"), 5),
        )),
    ]
    return rows.select(by, F.concat_ws(" ", *cells).alias("line"))


def _right(text: Column, width: int) -> Column:
    """The text at the end of so many characters; a longer one as it is."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), " ")


def mark_rows(sums: DataFrame, by: str, marks: str) -> DataFrame:
    """``(by, ordinal, fact, value)`` beside ``detail_rows``: a line of the account for each mark of ``sums (mark, tp, fp, fn, precision, recall, f1)``, in the order of ``marks``, and one for all of them."""
    place = F.when(F.col("mark").isNull(), F.lit(len(marks))).otherwise(F.instr(F.lit(marks), F.col("mark")) - 1)
    shares = [_right(_share(F.col(c)), 7) for c in ("precision", "recall", "f1")]
    counts = [_right(F.col(c).cast("string"), 6) for c in ("tp", "fp", "fn")]
    return sums.select(by, (F.lit(500) + place).cast("int").alias("ordinal"), F.coalesce(F.concat(F.lit("mark "), "mark"), F.lit("marks overall")).alias("fact"), F.concat_ws(" ", *shares, *counts).alias("value"))


def detail_rows(rows: DataFrame, by: str, pos: str, worst_shown: int = WORST) -> DataFrame:
    """``(by, ordinal, fact, value)``: the account of each dataset: its roll-ups, how its error rates are distributed, and its worst files.

    ``rows`` has ``errors, reference_len, rate, segments, coverage, recovered, utt_id``. A
    dataset without a file has no rows.
    """
    all_ = roll_up(rows, by).join(coverage_roll_up(rows, by), by).join(mean_segment_chars(rows, by), by)
    facts = {
        "utterances": F.col("files").cast("string"), "reference chars": F.col("chars").cast("string"), "errors": F.col("errors").cast("string"), "CER": _share(F.col("cer"), 2),
        "segments": F.concat(F.col("segments").cast("string"), F.format_string(" (%.1f chars each)", "chars_per_segment")),
        "coverage": F.when(F.col("judged") > 0, F.concat(_share(F.col("mean_coverage")), F.lit(" mean, "), _share(F.col("min_coverage")), F.lit(" lowest of "), F.col("judged").cast("string"))),
        "recovered": F.col("recovered").cast("string"), "exact matches": F.concat(F.col("exact").cast("string"), F.lit(" ("), _share(F.col("exact_pct") / 100), F.lit(")")),
    }
    named = all_.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("fact"), v.alias("value")) for k, (n, v) in enumerate(facts.items())))).alias("x")).select(by, "x.*").where("value is not null")
    spread = percentiles(rows.withColumn("value", F.col("rate")), by, "value")
    spread = spread.select(by, (F.lit(100) + F.round(F.col("p") * 100)).cast("int").alias("ordinal"), F.format_string("p%.0f", F.col("p") * 100).alias("fact"), _share(F.col("value")).alias("value"))
    most = worst(rows, by, pos, worst_shown).select(by, (F.lit(1000) + F.col("rank")).cast("int").alias("ordinal"), F.col("utt_id").alias("fact"), F.concat(F.col("errors").cast("string"), F.lit(" errors / "), F.col("reference_len").cast("string"), F.lit(" chars")).alias("value"))
    return named.unionByName(spread).unionByName(most)
