"""Punctuation: marks attached to characters, aligned, and scored by mark."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriba.operators.scoring import ratio

#: The marks that are scored, in the order of reports.
MARKS = "，。？！"
_CELLS = "array<struct<mark: string, tp: long, fp: long, fn: long>>"
Token = tuple[str, str | None]


def tokenize(text: str, marks: str = MARKS) -> list[Token]:
    """Letters and digits, each with the first mark that follows it.

    A mark before any character is dropped, and so is all that is neither; what is
    dropped doesn't come between a character and its mark.
    """
    out: list[list] = []
    for c in text:
        if c in marks:
            if out and out[-1][1] is None:
                out[-1][1] = c
        elif c.isalnum():
            out.append([c, None])
    return [tuple(x) for x in out]


#: Half the width of the first band of cells that is tried, and the columns of a block of it at least.
FIRST_BAND, LEAST_BLOCK = 512, 512
#: Columns are kept for the way back while they have so many bits in all; more are computed again, block by block.
KEPT_BITS = 1 << 27


class _Block(NamedTuple):
    """Columns ``[j, end)`` of a band over rows ``[top, bottom)``, as bits by row: what the last column steps down by, and where the diagonal is free."""

    j: int
    end: int
    top: int
    bottom: int
    up: int
    down: int
    columns: tuple[list[int], list[int]] | None


def _swept(a: str, b: str, j: int, end: int, top: int, bottom: int, up: int, down: int) -> tuple[int, int, list[int], list[int]]:
    """Columns of the distance matrix over some rows, all rows of a column at once.

    ``up`` and ``down`` are the rows whose cell is one more or less than that above, in the
    column before. The row above the first counts one more with each column. For each
    column: the rows that are one more than above, and those where the diagonal costs nothing.
    """
    mask, rows = (1 << (bottom - top)) - 1, {}
    for i, c in enumerate(a[top:bottom]):
        rows[c] = rows.get(c, 0) | 1 << i
    ups, frees = [], []
    for c in b[j:end]:
        same = rows.get(c, 0)
        free = (((same & up) + up) ^ up) | same | down
        right = down | ~(free | up) & mask
        left = free & up
        right, left = (right << 1 | 1) & mask, left << 1 & mask
        up, down = left | ~(free | right) & mask, right & free & mask
        ups.append(up)
        frees.append(free & mask)
    return up, down, ups, frees


def _banded(a: str, b: str, most: int) -> tuple[int, list[_Block]]:
    """A distance that is right if it is no more than ``most``, and the blocks it came from.

    A path of so few edits stays near the diagonals from start to end. Rows that come into
    the band from below count one more than the row above: such cells are never too low, so
    they change no cell of a cheapest path.
    """
    n, m = len(a), len(b)
    spare = max(0, most - abs(m - n)) // 2 + 1
    above, below = spare + max(0, m - n), spare + max(0, n - m)  # how far the band goes to either side of i = j
    size = max(LEAST_BLOCK, above + below)
    keep = m * min(n, above + below + size) * 2 <= KEPT_BITS
    blocks, top, bottom, up, down, first = [], 0, 0, 0, 0, 0
    for j in range(0, m, size):
        end = min(j + size, m)
        new_top, new_bottom = max(0, min(j - above, n)), min(n, end + below)
        gone = (1 << (new_top - top)) - 1
        first += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> (new_top - top), down >> (new_top - top)
        known = max(0, bottom - new_top)
        up |= (1 << (new_bottom - new_top)) - (1 << known)
        top, bottom = new_top, new_bottom
        after_up, after_down, ups, frees = _swept(a, b, j, end, top, bottom, up, down)
        blocks.append(_Block(j, end, top, bottom, up, down, (ups, frees) if keep else None))
        first += end - j
        up, down = after_up, after_down
    return first + up.bit_count() - down.bit_count() + (n - bottom), blocks


def align(ref: str, hyp: str) -> list[tuple[int | None, int | None]]:
    """The positions of a cheapest alignment in order; a side that lacks one has None.

    Where several are as cheap, from the end a pair of both sides comes first, then a
    deletion, then an insertion. What both texts end with is paired, and what they begin
    with needs no matrix either. Of the rest only a band of the matrix is computed, twice
    as wide until it holds every path that is as cheap as the distance, and a column of it
    is a few operations on whole numbers of bits.
    """
    n, m, tail = len(ref), len(hyp), 0
    while tail < min(n, m) and ref[n - tail - 1] == hyp[m - tail - 1]:
        tail += 1
    out: list[tuple[int | None, int | None]] = [(n - k, m - k) for k in range(1, tail + 1)]
    i, j, head = n - tail, m - tail, 0
    while head < min(i, j) and ref[head] == hyp[head]:
        head += 1
    a, b, most = ref[head:i], hyp[head:j], max(FIRST_BAND, abs(i - j))
    if a and b:
        distance, blocks = _banded(a, b, most)
        while distance > most:
            most *= 2
            distance, blocks = _banded(a, b, most)
        while i > head and j > head:
            block = blocks.pop()
            ups, frees = block.columns or _swept(a, b, *block[:6])[2:]
            while j - head > block.j and i > head:
                row, at = i - head - 1 - block.top, j - head - 1 - block.j
                if ref[i - 1] == hyp[j - 1] or not frees[at] >> row & 1:
                    i, j = i - 1, j - 1
                    out.append((i, j))
                elif ups[at] >> row & 1:
                    i -= 1
                    out.append((i, None))
                else:
                    j -= 1
                    out.append((None, j))
    while i or j:  # one side is what both begin with, so the other has a pair or one more
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i > j:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def score_pair(reference: str, hypothesis: str, marks: str = MARKS) -> dict[str, list[int]]:
    """``[tp, fp, fn]`` by mark, at the characters that both sides have."""
    ref, hyp = tokenize(reference, marks), tokenize(hypothesis, marks)
    cells: dict[str, list[int]] = {}
    for i, j in align("".join(c for c, _ in ref), "".join(c for c, _ in hyp)):
        if i is None or j is None or ref[i][0] != hyp[j][0]:
            continue
        a, b = ref[i][1], hyp[j][1]
        if a == b:
            if a:
                cells.setdefault(a, [0, 0, 0])[0] += 1
            continue
        if b:
            cells.setdefault(b, [0, 0, 0])[1] += 1
        if a:
            cells.setdefault(a, [0, 0, 0])[2] += 1
    return cells


def cells_of(reference: str, hypothesis: str, marks: str = MARKS) -> Column:
    """The scores of a pair as an array of ``(mark, tp, fp, fn)``. A null side counts as empty."""

    def run(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        found = (score_pair(a or "", b or "", marks) for a, b in zip(refs, hyps, strict=True))
        return pd.Series([[{"mark": m, "tp": v[0], "fp": v[1], "fn": v[2]} for m, v in sorted(x.items())] for x in found])

    return F.pandas_udf(run, _CELLS)(F.col(reference), F.col(hypothesis))


def same_text_cells(reference: str, hypothesis: str, marks: str = MARKS) -> Column:
    """As ``cells_of`` where both sides have the same characters: no alignment and no Python.

    Each character takes the first mark of the run that follows it; a mark that one side
    has alone is a cell of its own.
    """
    run = "[^\\p{IsAlphabetic}\\p{N}]*"

    def attached(text: str) -> Column:
        runs = F.regexp_extract_all(F.col(text), F.lit(f"[\\p{{IsAlphabetic}}\\p{{N}}]({run})"), 1)
        return F.transform(runs, lambda x: F.nullif(F.substring(F.regexp_replace(x, f"[^{marks}]", ""), 1, 1), F.lit("")))

    def cell(mark: Column, tp: int, fp: int, fn: int) -> Column:
        return F.struct(mark.alias("mark"), *(F.lit(n).cast("long").alias(x) for n, x in ((tp, "tp"), (fp, "fp"), (fn, "fn"))))

    def judged(a: Column, b: Column) -> Column:
        return F.when(a.eqNullSafe(b), F.array(cell(a, 1, 0, 0))).otherwise(F.array(cell(b, 0, 1, 0), cell(a, 0, 0, 1)))

    return F.filter(F.flatten(F.zip_with(attached(reference), attached(hypothesis), judged)), lambda x: x["mark"].isNotNull())


def mark_sums(cells: DataFrame, *by: str) -> DataFrame:
    """Sums of ``cells (mark, tp, fp, fn)`` by mark, and over all marks where ``mark`` is null."""
    keys = [F.col(c) for c in by]
    sums = cells.groupingSets([[*keys, F.col("mark")], keys], *keys, F.col("mark"))
    return sums.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select("mark", *by, "tp", "fp", "fn")


def with_prf(sums: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def in_report_order(sums: DataFrame, *by: str, marks: str = MARKS) -> DataFrame:
    return sums.orderBy(*by, F.instr(F.lit(marks), F.coalesce("mark", F.lit("\0"))))
