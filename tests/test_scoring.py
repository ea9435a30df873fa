import math
import random

import pytest
from pyspark.sql import functions as F

from scriba.operators import punctuation, scoring

CER = [
    ("开放时间", "开放时间", 0, 4, 0.0), ("你好，世界。", "你好世界", 0, 4, 0.0), ("开放时间", "开饭时间", 1, 4, 0.25), ("开放时间", "开时间", 1, 4, 0.25),
    ("tuesday", "tuesdayesday", 5, 7, 5 / 7), ("Tuesday", "tuesday", 0, 7, 0.0), ("开放时间", "", 4, 4, 1.0), ("", "anything", 8, 0, 0.0), ("ΟΔΟΣ", "οδοσ", 0, 4, 0.0),
]


def test_error_rates(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(CER)], "k int, reference string, hypothesis string")
    got = {r.k: (r.errors, r.reference_len, r.rate) for r in scoring.scored(df).collect()}
    for k, (_, _, errors, n, rate) in enumerate(CER):
        assert got[k] == (errors, n, pytest.approx(rate))


def test_roll_up_counts_errors_against_empty_references(spark):
    rows = spark.createDataFrame([("a", 2, 10), ("a", 8, 0), ("a", 0, 10), ("b", 3, 0)], "d string, errors long, reference_len long")
    got = {r.d: r for r in scoring.roll_up(rows, "d").collect()}
    assert (got["a"].cer, got["a"].exact, got["a"].files) == (0.5, 1, 3) and got["b"].cer == 0.0


@pytest.mark.parametrize(("buckets", "few"), [(4096, 100_000), (3, 2), (7, 1)])
def test_percentiles_by_refining_histograms(spark, monkeypatch, buckets, few):
    """Ranks in skewed values, in groups with nulls, repeats and one value alone."""
    monkeypatch.setattr(scoring, "BUCKETS", buckets)
    monkeypatch.setattr(scoring, "SORTED", few)
    rng = random.Random(buckets)
    values = [(rng.choice(["a", "a", None]), rng.choice([rng.random() ** 9, rng.random() * 1e6, 0.25, None, -3.0])) for _ in range(700)] + [("one", 5.0), ("none", None), ("none", None)]
    got = {(r.d, r.p): r.rate for r in scoring.percentiles(spark.createDataFrame(values, "d string, rate double"), "d", at=(0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    want = {}
    for d in {d for d, _ in values}:
        own = sorted((v for g, v in values if g == d), key=lambda v: (v is not None, v or 0))
        want |= {(d, p): own[int((len(own) - 1) * p)] for p in (0.0, 0.1, 0.5, 0.9, 1.0)}
    assert got == want


def test_percentile_is_the_floor_rank(spark):
    values = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0)] * 3
    got = {(r.d, r.p): r.rate for r in scoring.percentiles(spark.createDataFrame(values, "d string, rate double"), "d").collect()}
    assert got["a", 0.9] == 3.0 and got["a", 0.5] == 2.0 and got["b", 0.99] == 5.0
    rng = random.Random(1)
    many = [rng.randrange(30) / 10 for _ in range(500)]
    rows = scoring.percentiles(spark.createDataFrame([("x", v) for v in many], "d string, rate double"), "d").collect()
    assert all(r.rate == sorted(many)[int((len(many) - 1) * r.p)] for r in rows) and len(rows) == 3


def test_worst_breaks_ties_by_length_then_position(spark):
    rows = spark.createDataFrame([("a", k, e, n) for k, (e, n) in enumerate([(1, 5), (3, 5), (3, 9), (3, 9), (0, 1)])], "d string, pos int, errors long, reference_len long")
    assert [r.pos for r in scoring.worst(rows, "d", "pos", 4).orderBy("rank").collect()] == [2, 3, 1, 0]


TOKENS = [("你好，世界。", [("你", None), ("好", "，"), ("世", None), ("界", "。")]), ("好。」", [("好", "。")]), ("好…啊", [("好", None), ("啊", None)]), ("，好。？", [("好", "。")])]


@pytest.mark.parametrize(("text", "tokens"), TOKENS)
def test_tokens(text, tokens):
    assert punctuation.tokenize(text) == tokens


PAIRS = [
    ("你好，世界。", "你好，世界。", {"，": [1, 0, 0], "。": [1, 0, 0]}),
    ("你好，世界。", "你好世界。", {"，": [0, 0, 1], "。": [1, 0, 0]}),
    ("你好。", "你好？", {"。": [0, 0, 1], "？": [0, 1, 0]}),
    ("你好，世界。", "你好。世界。", {"。": [1, 1, 0], "，": [0, 0, 1]}),
    ("土地，很好。", "土也，很好。", {"。": [1, 0, 0]}),
    ("你好，世界。", "你好世界", {"，": [0, 0, 1], "。": [0, 0, 1]}),
]


@pytest.mark.parametrize(("ref", "hyp", "cells"), PAIRS)
def test_marks(ref, hyp, cells):
    assert punctuation.score_pair(ref, hyp) == cells


def slow_align(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


@pytest.mark.parametrize(("band", "block", "bits"), [(1, 1, 0), (2, 3, 1 << 27), (4, 5, 0), (512, 512, 1 << 27)])
def test_bands_of_any_width_give_the_same_alignment(monkeypatch, band, block, bits):
    for name, n in (("FIRST_BAND", band), ("LEAST_BLOCK", block), ("KEPT_BITS", bits)):
        monkeypatch.setattr(punctuation, name, n)
    rng = random.Random(band)
    for _ in range(300):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = [rng.choice(letters) for _ in range(rng.randrange(0, 40))]
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        assert punctuation.align("".join(a), "".join(b)) == slow_align("".join(a), "".join(b))


def test_near_texts_of_any_length_need_a_narrow_band():
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    b = a[:5000] + "xx" + a[5003:40_000] + "y" + a[40_000:]
    got = punctuation.align(a, b)
    assert len(got) == len(a) + 1 and sum(i is None or j is None or a[i] != b[j] for i, j in got) == 4
    assert max(x.bottom - x.top for x in punctuation._banded(a, b, punctuation.FIRST_BAND)[1]) < 2000


def test_alignment_equals_cell_by_cell():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert punctuation.align(a, b) == slow_align(a, b)
    a, b = ("".join(rng.choice("abcde") for _ in range(n)) for n in (230, 170))
    assert punctuation.align(a, b) == slow_align(a, b)


def test_both_ways_agree_on_the_same_characters(spark):
    rows = [("a, b? c.", "a. b? c"), ("x!y", "x, y."), ("", ""), (",a", ".a,")]
    df = spark.createDataFrame(rows, "r string, h string")
    with_python = df.select(punctuation.cells_of("r", "h", ",.?!").alias("x")).collect()
    without = df.select(punctuation.same_text_cells("r", "h", ",.?!").alias("x")).collect()
    for p, q in zip(with_python, without, strict=True):
        cells = {}
        for c in q.x:
            here = cells.setdefault(c.mark, [0, 0, 0])
            cells[c.mark] = [x + y for x, y in zip(here, (c.tp, c.fp, c.fn), strict=True)]
        assert {c.mark: [c.tp, c.fp, c.fn] for c in p.x} == cells


def test_precision_without_marks_is_zero(spark):
    row = punctuation.with_prf(spark.createDataFrame([("，", 0, 0, 2)], "mark string, tp long, fp long, fn long")).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_dump_line(spark):
    df = spark.createDataFrame([("u", 1, "r", "h", 0.5, True), ("v", 0, "r", "h", None, False)], "utt_id string, errors long, reference string, hypothesis string, coverage double, recovered boolean")
    assert [r.line for r in scoring.dump_lines(df).orderBy("utt_id").collect()] == ["u\t1\tr\th\t0.5000\t1", "v\t0\tr\th\t-\t0"]
    assert df.select(F.lit(1)).count() == 2


def test_dump_rounds_the_exact_value(spark):
    rng = random.Random(2)
    near = [k / 20000 for k in range(1, 20000, 2)]  # ties, or as near to one as a double gets
    values = [61 / 160, 2 / 13, 1 / 32, 3 / 32, 0.00005, 0.99995, 0.0, 1.0, *near, *(math.nextafter(v, 2) for v in near), *(math.nextafter(v, 0) for v in near), *(rng.random() for _ in range(2000)), *(rng.random() * 1e-4 for _ in range(500))]
    df = spark.createDataFrame([(str(k), 1, "r", "h", v, False) for k, v in enumerate(values)], "utt_id string, errors long, reference string, hypothesis string, coverage double, recovered boolean")
    got = {int(r.utt_id): r.line.split("\t")[4] for r in scoring.dump_lines(df).collect()}
    assert got == {k: f"{v:.4f}" for k, v in enumerate(values)} and got[0] == "0.3812" and got[2] == "0.0312"
