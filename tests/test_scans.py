import random

import pytest
from pyspark.sql import functions as F

from scriba.operators import scans, signal


def rows_of(seed, n=900):
    """A third of all rows and more are one group's; values and groups may be null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), k * rng.choice([1, 1, 1, 50]) + 10**6 * (k > 800), rng.choice([None, k % 17, -k])) for k in range(n)]


def expected(rows, through):
    out, state = [], {}
    for g, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or 0)):
        s = state.setdefault(g, [])
        seen = [x for x in ([*s, v] if through else s) if x is not None]
        out.append((g, at, v, sum(seen), len(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None))
        s.append(v)
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "through", "block"), [(1, False, 40), (2, True, 40), (3, False, 7), (4, True, 10**6)])
def test_running_values_equal_a_fold(spark, seed, through, block):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(5)
    values = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "last": ("last", F.col("v"))}
    # ties in ``at`` are ordered by the value, nulls first
    got = scans.running(df, "g", ["at", "v"], values, through=through, block_rows=block)
    assert got.columns == ["g", "at", "v", *values]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, through)


def test_a_hot_group_is_more_than_one_task(spark):
    n = 4000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = scans.running(df, "g", "at", {"n": ("count", F.lit(1))}, block_rows=100).withColumn("task", F.spark_partition_id()).where("g = -1")
        by_task = [r["count"] for r in got.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(by_task) > 1 and max(by_task) < sum(by_task)
    assert [r.n for r in got.orderBy("at").collect()] == list(range(len(range(0, n, 3))))


def test_cuts_are_at_quantiles_however_the_order_is_spread(spark):
    """One row far off doesn't put all others into one block."""
    df = spark.createDataFrame([("g", k if k < 999 else 10**12) for k in range(1000)], "g string, at long")
    edges = scans._edges(df, "g", "at", 100).first()._scan_edges
    assert len(edges) == 9 and all(80 <= b - a <= 120 for a, b in zip(edges, edges[1:], strict=False))


@pytest.mark.parametrize("block", [30, 10**6])
def test_as_of(spark, block):
    rng = random.Random(block)
    left = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(500), k) for k in range(400)]
    right = [(g, since, since * 10 + len(str(g))) for g in ("hot", "a", None) for since in rng.sample(range(500), 60)]
    got = scans.as_of(spark.createDataFrame(left, "g string, at long, k int"), spark.createDataFrame(right, "g string, since long, v long"), "g", "at", "since", ["v"], block_rows=block)
    want = [(g, at, k, max(((s, v) for h, s, v in right if h == g and s <= at), default=(0, None))[1]) for g, at, k in left]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, at long")
    assert scans.running(empty, "g", "at", {"n": ("count", F.lit(1))}).collect() == []


@pytest.mark.parametrize("block", [25, 10**6])
def test_signals_over_a_file_in_blocks(spark, monkeypatch, block):
    """What is said of a file doesn't depend on how many tasks it took."""
    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rng = random.Random(3)
    chunks = [("hot" if k % 3 else f"f{k % 9}", k, rng.randrange(1, 30)) for k in range(600)]
    spans = [(f, k, rng.randrange(0, 5000), rng.randrange(1, 90)) for f, k, _ in chunks]
    want, mark = {}, {}
    for f, _, a, n in spans:
        want[f] = want.get(f, 0) + max(0, a + n - max(a, mark.get(f, 0)))
        mark[f] = max(mark.get(f, 0), a + n)
    got = signal.union_length(spark.createDataFrame(spans, "file_id string, seq long, start long, n long"))
    assert {r.file_id: r.voiced for r in got.collect()} == want
    at, starts = {}, {}
    for f, k, n in chunks:
        starts[k] = at.get(f, 0)
        at[f] = starts[k] + n
    got = signal.chunk_starts(spark.createDataFrame(chunks, "file_id string, seq long, n long"))
    assert {r.seq: r.start for r in got.collect()} == starts
    # a sweep: segments before the progress of the chunk that completes them
    ends = {f: sorted(starts[k] + n for g, k, n in chunks if g == f) for f in at}
    known = [(f, e - rng.randrange(0, 3), rng.choice(["x", "x", ""])) for f in ends for e in rng.sample(ends[f], 20)]
    known = list({(f, e): (f, e, t) for f, e, t in known}.values())
    got = signal.swept(spark.createDataFrame(known, "file_id string, end long, text string"), spark.createDataFrame([(f, e) for f in ends for e in ends[f]], "file_id string, end long"))
    want = {(f, e, 1, "progress", None) for f in ends for e in ends[f]}
    for f in ends:
        for k, (_, e, _) in enumerate(sorted(x for x in known if x[0] == f and x[2])):
            want.add((f, min(c for c in ends[f] if c >= e), 0, "segment", k))
    assert {tuple(r) for r in got.select("file_id", "at", "ordinal", "kind", "seg_id").collect()} == want
    padded = signal.padded(spark.createDataFrame([(f, k, [float(k)] * n) for f, k, n in chunks], "file_id string, seq long, samples array<float>"), 4)
    before = {}
    for f, k, n in chunks:
        before[k] = [float(before[f][0])] * min(4, before[f][1]) if f in before else []
        before[f] = (k, n)
    assert all(r.padded == before[r.seq] + r.samples for r in padded.collect())
