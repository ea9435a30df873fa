import math

import pytest
from pyspark.sql import functions as F

from scriba.operators import signal

RATE, HOP = 16_000, 512


def test_rms_and_blocks(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([],), ([0.1] * 10,)], "s array<float>")
    assert [round(r[0], 5) for r in df.select(signal.rms("s")).collect()] == [round(math.sqrt(12.5), 5), 0.0, 0.1]
    assert [[len(b) for b in r[0]] for r in df.select(signal.blocks("s", 4)).collect()] == [[2], [], [4, 4, 2]]


@pytest.mark.parametrize(("spans", "want"), [([(0.0, 1.0), (0.5, 1.5)], 1.5), ([(0.0, 2.0), (0.5, 1.0)], 2.0), ([(0.0, 1.0), (2.0, 3.0)], 2.0), ([(2.0, 3.0), (0.0, 1.0)], 1.0), ([], None)])
def test_union_counts_each_sample_once_in_order_of_arrival(spark, spans, want):
    rows = [("f", k, int(a * RATE), int((b - a) * RATE)) for k, (a, b) in enumerate(spans)]
    got = signal.union_length(spark.createDataFrame(rows, "file_id string, seq int, start long, n long")).collect()
    assert [r.voiced / RATE for r in got] == ([want] if want is not None else [])


GUARD = [(1.43, 5.0, 0.7, True), (5.0, 5.0, 0.7, False), (4.5, 5.0, 0.7, False), (0.0, 0.0, 0.7, False), (0.16, 0.5, 0.7, False), (0.0, 9.0, 0.0, False), (0.0, 9.0, 0.7, True)]


@pytest.mark.parametrize(("voiced", "energetic", "floor", "want"), GUARD)
def test_guard(spark, voiced, energetic, floor, want):
    df = spark.createDataFrame([(voiced, energetic)], "v double, e double")
    assert df.select(signal.should_recover("v", "e", floor)).first()[0] is want


def test_ratio_is_null_without_sound_and_at_most_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (9.0, 5.0), (1.0, 0.0)], "v double, e double")
    assert [r[0] for r in df.select(signal.coverage_ratio("v", "e")).collect()] == [0.2, 1.0, None]


def test_silence_has_no_sound(spark):
    rows = [("quiet", 0, [1e-4] * 20), ("loud", 0, [0.3] * 10 + [0.001] * 10)]
    windows = signal.windows_of(spark.createDataFrame(rows, "file_id string, seq int, samples array<float>"), 10)
    got = {(r.file_id, r.window): r.energetic for r in signal.energetic(windows).collect()}
    assert got == {("quiet", 0): False, ("quiet", 1): False, ("loud", 0): True, ("loud", 1): False}


@pytest.mark.parametrize(("seconds", "want"), [(5, [5]), (50, [20, 20, 10]), (20, [20]), (20.5, [20, 0.5]), (61, [20, 20, 20, 1]), (0.5, [0.5])])
def test_fixed_blocks_lose_nothing(spark, seconds, want):
    total = int(seconds * RATE)
    chunks = [("f", min(1600, total - at)) for at in range(0, total, 1600)]
    rows = signal.fixed_blocks(spark.createDataFrame(chunks, "file_id string, n long")).orderBy("block").collect()
    assert [r.n / RATE for r in rows] == want and [r.start for r in rows] == [sum(int(w * RATE) for w in want[:k]) for k in range(len(want))]


def test_sessions_close_at_the_gap_and_become_spans(spark):
    ms = [0, 100, 200, 300, 700, 800, 5000] + list(range(10_000, 60_000, 100))
    frames = spark.createDataFrame([("f", m / 1000, 0.9) for m in ms] + [("f", 0.45, 0.01)], "file_id string, s double, score double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    sessions = signal.gap_sessions(frames).withColumns({"start_s": F.col("start").cast("double"), "end_s": F.col("end").cast("double")})
    assert sorted((r.start_s, r.end_s, r.frames) for r in sessions.collect()) == [(0.0, 0.3, 4), (0.7, 0.8, 2), (5.0, 5.0, 1), (10.0, 59.9, 500)]
    spans = sorted((round(r.span_start, 3), round(r.span_end, 3)) for r in signal.speech_spans(sessions).collect())
    assert spans == [(0.0, 0.3), (9.6, 30.0), (30.0, 50.0), (50.0, 59.9)]


def test_two_passes_and_numbering(spark):
    first = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "file_id string, seq int, text string")
    second = spark.createDataFrame([("a", 0, "X1"), ("a", 1, ""), ("a", 2, "X2")], "file_id string, seq int, text string")
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "file_id string, recovered boolean")
    got = signal.segments_of(signal.two_pass(first, second, verdicts)).collect()
    assert sorted((r.file_id, r.seg_id, r.text, r.recovered) for r in got) == [("a", 0, "X1", True), ("a", 1, "X2", True), ("b", 0, "y", False)]


def test_context_reaches_over_chunks_as_far_as_history_is_kept(spark):
    import random

    rng = random.Random(5)
    chunks, spans, want = [], [], {}
    for f in ("a", "b"):
        samples, kept, ends = [], 0, []
        for _ in range(40):
            n = rng.randrange(1, 9)
            chunks.append((f, len(samples), [float(len(samples) + k) for k in range(n)]))
            samples += [float(len(samples) + k) for k in range(n)]
            if len(samples) - kept > 2 * 30:
                kept = len(samples) - 30
            ends.append((len(samples), kept))
        for k in range(25):
            seen, left = rng.choice(ends)
            start = rng.randrange(max(0, seen - 60), seen)
            begin = max(0, start - 12)
            spans.append((f, k, start, seen))
            want[f, k] = (samples[begin:start], samples[begin:start] if begin >= left else [])
    spans = spark.createDataFrame(spans, "file_id string, span int, start long, seen long")
    chunks = spark.createDataFrame(chunks, "file_id string, start long, samples array<float>")
    got = {(r.file_id, r.span): r.context or [] for r in signal.with_context(spans, chunks, 12).collect()}
    assert got == {k: a for k, (a, _) in want.items()}
    got = {(r.file_id, r.span): r.context or [] for r in signal.with_context(spans, chunks, 12, retained=30).collect()}
    assert got == {k: b for k, (_, b) in want.items()} and any(a != b for a, b in want.values())


def test_thresholds(spark):
    df = spark.createDataFrame([(0.02,), (1.0,)], "t double")
    assert [r[0] for r in df.select(signal.checked_threshold("t")).collect()] == [0.02, 1.0]
    for bad in (0.01, 1.5, None):
        with pytest.raises(Exception, match="between 0.02 and 1"):
            spark.createDataFrame([(bad,)], "t double").select(signal.checked_threshold("t")).collect()


def plain_frames(samples, hop):
    return [(k, k * hop, samples[k * hop : (k + 1) * hop]) for k in range(-(-len(samples) // hop))]


@pytest.mark.parametrize("hop", [1, 7, 24, 1000])
def test_frames_are_the_same_for_any_split(spark, hop):
    import random

    rng = random.Random(hop)
    files = {f: [float(k) for k in range(rng.randrange(1, 400))] for f in ("a", "b")} | {"one": [5.0]}
    want = {(f, *x[:2], tuple(x[2])) for f, s in files.items() for x in plain_frames(s, hop)}
    for longest in (1, 5, 24, 60, 500):
        chunks = [("none", 0, []), ("none", 0, None)]
        for f, s in files.items():
            at = 0
            while at < len(s):
                n = rng.randrange(1, longest + 1)
                chunks.append((f, at, s[at : at + n]))
                at += n
        got = signal.frames_of(spark.createDataFrame(chunks, "file_id string, start long, samples array<float>"), hop)
        assert {(r.file_id, r.frame, r.start, tuple(r.samples)) for r in got.collect()} == want


@pytest.mark.parametrize("block", [20, 10**6])
def test_voice_spans_are_those_of_the_segmenter(spark, monkeypatch, block):
    import random

    from scriba.operators import scans, segmenters

    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rng = random.Random(block)
    frames = []
    for f in ("hot", "a", "b"):
        loud = False
        for k in range(400 if f == "hot" else 60):
            loud = loud if rng.random() < 0.7 else not loud
            frames.append((f, k * HOP, HOP if k < 399 else 100, 0.9 if loud else 0.01))
    df = spark.createDataFrame(frames, "file_id string, start long, n long, score double")
    got = signal.voice_spans(df, 0.05, silence=3 * HOP, shortest=2 * HOP, longest=5 * HOP)
    want = segmenters.segmented(df, lambda: segmenters.Gaps(0.05, silence=3 * HOP, shortest=2 * HOP, longest=5 * HOP))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
