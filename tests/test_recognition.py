import random

import numpy as np
import pytest

from scriba.functions import engines
from scriba.operators import recognition

SCHEMA = "file_id string, start long, samples array<float>"
engines.register(engines.Engine("sums", "Sums", lambda: lambda x: "" if len(x) < 3 else f"{x.sum():.0f}"))


def some_spans():
    rng = random.Random(4)
    return [(f, k * 10, [float(rng.randrange(5)) for _ in range(rng.randrange(0, 9))]) for f in ("a", "b", "c") for k in range(20)]


def plain(rows):
    out, n = [], {}
    for f, start, x in sorted(rows):
        if len(x) >= 3:
            out.append((f, n.setdefault(f, 0), start, len(x), f"{np.float32(x).sum():.0f}"))
            n[f] += 1
    return out


def segments(df):
    return sorted((r.file_id, r.seg_id, r.start, r.n, r.text) for r in df.collect())


def test_a_resumed_run_is_like_one_that_never_stopped(spark, tmp_path):
    rows = some_spans()
    spans, log = spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "log")
    assert segments(recognition.recognise_spans(spans, "sums")) == plain(rows)
    part = spark.createDataFrame([r for r in rows if r[0] == "a" or (r[0] == "b" and r[1] < 70)], SCHEMA)
    recognition.recognise_spans(part, "sums", log, number=0)
    out = recognition.recognise_spans(spans, "sums", log, number=1)
    assert segments(out) == plain(rows)
    assert {(r.file_id, r.reused) for r in out.collect()} == {("a", True), ("b", True), ("b", False), ("c", False)}
    again = recognition.recognise_spans(spans, "sums", log, number=2)
    assert segments(again) == plain(rows) and all(r.reused for r in again.collect())


def test_a_span_that_changed_is_heard_again_and_a_run_may_come_twice(spark, tmp_path):
    log = str(tmp_path / "log")
    one = spark.createDataFrame([("a", 0, [1.0] * 4), ("a", 10, [2.0] * 4)], SCHEMA)
    for _ in range(2):
        assert segments(recognition.recognise_spans(one, "sums", log, number=0)) == [("a", 0, 0, 4, "4"), ("a", 1, 10, 4, "8")]
    other = spark.createDataFrame([("a", 0, [1.0] * 4), ("a", 10, [3.0] * 4), ("a", 11, [2.0] * 4)], SCHEMA)
    got = recognition.recognise_spans(other, "sums", log, number=1)
    assert [(r.text, r.reused) for r in got.orderBy("seg_id").collect()] == [("4", True), ("12", False), ("8", False)]


def test_a_log_that_takes_nothing_costs_no_transcript(spark, tmp_path, monkeypatch):
    def full(*args, **kwargs):
        raise OSError("no space")

    monkeypatch.setattr(recognition, "append_log", full)
    with pytest.warns(UserWarning, match="no space"):
        out = recognition.recognise_spans(spark.createDataFrame(some_spans(), SCHEMA), "sums", str(tmp_path / "log"))
    assert segments(out) == plain(some_spans())


def test_no_spans_and_no_engine(spark):
    assert recognition.recognise_spans(spark.createDataFrame([], SCHEMA), "sums").collect() == []
    with pytest.raises(KeyError, match="no engine 'other'"):
        recognition.recognise_spans(spark.createDataFrame([], SCHEMA), "other")


def test_queries_leave_the_list_of_engines_as_it_is(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.delitem(engines._engines, "sums")
    queries = entry.queries()
    for name in ("recognised_resumed", "vocabularies_applied"):  # both use an engine of their own
        queries[name](spark, "/root/testdata/sf0.001")
    assert [tuple(r) for r in queries["engine_list"](spark, "/root/testdata/sf0.001").collect()] == [("fixed", "Fixed words", False, False, True)]
