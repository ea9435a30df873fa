import pytest
from pyspark.sql import functions as F

from scriba.functions import engines
from scriba.operators import worklist as op
from scriba.sources import files as sources


def test_lists(spark):
    files = spark.createDataFrame([(1, 0, "a", "done"), (1, 1, "b", "running"), (1, 2, "c", "queued"), (1, 3, "d", "queued"), (2, 0, "x", "queued"), (2, 1, "y", "needs_model"), (3, 5, "z", "queued"), (3, 6, "q", "failed")], "list int, pos int, input string, state string")
    assert {r.list: r.pending for r in op.pending(files, "list").collect()} == {1: 3, 2: 2, 3: 1}
    assert sorted((r.list, r.place, r.input) for r in op.unfinished(files).collect()) == [(1, 0, "b"), (1, 1, "c"), (1, 2, "d"), (2, 0, "y"), (2, 1, "x"), (3, 0, "z")]
    assert {r.input for r in op.advanced(files).where("state = 'running'").collect()} == {"b", "z"}
    assert {r.input for r in op.advanced(files, checked=False).where("state = 'running'").collect()} == {"b", "c", "x", "z"}
    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "n"), (1, 2, "n"), (1, 3, "m"), (2, 0, "n"), (4, 0, "k"), (4, 1, "l")], "list int, n int, input string")
    assert sorted((r.list, r.n) for r in op.newly_asked(asked, files, "n", "list").collect()) == [(1, 1), (1, 3), (2, 0), (4, 0), (4, 1)]
    ready = spark.createDataFrame([(1, True), (2, False), (4, False)], "list int, ready boolean")
    assert {(r.list, r.n): r.state for r in op.restored(asked, files, ready, "n").collect()} == {(1, 1): "queued", (1, 3): "queued", (2, 0): "queued", (4, 0): "needs_model", (4, 1): "queued"}
    assert [r.pos for r in op.matching(files.where("list = 1"), F.lit("  B "), "input").collect()] == [1]
    assert op.matching(files, F.lit(" ")).count() == 8 if "name" in files.columns else op.matching(files, F.lit(" "), "input").count() == 8
    assert [r.pos for r in op.newest_first(files.where("list = 1"), "pos").collect()] == [3, 2, 1, 0]
    assert op.zipped(files.where("list = 1"), files.where("list = 2").select("pos", F.col("input").alias("output"))).count() == 2


def test_routes_chunks_and_deltas(spark):
    rows = spark.createDataFrame([("GET", "/health"), ("GET", "/jobs/7"), ("DELETE", "/jobs/7"), ("GET", "/jobs/7/x"), ("GET", "/jobs/x"), ("POST", "/jobs"), ("PUT", "/jobs"), ("GET", "/jobs"), ("POST", "/models"), ("GET", "/jobs/99999999999999999999")], "m string, p string")
    assert [r.x for r in rows.select(op.route("m", "p").alias("x")).collect()] == ["health", "view", "cancel", "unknown", "unknown", "submit", "unsupported", "list", "unknown", "unknown"]
    chunks = spark.createDataFrame([(1, t) for t in range(5)] + [(2, t) for t in range(3)], "job int, at int")
    assert sorted((r.job, r.at) for r in op.cancelled_after(chunks, spark.createDataFrame([(1, 2), (1, 4)], "job int, at int")).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    deltas = spark.createDataFrame([(1, 0, "he", False), (1, 1, "hello ", True), (1, 2, "w", False), (1, 3, "wor", False), (2, 0, "x", False), (2, 1, "y", True)], "job int, seq int, text string, stable boolean")
    assert {r.job: r.text for r in op.settled_deltas(deltas).collect()} == {1: "hello wor", 2: "y"}


def test_plans_of_outputs_sources_and_pipelines(spark, tmp_path):
    assert sources.plan_outputs(["a"], "x.srt", "/d") == ("x.srt", None) and sources.plan_outputs(["a"], "-", "/d") == ("-", None)
    assert sources.plan_outputs(["a", "b"], None, "/d") == (None, "/d") and sources.plan_outputs(["a", "b"], "/o.d/out", "/d") == (None, "/o.d/out")
    for output, is_file in (("-", False), ("out.SRT", False), ("plain", True)):
        with pytest.raises(ValueError, match="2"):
            sources.plan_outputs(["a", "b"], output, "/d", is_file)
    (tmp_path / "words.txt").write_text("  one\n two\n")
    assert sources.source("vocabulary")(spark, str(tmp_path / "words.txt")).first().vocabulary == "  one\n two\n"
    found = sources.identified(sources.list_files(spark, str(tmp_path))).first()
    assert found.key.split("|")[1] == "11" and found.key.split("|")[0].endswith("words.txt")
    with pytest.raises(KeyError, match="manifest"):
        sources.source("tape")
    made = []
    engines.route("double", lambda: made.append(1) or (lambda df: df.withColumn("x", F.col("x") * 2)))
    engines.route("negate", lambda: made.append(2) or (lambda df: df.withColumn("x", -F.col("x"))))
    rows = spark.createDataFrame([("double", 2), ("negate", 3)], "kind string, x int")
    assert sorted(r.x for r in engines.dispatched(rows, ["double", "negate"]).collect()) == [-3, 4] and made == [1, 2]
    with pytest.raises(KeyError):
        engines.pipeline_of("none")
