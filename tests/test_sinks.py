from pyspark.sql import functions as F

from scriba.operators import jobs
from scriba.sources import sinks
from scriba.sources.scripted import scripted_events


def test_rendered_files_and_lines(spark, tmp_path):
    docs = spark.createDataFrame([("a.srt", "1\né"), ("b.txt", None)], "name string, content string")
    assert sorted(tuple(r) for r in sinks.write_rendered(docs, str(tmp_path / "out")).collect()) == [("a.srt", 4), ("b.txt", 0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.srt", "b.txt"] and (tmp_path / "out/a.srt").read_text() == "1\né"
    sinks.write_lines(docs.select(F.col("name").alias("line")), str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a.srt", "b.txt"]


def test_log_takes_a_span_once_and_tables_are_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("r", "s1", 1, "a"), ("r", "s1", 2, "b"), ("r", "s2", 3, "c")], "run string, span string, seq int, text string")
    for _ in range(2):
        sinks.append_log(batch, path, "run", "span", number=0)
    more = spark.createDataFrame([("r", "s2", 9, "late"), ("r", "s3", 1, "d")], batch.schema)
    for _ in range(2):
        sinks.append_log(more, path, "run", "span", number=1)
    log = sinks.read_log(spark, path, batch.schema)
    assert sorted(r.text for r in log.collect()) == ["a", "c", "d"]
    table = str(tmp_path / "table")
    assert sinks.current_table(spark, table, batch.schema).count() == 0
    sinks.replace_table(log, table)
    for n in range(3):
        sinks.replace_table(sinks.current_table(spark, table, batch.schema).where(f"span <> 's{n}'"), table)
    assert [r.text for r in sinks.current_table(spark, table, batch.schema).collect()] == ["d"]
    assert len(list((tmp_path / "table").glob("v-*"))) == 2
    assert sinks.forget_log(spark, path) and not sinks.forget_log(spark, path) and sinks.read_log(spark, path, batch.schema).count() == 0


def test_autosave_records_what_is_written(spark, tmp_path):
    done = spark.createDataFrame([("a.srt", "1", "in/a", "out/a.srt", "e", 5), ("b.srt", "2", "in/b", "out/b.srt", "e", 7)], "name string, content string, input string, output string, engine string, finished_at_ms long")
    folder, history = str(tmp_path / "out"), str(tmp_path / "history")
    sinks.autosave(done, folder, history)
    sinks.autosave(done.where("name = 'a.srt'").withColumn("finished_at_ms", F.lit(9).cast("long")), folder, history, keep=2)
    rows = sinks.current_table(spark, history, "input string, output string, engine string, finished_at_ms long").collect()
    assert sorted((r.input, r.finished_at_ms) for r in rows) == [("in/a", 9), ("in/b", 7)] and len(list((tmp_path / "out").iterdir())) >= 2


def test_scripted_job_runs_through(spark):
    events = scripted_events(spark, 2)
    assert jobs.sequence_violations(events).count() == 0
    assert {tuple(r) for r in jobs.outcomes(events).collect()} == {(1, "done", 12), (2, "done", 12)}
    assert {r.fraction for r in jobs.counters(events).collect()} == {1.0}


def test_passing_tables_go_and_kept_ones_stay(spark):
    import os

    from scriba.scratch import materialise, passing

    def there(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file://"))

    before = materialise(spark.range(3), "before")
    with passing(spark, "result"):
        part = materialise(before.selectExpr("id + 1 as id"), "part")
        with passing(spark, "inner"):
            inner = materialise(part, "inner")
        result = materialise(inner.union(part), "result")
        files = {n: x.inputFiles()[0].removeprefix("file://") for n, x in (("part", part), ("inner", inner))}
        assert all(map(os.path.exists, files.values()))
    assert there(before) and there(result) and not any(map(os.path.exists, files.values()))
    assert sorted(r.id for r in result.collect()) == [1, 1, 2, 2, 3, 3]
    try:
        with passing(spark):
            lost = materialise(spark.range(2), "lost").inputFiles()[0].removeprefix("file://")
            raise KeyError
    except KeyError:
        assert not os.path.exists(lost)
