from scriba.operators import store


def names(spark, requests, taken=()):
    df = spark.createDataFrame([("/o", k, s, t, "srt") for k, (s, t) in enumerate(requests)], "dir string, seq int, source string, stem string, ext string")
    known = spark.createDataFrame([("/o", p, o) for p, o in taken], "dir string, path string, owner string")
    return [(r.path, r.serial) for r in store.output_names(df, known).orderBy("seq").collect()]


def test_output_names(spark):
    assert names(spark, [("a", "t"), ("b", "t"), ("a", "t"), ("c", "u")]) == [("/o/t.srt", None), ("/o/t (2).srt", 2), ("/o/t.srt", None), ("/o/u.srt", None)]
    assert names(spark, [("a", "t"), ("b", "t")], [("/o/t.srt", "a"), ("/o/t (2).srt", None)]) == [("/o/t.srt", None), ("/o/t (3).srt", 3)]
    full = [("/o/t.srt", "x"), *((f"/o/t ({n}).srt", None) for n in range(2, 1000))]
    assert names(spark, [("a", "t")], full) == [("/o/t.srt", 1000)]
    assert names(spark, [("a", "t")], [("/o/t (7).srt", "a")]) == [("/o/t (7).srt", 7)]


def test_names_that_differ_in_their_numbers(spark):
    assert names(spark, [("a", "t"), ("b", "t (2)"), ("c", "t"), ("d", "t (2)"), ("c", "u")]) == [("/o/t.srt", None), ("/o/t (2).srt", None), ("/o/t (3).srt", 3), ("/o/t (2) (2).srt", 2), ("/o/t (3).srt", None)]


def test_names_without_a_most_are_all_their_own(spark, tmp_path):
    from scriba.plans import all_queries

    full = [("/o/t.srt", "x"), *((f"/o/t ({n}).srt", None) for n in range(2, 1000))]
    df = spark.createDataFrame([("/o", k, s, "t", "srt") for k, s in enumerate("abc")], "dir string, seq int, source string, stem string, ext string")
    known = spark.createDataFrame([("/o", p, o) for p, o in full], "dir string, path string, owner string")
    got = store.output_names(df, known, most=None).orderBy("seq").collect()
    assert [(r.path, r.serial) for r in got] == [(f"/o/t ({n}).srt", n) for n in (1000, 1001, 1002)]
    spark.range(1100).selectExpr("id * 7 as o_orderkey", "0L as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    rows = all_queries.QUERIES["output_naming"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.serial for r in rows] == [None, *range(2, 1101)] and len({r.path for r in rows}) == 1100


def test_cache_resume_and_history(spark):
    requests = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3")], "id int, key string")
    hits, misses = store.cache_split(requests, spark.createDataFrame([("k1", 1, "t"), ("k2", 9, "t")], "key string, version int, text string"))
    assert [r.id for r in hits.collect()] == [1] and sorted(r.id for r in misses.collect()) == [2, 3]
    spans = spark.createDataFrame([("r", "s1"), ("r", "s2")], "run string, span string")
    log = spark.createDataFrame([("r", "s1", 0, "old"), ("r", "s1", 5, "new"), ("q", "s2", 1, "other")], "run string, span string, seq int, text string")
    assert sorted((r.span, r.stored, r.reused) for r in store.resume(spans, log, "run", "span").collect()) == [("s1", "new", True), ("s2", None, False)]
    batch = spark.createDataFrame([("r", "s1", 9, "x"), ("r", "s3", 1, "a"), ("r", "s3", 2, "b")], "run string, span string, seq int, text string")
    assert [(r.span, r.text) for r in store.new_records(batch, log, "run", "span").collect()] == [("s3", "a")]
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("c", 0, "w")], "input string, at int, output string")
    assert [(r.input, r.output) for r in store.history(rows, "input", "at", n=2).collect()] == [("a", "z"), ("b", "y")]
    left, changed = store.forget(rows, "input", ["a"])
    assert left.count() == 2 and changed.first().changed is True


def test_records_and_what_is_left(spark):
    rows = spark.createDataFrame([("s1", "o1", 1), ("s2", "o2", 1)], "source string, output string, at int")
    changed = store.upserted(rows, spark.createDataFrame([("s2", "o3", 0), ("s4", "o1", 0), ("s2", "o9", 2)], rows.schema), "source", "at")
    assert sorted((r.source, r.output) for r in changed.collect()) == [("s1", "o1"), ("s2", "o9"), ("s4", "o1")]
    asked = spark.createDataFrame([("o1",), ("o7",)], "output string")
    assert sorted((r.output, r.source) for r in store.source_of(changed, asked).collect()) == [("o1", "s1"), ("o7", None)]
    there = spark.createDataFrame([("o2",)], "path string")
    assert [r.source for r in store.existing(rows, there).collect()] == ["s2"]
    parsed = spark.createDataFrame([("o1", ["a"]), ("o2", None)], "output string, segments array<string>")
    assert [(r.source, r.segments) for r in store.readable(rows, parsed).collect()] == [("s1", ["a"])]


def test_planned_outputs_are_those_of_one_batch(spark):
    from scriba.sources.files import TRANSCRIPT_EXTENSIONS, plan_outputs

    cases = [(n, o, f) for n in (1, 2) for o in (None, "-", "a.srt", "d/b.TXT", ".txt", "dir", "v1.2", "x/y.z/") for f in (False, True)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, inputs int, output string, output_is_file boolean")
    got = {r.k: (r.path, r.folder, r.error) for r in store.planned_outputs(rows, "out", TRANSCRIPT_EXTENSIONS).collect()}
    for k, (n, output, is_file) in enumerate(cases):
        try:
            want = (*plan_outputs(["i"] * n, output, "out", is_file), None)
        except ValueError as e:
            want = (None, None, str(e))
        assert got[k] == want, cases[k]
