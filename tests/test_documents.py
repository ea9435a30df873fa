import os
import random

import pytest
from pyspark.sql import functions as F

from scriba.functions import tables
from scriba.operators import subtitles
from scriba.operators.punctuation import align
from scriba.sources import documents, files

SCHEMA = "file_id string, seg_id int, start_ms long, end_ms long, text string"


def some_segments(n=30):
    rng = random.Random(n)
    return [(f"f{k}", i, i * 1000, i * 1000 + 700, rng.choice(["", " ", "one", "two\nlines", "drei", "\nfirst"])) for k in range(n) for i in range(rng.randrange(1, 60))]


def read(folder):
    return {x.name: x.read_text() for x in folder.iterdir() if x.is_file() and not x.name.startswith(".")}


def test_files_are_what_the_renderers_give(spark, tmp_path):
    segments = spark.createDataFrame(some_segments(), SCHEMA).repartition(7)
    documents.write_subtitles(segments, f"file://{tmp_path}/srt")
    documents.write_transcripts(segments, f"file://{tmp_path}/txt")
    assert read(tmp_path / "srt") == {f"{r.file_id}.srt": r.srt for r in subtitles.to_srt(segments).collect()}
    assert read(tmp_path / "txt") == {f"{r.file_id}.txt": r.txt for r in subtitles.to_text(segments).collect()}
    assert not [x for x in os.listdir(tmp_path / "srt") if x.startswith("_")]


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    documents.register(spark)
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, body string").repartition(3)
    late = rows.withColumn("body", F.when(F.col("name") == "c", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        late.write.format("srt").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    for wrong, why in (([("a", "1"), ("b", "2"), ("a", "3")], "one after the other"), ([("x/y", "1")], "no file name"), ([(None, "1")], "no file name")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame(wrong, "name string, body string").coalesce(1).write.format("srt").mode("append").save(str(tmp_path))
        assert list(tmp_path.iterdir()) == []
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, body string").repartitionByRange(2, "body")
    with pytest.raises(Exception, match="more than one task"):
        twice.write.format("srt").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_append_keeps_and_overwrite_removes_others(spark, tmp_path):
    documents.register(spark)
    write = lambda rows, mode: spark.createDataFrame(rows, "name string, body string").write.format("srt").mode(mode).save(str(tmp_path))
    write([("a", "1"), ("b", "2")], "append")
    (tmp_path / "note.txt").write_text("kept")
    write([("b", "3")], "append")
    assert read(tmp_path) == {"a.srt": "1", "b.srt": "3", "note.txt": "kept"}
    write([("c", "4")], "overwrite")
    assert read(tmp_path) == {"c.srt": "4", "note.txt": "kept"}


def test_lines_of_a_file_in_several_ranges(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("long.txt", "short.txt", "empty.txt", "blank.txt", "open.txt"):
        n = {"long.txt": 5000, "empty.txt": 0, "blank.txt": 1}.get(name, 40)
        lines = ["".join(rng.choice("abc \r\té") for _ in range(rng.randrange(0, 40))) for _ in range(n)] if name != "blank.txt" else [""]
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"" if name in ("open.txt", "empty.txt") else b"\n"))
        if name == "open.txt":
            lines[-1:] = [lines[-1]] if lines[-1] else []
        want |= {(name, i): x for i, x in enumerate(lines, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, str(tmp_path))
        tasks = rows.where(F.col("file").endswith("long.txt")).select(F.spark_partition_id()).distinct().count()
        got = {(os.path.basename(r.file), r.line): r.value for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and tasks > 10


def test_table_functions_in_sql(spark):
    tables.register(spark)
    doc = "WEBVTT header\n\n7\n00:00:01.000 --> 00:00:02,500 align:start\nfirst\n \n3\nnonsense --> 00:00:01,000\nlost\n\n00:00:03,000 --> 00:00:04,000\r\nsecond\r\nline\n\n9\n00:00:05,000 --> 00:00:06,000\n\n"
    rng = random.Random(2)
    pieces = ["00:00:01,000 --> 00:00:02,000", "1:2:3 --> 4:5:6.7 x", "\n", "\n\n", " \n", "text", "　wide　", "-->", "00:00:01,5-->00:00:02", "\r\n", "99999999999999999999:0:0 --> 1:0:0", " \n"]
    docs = [(k, "".join(rng.choice(pieces) + rng.choice(["\n", "\n", ""]) for _ in range(rng.randrange(0, 14)))) for k in range(300)] + [(900, doc), (901, None), (902, "")]
    rows = spark.createDataFrame(docs, "k int, doc string")
    rows.createOrReplaceTempView("subtitle_documents")
    got = spark.sql("SELECT k, seg_id, start_ms, end_ms, text FROM subtitle_documents, LATERAL parse_srt(doc)")
    want = subtitles.parse_srt(rows, "doc", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    pairs = [("abc", "axcd"), ("", "x"), (None, None), ("same", "same")]
    spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").createOrReplaceTempView("text_pairs")
    got = spark.sql("SELECT k, step, ref_pos, hyp_pos FROM text_pairs, LATERAL align_chars(a, b) ORDER BY k, step").collect()
    assert [tuple(r) for r in got] == [(k, n, i, j) for k, (a, b) in enumerate(pairs) for n, (i, j) in enumerate(align(a or "", b or ""))]
