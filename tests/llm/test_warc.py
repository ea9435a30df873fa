import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from scriba.llm import warc as op
from scriba.scratch import scratch_dir


def test_round_trip_and_revisits(spark):
    rng = random.Random(4)
    rows = [(k, f"http://h{k % 5}.example/p{k % 9}#x", "".join(rng.choice("abc <>é") for _ in range(rng.randrange(0, 400)))) for k in range(300)]
    same = "copied " * 40
    rows += [(k, None if k % 2 else "https://www.H1.example:443/p1", same) for k in (700, 650, 800)] + [(901, "u\r\nrl", None), (902, "x", ""), (903, "x", "short"), (904, "x", "short"), (None, "y", same), (905, "x", "big" * 700_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = op.archive(df.withColumn("payload", df.html)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [(by[i].record_type, by[i].refers_to) for i in (650, 700, 800, None)] == [("response", None), ("revisit", 650), ("revisit", 650), ("revisit", 650)]
    assert by[903].record_type == by[904].record_type == "response"
    order = sorted(got, key=lambda r: (r.url_key.encode(), (r.page_id or 0) % 4_000_000_000, -1 if r.page_id is None else r.page_id))
    assert [r.position for r in order] == list(range(len(rows)))
    assert by[700].url_key == "example,h1)/p1" and by[0].url_key == "example,h0)/p0"
    assert op.archive(df.limit(0)).count() == 0


def test_archives_read_with_any_gzip_reader_and_give_payloads(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>hello</p>"), (2, "http://b.example/", "x" * 200), (3, "http://b.example/", "x" * 200)], "page_id long, url string, html string")
    folder = f"{scratch_dir(spark)}/warc-test"
    runs = op.write_archives(op.captures_of(df), folder)
    files = runs.select("file").distinct()
    read = {r.page_id: r for r in op.read_archives(files, folder).collect()}
    assert read[1].payload == b"<p>hello</p>" and read[2].payload == b"x" * 200 and read[3].payload is None
    raw = b"".join(gzip.open(f"{folder}/{r.file}").read() for r in files.collect())
    assert raw.count(b"WARC/1.1\r\n") == 3 and b"WARC-Refers-To: <urn:page:2>" in raw


def test_each_file_is_a_task_and_ranges_grow_with_the_index(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE_RECORDS", 10)
    monkeypatch.setattr(op, "BROADCAST_DIGESTS", 0)
    rows = [(k, f"http://h{k % 7}.example/", "same text " * 20 if k % 3 else f"own {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{scratch_dir(spark)}/warc-files"
    runs = op.write_archives(op.captures_of(df).repartition(6), folder)
    n = runs.select("file").distinct().count()
    assert n == 6 and op.read_archives(runs, folder).select(F.spark_partition_id()).distinct().count() == 6
    assert op.merge_runs(runs).select("position").distinct().count() == 200
    assert sorted((r.page_id, r.refers_to) for r in op.archive(df).collect()) == [(k, 1 if k % 3 and k > 1 else None) for k in range(200)]


def test_loser_tree_merges_like_sorting():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(op.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_members_across_chunks(monkeypatch):
    monkeypatch.setattr(op, "_CHUNK", 7)
    parts = [gzip.compress(bytes([65 + k]) * (k * 31)) for k in range(6)]
    found = list(op.members(io.BytesIO(b"".join(parts))))
    assert [c for _, c in found] == [bytes([65 + k]) * (k * 31) for k in range(6)]
    assert [o for o, _ in found] == [sum(map(len, parts[:k])) for k in range(6)]
