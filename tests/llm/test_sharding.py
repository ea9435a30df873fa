import random
import zlib
from collections import defaultdict

import numpy as np

from scriba.llm import sharding as op


def placed(df):
    return op.shard(df).collect()


def check(rows, docs):
    assert len(rows) == len(docs)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_bytes_are_near_equal_and_groups_stay_together(spark):
    rng = random.Random(3)
    docs = [(k, "large " * 70, 5) for k in range(5000, 5080)] + [(k, "x" * rng.randrange(0, 400) + str(k // 2), 5) for k in range(3000)] + [(9000, None, 5), (9001, "", 5), (None, "nobody", 5), (None, None, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot int").repartition(5)
    rows = placed(df)
    size = check(rows, docs)
    assert set(size) == set(range(8)) and max(size.values()) < 1.03 * sum(size.values()) / 8
    groups = defaultdict(set)
    for r in rows:
        groups[r.text].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    again = placed(df.repartition(3))
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_a_group_of_a_third_is_subdivided(spark):
    docs = [(k, "same text " * 20 if k % 3 == 0 else f"own text {k} " * 15) for k in range(3000)]
    size = check(placed(spark.createDataFrame(docs, "doc_id long, text string")), docs)
    assert max(size.values()) < 1.05 * sum(size.values()) / 8 and min(size.values()) > 0.95 * sum(size.values()) / 8


def test_rows_of_one_text_and_no_id_are_divided(spark):
    docs = [(None, "same text")] * 4000 + [(k, f"own {k:06d}") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _key", "2 as _range", "3 as _number", "4 as _start", "5 as key").repartition(3)
    out = op.shard(df)
    assert out.columns == [*df.columns, "size", "text_crc32", "shard", "slot"] and {r._range for r in out.collect()} == {2}
    size = check(out.collect(), docs)
    assert set(size) == set(range(8)) and max(size.values()) < 1.05 * sum(size.values()) / 8 and min(size.values()) > 0.95 * sum(size.values()) / 8


def test_ranges_that_fit_into_no_shard_are_left_to_be_split():
    size = np.array([300, 10, 10, 90, 10, 10, 80, 10])
    heavy = size > 50
    place = op.packed(size, heavy, 4)
    assert place.tolist()[0] == -1 and sorted(place[[3, 6]].tolist()) == [0, 1] and (place[1:] >= 0).all()
    rng = np.random.default_rng(4)
    size = rng.integers(1, 20, 4000)
    size[:40] = rng.integers(200, 900, 40)
    place = op.packed(size, size > 100, 8)
    load = np.bincount(place, size, 8)
    assert abs(load / load.mean() - 1).max() < 0.01


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.shard(empty).count() == 0
    assert check(placed(spark.createDataFrame([(1, "a")], "doc_id long, text string")), [0])
    check(placed(spark.createDataFrame([(1, "a")] * 500, "doc_id long, text string")), [0] * 500)
    check(placed(spark.createDataFrame([(1, "a" * 2_000_000), (2, "b")], "doc_id long, text string")), [0] * 2)
