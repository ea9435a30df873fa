import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriba.llm import edit_embedding as op

LETTERS = "abcdefghijklmnopqrstuvwxyz "


def text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def naive(t):
    """The fingerprint of one text by walking each walk step by step."""
    if not op._walks:
        op.fingerprints(["x"])
    out = []
    code = [1 + (ord(c) ^ (ord(c) >> 8)) % 255 for c in t] + [0] * 8
    for walk in op._walks:
        steps = op._steps(len(t))
        wanted = walk.sampled(np.array([steps]))[:, 0].tolist()
        at, places = 0, {}
        for j in range(max(wanted) + 1):
            places[j] = at
            at += int(walk.bits[walk.order[j & 0xFFFF]][code[at]])
        for w in wanted:
            near = sum(code[places[w] + q] * m for q, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))) & 0xFFFFFFFF
            near = (near ^ (near >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
            out.append(near >> 24)
    return bytes(out)


def test_walking_together_equals_walking_alone():
    rng = random.Random(5)
    texts = ["", "a", "ab", *(text(rng, rng.randrange(3, 400)) for _ in range(60)), text(rng, 5000), "é漢字" * 40]
    got = op.fingerprints(texts)
    for t, f in zip(texts, got, strict=True):
        assert f.tobytes() == naive(t)


def test_likeness_falls_with_edit_distance():
    rng = random.Random(7)
    means = []
    for edits in (0, 3, 30, 300):
        likes = []
        for _ in range(12):
            a = text(rng, 2000)
            b = list(a)
            for _ in range(edits):
                k = rng.randrange(len(b))
                if rng.random() < 0.4:
                    b[k] = rng.choice(LETTERS)
                elif rng.random() < 0.5:
                    del b[k]
                else:
                    b.insert(k, rng.choice(LETTERS))
            x, y = op.fingerprints([a, "".join(b)])
            likes.append((x == y).mean())
        means.append(np.mean(likes))
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3]
    assert means[1] > 0.8 and means[3] < 0.35


def test_rows_equal_brute_force(spark):
    rng = random.Random(9)
    docs = [(k * 7 % 101, text(rng, rng.randrange(0, 300))) for k in range(101)] + [(200, None), (201, ""), (None, "nobody"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).repartition(5)
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = op.fingerprints([t, edited, after])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    got = [tuple(r) for r in op.neighbour_fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op.neighbour_fingerprints(df.limit(0)).count() == 0


def test_classes(spark):
    rng = random.Random(2)
    base = [text(rng, 900) for _ in range(4)]
    docs = [(10 * b + k, t if k == 0 else t[:450] + "x" * k + t[450:]) for b, t in enumerate(base) for k in range(5)]
    prints = op.neighbour_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in op.fingerprint_classes(prints).collect()}
    assert len({got[10 * b] for b in range(4)}) == 4
    assert sum(got[10 * b + k] == 10 * b for b in range(4) for k in range(5)) >= 15


def test_ids_that_repeat_with_another_text_have_a_row_and_a_class_each(spark):
    rng = random.Random(4)
    a, b = text(rng, 900), text(rng, 900)
    near = b[:450] + "x" + b[450:]
    docs = [(1, a), (8, a), (8, b), (9, near), (None, near + "y"), (None, text(rng, 900)), (10, "long " * 100_000)]
    prints = op.neighbour_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    got = op.fingerprint_classes(prints).select("doc_id", "n_chars", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 900, 1), (8, 900, 1), (8, 900, 8), (9, 901, 8), (None, 902, 8), (None, 900, None), (10, 500_000, 10)], key=str)


def classes(f):
    """The smallest id reachable over near rows, by all pairs."""
    near = (f[:, None, :] == f[None, :, :]).mean(axis=2) >= op.LIKE
    label = np.arange(len(f))
    while (low := np.where(near, label[None, :], len(f)).min(axis=1)).tolist() != label.tolist():
        label = low
    return label.tolist()


@pytest.mark.parametrize("block", [512, 6])
def test_classes_equal_all_pairs_on_chained_copies_in_hot_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block, raising=False)
    rng = np.random.default_rng(6)
    order = np.random.Generator(np.random.PCG64(5)).permutation(op.SLOTS)
    rows = []
    for k in range(40):
        f = rng.integers(0, 256, op.SLOTS)
        f[order[:40]] = np.where(rng.random(40) < 0.9, 7, f[order[:40]])  # a passage at the sampled steps
        rows.append(f)
        for _ in range(k % 6):  # copies of copies
            f = f.copy()
            where = rng.choice(op.SLOTS, int(rng.integers(10, 20)), replace=False)
            f[where] = rng.integers(0, 256, len(where))
            rows.append(f)
    one = rng.integers(0, 256, op.SLOTS)
    other = one.copy()
    other[order.reshape(op.BANDS, op.ROWS)[:, 2]] += 1  # near, and another value in every band
    rows = np.array([*rows, one, other])[rng.permutation(len(rows) + 2)].astype(np.uint8)
    prints = spark.createDataFrame([(i, f.tobytes().hex()) for i, f in enumerate(rows)], "doc_id long, fingerprint string").repartition(5)
    got = {r.doc_id: r.class_id for r in op.fingerprint_classes(prints).collect()}
    want = classes(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert 20 < len(set(want)) < len(rows) - 20


def test_first_slots_lead_near_nodes_to_each_other():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 3, op.SLOTS).astype(np.uint8)
    for _ in range(300):
        x = np.where(rng.random(op.SLOTS) < rng.random(), rng.integers(0, 3, op.SLOTS), p).astype(np.uint8)
        y = x.copy()
        y[rng.choice(op.SLOTS, int(rng.integers(1, 17)), replace=False)] = 9
        f = [x.tobytes(), y.tobytes()]
        usual, often = (rng.integers(0, 3, op.SLOTS).astype(np.uint8) for _ in range(2))
        batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([1, 2]), pa.array([1, 2]), pa.array(f), *(pa.array([u.tobytes()] * 2) for u in (p, usual, often))], ["bucket", "node", "label", "print", "pivot_print", "usual", "often"])
        out = [r for b in op._refine(iter([batch])) for r in b.to_pylist()]
        both_near = (x == p).mean() >= op.LIKE and (y == p).mean() >= op.LIKE
        buckets = [{r["bucket"] for r in out if r["node"] == k} for k in (1, 2)]
        assert both_near or buckets[0] & buckets[1]
