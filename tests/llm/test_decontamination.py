import random
from itertools import combinations

import numpy as np
import pytest

from scriba.llm import decontamination as op


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    bench = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((6, 12, 25, 40))))) for k in range(30)]
    docs, want = [], set()
    for d in range(150):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        if d % 5 == 0:
            i, t = rng.choice(bench)
            t = [x.upper() + "," if rng.random() < 0.3 else x for x in t.split()]
            if len(t) >= 25:
                for k in range(6, len(t), 9):  # a substitution every nine words
                    t[k] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
            want.add((d, i))
        docs.append((d, " ".join(w)))
    return bench, docs, want


def test_finds_planted_passages_and_nothing_else(spark, planted):
    bench, docs, want = planted
    got = op.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_blocks_of_items_change_nothing(spark, planted, monkeypatch):
    bench, docs, want = planted
    monkeypatch.setattr(op, "SEEDS_AT_ONCE", 500)
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.find_leaks(df, items).collect()} == want
    assert {r.doc_id for r in op.decontaminate(df, items).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_agreement_is_the_best_stretch():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 20))], dtype=np.uint64)
        doc = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 30))], dtype=np.uint64)
        at = rng.randrange(-len(item) + 1, len(doc))
        lo, hi = max(0, -at), min(len(item), len(doc) - at)
        same = [bool(item[q] == doc[at + q]) for q in range(lo, hi)]
        best = max((sum(1 if x else -3 for x in same[a:b]) for a in range(len(same) + 1) for b in range(a, len(same) + 1)), default=0)
        start, length, matched = op.agreement(item, doc, at)
        assert matched - 3 * (length - matched) == best and lo <= start <= start + length <= hi


def test_edges(spark):
    bench = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "too short"), (None, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (6, " , ")]
    docs = [(1, None, 0), (2, "", 0), (3, "x Alpha, beta (gamma) DELTA epsilon-zeta y", 0), (3, "x alpha beta gamma delta epsilon zeta y", 0), (4, "too short", 0), (None, "alpha beta gamma delta epsilon zeta", 0), (6, "pad " * 300_000 + "alpha beta gamma delta epsilon zeta", 0)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string")
    got = op.find_leaks(df, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("3", 1), ("3", 1), ("3", 5), ("3", 5), ("4", 4), ("6", 1), ("6", 5), ("None", 1), ("None", 5)]
    assert {r.doc_token for r in got if r.doc_id == 6} == {300_000}
    left = op.decontaminate(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert op.find_leaks(df, items.limit(0)).count() == 0 and op.find_leaks(df.limit(0), items).count() == 0
    assert op.decontaminate(df, items.limit(0)).count() == len(docs)


def test_masks_miss_no_leak():
    """All places of all substitutions that a leak may have: the longest stretches with so many contain these."""
    for n, wrong in (*((n, n // 4) for n in range(op.LEAST, op.LENGTH)), (13, 3), (16, 4), (20, 5), (24, 6)):
        masks = op.MASKS if n >= op.LENGTH else op.MASKS + op.SHORT
        left = np.array([(1 << n) - 1 - sum(1 << k for k in c) for c in combinations(range(n), wrong)])
        for m in masks:
            for at in range(n - len(m) + 1):
                bits = int(m[::-1], 2) << at
                left = left[left & bits != bits]
        assert not len(left), (n, wrong)


def leaks(item, doc):
    need = min(op.LENGTH, len(item))
    for at in range(-len(item) + 1, len(doc)):
        same = [item[q] == doc[at + q] for q in range(max(0, -at), min(len(item), len(doc) - at))]
        if any(sum(same[a:b]) >= op.AGREE * (b - a) for a in range(len(same)) for b in range(a + need, len(same) + 1)):
            return True
    return False


def test_all_documents_against_all_items_equal_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    items = [[rng.choice(words) for _ in range(rng.choice((3, 5, 8, 13, 20, 40)))] for _ in range(14)]
    docs = []
    for _ in range(90):
        doc = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        part = list(rng.choice(items))
        for _ in range(rng.randrange(0, max(1, len(part) // 3))):
            part[rng.randrange(len(part))] = rng.choice(words)
        at = rng.randrange(len(doc) + 1)
        doc[at:at] = part[rng.randrange(3) :]
        docs.append(doc if rng.random() < 0.9 else list(rng.choice(items)))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if (leaks(item, doc) if len(item) >= op.LEAST else doc == item)}
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.find_leaks(df, bench).collect()} == want and len(want) > 50
    assert {r.doc_id for r in op.decontaminate(df, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_substitutions_equal_brute_force():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]

    seen = set()
    for n in range(5, 26):
        for wrong in range(n // 3 + 2):
            for _ in range(6):
                item = [rng.choice(words) for _ in range(n)]
                part = list(item)
                for k in rng.sample(range(n), wrong):
                    part[k] = "other"
                cut = rng.choice((0, 0, 1, 3))
                doc = [rng.choice(words) for _ in range(rng.randrange(4))] + part[cut:] + [rng.choice(words) for _ in range(rng.randrange(4))]
                got, want = op._Index([(7, 0, op.tokens(" ".join(item)))]).leaks(" ".join(doc)), leaks(item, doc)
                seen.add((n < op.LENGTH, want))
                assert bool(got) == want, (item, doc)
                for _, _, at, start, length, matched in got:
                    assert length >= min(op.LENGTH, n) and matched >= op.AGREE * length
                    assert matched == sum(item[start + q] == doc[at + q] for q in range(length))
    assert len(seen) == 4


def test_passages_of_the_review(spark):
    item13, item16 = [f"a{k}" for k in range(13)], [f"b{k}" for k in range(16)]
    docs = [(1, " ".join(["x", *item13[1:]])), (2, " ".join("x" if k in (3, 12) else w for k, w in enumerate(item16)))]
    got = op.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item13)), (2, " ".join(item16))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.length >= 13, r.agreement >= 0.75) for r in got} == {(1, 1, True, True), (2, 2, True, True)}


def test_repeated_tokens_and_long_items(spark, monkeypatch):
    item = "same " * 499 + "end"
    index = op._Index([(1, 0, op.tokens(item))])
    assert index.leaks("same " * 20_000) == [(1, 0, 0, 0, 499, 499)]
    assert index.leaks("same " * 900 + "end here")[0][2:] == (401, 0, 500, 500)
    monkeypatch.setattr(op, "HITS", 1000)
    assert index.leaks("same " * 900 + "end here")[0][2:] == (401, 0, 500, 500)
    monkeypatch.setattr(op, "PIECE", 100)
    monkeypatch.setattr(op, "SEEDS_AT_ONCE", 300)
    words = [f"w{k}" for k in range(450)]
    docs = [(k, " ".join(["x", "y", *words[k : k + 25], "z"])) for k in range(0, 420, 7)]
    got = op.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in docs} and {r.doc_id for r in got if r.matched == 25} == {i for i, _ in docs}
    assert all(r.item_part * 36 + r.item_token == r.doc_id for r in got if r.matched == 25)
