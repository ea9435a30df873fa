import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriba.llm import minhash
from scriba.llm.common import shingle_hashes


def brute(docs):
    """Components over all pairs of exact shingle sets."""
    sets = []
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, rng, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[k] = rng.choice(vocabulary)
        elif kind < 0.8 and len(out) > 6:
            del out[k]
        else:
            out.insert(k, rng.choice(vocabulary))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chained_near_copies_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for size in (40, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts = [base]
        for _ in range(60):  # copies of copies, so that components hold links that no pivot has
            texts.append(edited(rng.choice(texts), rng, vocabulary, rng.randrange(1, max(2, size // 12))))
        docs += [" ".join(t) for t in texts]
    docs += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]) for _ in range(60)]
    rng.shuffle(docs)
    docs = [(k * 3, t) for k, t in enumerate(docs)]
    n = len(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == n
    assert got == brute(docs)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "One two", "d"), (5, "one  TWO", "e"), (6, "x y z " * 30_000, "f"), (7, "x y z " * 30_000, "g"), (7, "x y z " * 30_000, "h"), (None, "one two", "i"), (None, None, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 4, False), ("6", 3, 6, True), ("7", 3, 6, False), ("7", 3, 6, False), ("None", 1, 4, True), ("None", 0, None, True)])
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "6", "None", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_link_their_texts(spark):
    rng = random.Random(9)
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (9, " ".join([*b, "y"])), (4, "other words " * 9), (4, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "map(1, 2) as m", "2 as kept").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (4, 4, True)}
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r.doc_id, r.text) for r in left.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(4, ""), (5, " ".join(a))]


def test_signature_equals_ranks_of_each_elements_permutation():
    items = shingle_hashes(b" ".join(b"w%d" % k for k in range(40)))
    sig = minhash.superminhash(items, 63)
    each = np.array([minhash.superminhash(items[k : k + 1], 63) for k in range(len(items))])
    assert (sig == each.min(axis=0)).all()  # early stopping loses no minimum
    assert all(sorted((row >> np.uint64(32)).tolist()) == list(range(63)) for row in each)  # ranks are a permutation


def test_signature_estimates_similarity():
    rng = random.Random(3)
    a = [f"a{k}" for k in range(400)]
    errors = []
    for cut in (40, 100, 200):
        b = a[: 400 - cut] + [f"b{cut}{k}" for k in range(cut)]
        x, y = (shingle_hashes(" ".join(t).encode()) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append(abs((minhash.superminhash(x, 256) == minhash.superminhash(y, 256)).mean() - true))
    assert max(errors) < 0.12 and rng
