import hashlib
import random
import re
from collections import defaultdict

import pytest

from scriba.llm import mixing as op


def brute(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in docs]
    total = defaultdict(int)
    for (_, s, _), n in zip(docs, size, strict=True):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, budget = {}, set(names), 1.5 * sum(total.values())
    while left:  # share, stop those above, share again
        share = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * share > 2 * total[s]]
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
            left.discard(s)
        if not over:
            target |= {s: weight[s] * share for s in left}
            break
    u = [int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, _, _ in docs]
    out = []
    for (i, s, _), n, h in zip(docs, size, u, strict=True):
        whole = int(target[s] // total[s]) if total[s] else 0
        upto = sum(m for (_, t, _), m, g in zip(docs, size, u, strict=True) if t == s and g <= h)
        out.append((i, n, total[s], round(target[s], 6), n * (whole + (upto <= target[s] - whole * total[s]))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "é", "Z", None]
    docs = [(k, rng.choices(sources, [60, 5, 5, 10, 10, 10])[0], " ".join("w" for _ in range(rng.randrange(0, 40)))) for k in range(250)]
    docs += [(7, "a", "again and again"), (None, "b", "x y"), (900, "b", None), (901, "empty", "")]
    got = op.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)).collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=str) == sorted(brute(docs), key=str)


def test_mix_is_near_its_targets_and_repeats_rows(spark):
    rng = random.Random(11)
    docs = [(k, f"s{min(k % 7, 3)}", " ".join(["w"] * rng.randrange(1, 30)), k) for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, u int").selectExpr("*", "1 as _s", "2 as _whole", "3 as _below", "4 as doc", "5 as below", "6 as _time")
    rows = op.mix(df).collect()
    source = {d[0]: d[1] for d in docs}
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    mixed = op.repeated(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == taken


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op.mix(empty).count() == 0 and op.repeated(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert sorted(tuple(r) for r in op.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
