import random

import numpy as np
from pyspark.sql import functions as F

from scriba.llm import quality as op


def corpus(rng, n):
    words = [f"{a}{b}" for a in ("ta", "re", "mi", "so") for b in ("lo", "ne", "ka", "du", "vi", "po")]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(words) + rng.choice(("", "s", "n")) for _ in range(rng.randrange(20, 80))]
        kind = rng.random()
        if kind < 0.2:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.35:
            w[rng.randrange(len(w))] = rng.choice(("vile", "scum"))
        docs.append((k, " ".join(w), f"s{k % 4}", "xx"))
        if k % 2 == 0:
            labels.append((k, int(kind >= 0.2), int(0.2 <= kind < 0.35)))
    return docs, labels


def test_rejects_bad_and_toxic_documents_and_keeps_clean_ones(spark):
    rng = random.Random(5)
    docs, labels = corpus(rng, 1200)
    df, y = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in op.assess_documents(df, y).collect()}
    assert len(got) == len(docs)
    fit = {i for i, _, _ in labels}
    clean = {i for i, t, _, _ in docs if "!!" not in t and "vile" not in t and "scum" not in t}
    held = [i for i in got if i not in fit]
    assert np.mean([got[i] for i in held if i in clean]) > 0.97
    assert np.mean([got[i] for i in held if i not in clean]) < 0.05
    more = df.selectExpr("*", "doc_id as keep", "doc_id as score", "doc_id as p_host", "1 as good", "2 as toxic", "3 as quality", "doc_id as _score", "4 as _p_doc", "5 as _host", "6 as _p", "7 as host", "8 as doc", "9 as s_0")
    kept = op.keep_good(more, y)
    assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert all(r.doc_id == r.keep == r.score == r.p_host == r._score for r in kept.collect())


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(("a", "b", None)), rng.choice(("x", "y")), rng.choice((0.1, 0.9, 0.5))) for _ in range(300)] + [("rare", "z", 0.01)]
    df = spark.createDataFrame(rows, "host string, path string, p_doc double")
    sums, all_, strengths = op.site_sums(df, ["host", "path"])
    got = {(r.host, r.path): (r.p_0, r.p_1) for r in sums.select("host", "path", *(p.alias(f"p_{k}") for k, p in enumerate(op.posteriors(all_, strengths)))).collect()}
    share = sum(p for _, _, p in rows) / len(rows)
    above, found, learned = {(): share}, {}, []
    for k in (1, 2):
        sums_of = {}
        for h, p, v in rows:
            s = sums_of.setdefault((h, p)[:k], [0.0, 0])
            s[0] += v
            s[1] += 1
        spread = np.mean([(s / n - share) ** 2 for s, n in sums_of.values()]) - np.mean([share * (1 - share) / n for _, n in sums_of.values()])
        learned.append(min(max(share * (1 - share) / max(spread, 1e-9) - 1, op.STRENGTH[0]), op.STRENGTH[1]))
        above |= {key: (s + learned[-1] * above[key[: k - 1]]) / (n + learned[-1]) for key, (s, n) in sums_of.items()}
        found |= sums_of
    assert set(got) == {(h, p) for h, p, _ in rows} and np.isclose(all_, share)
    for (h, p), v in got.items():
        assert np.allclose(v, (above[(h,)], above[(h, p)]))
    assert got[("rare", "z")][1] > 0.1  # one document says little

    # a document's own evidence is left out of its site
    alone = op.posteriors(all_, strengths, op._units(F.col("p_doc")))
    joined = df.withColumnRenamed("host", "h").join(sums.withColumnRenamed("path", "p"), F.col("h").eqNullSafe(F.col("host")) & (F.col("path") == F.col("p")))
    for r in joined.select("h", "path", "p_doc", alone[0].alias("a"), alone[1].alias("b")).collect():
        (s, n), (t, m) = found[(r.h,)], found[(r.h, r.path)]
        one = (s - r.p_doc + learned[0] * share) / (n - 1 + learned[0])
        assert np.allclose((r.a, r.b), (one, (t - r.p_doc + learned[1] * one) / (m - 1 + learned[1])))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", "xx"), (2, "a b", "s", "xx"), (None, "a b", "s", None), (3, "a " * 400_000, "s", "xx")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op.assess_documents(docs.withColumn("p_doc", docs.doc_id), none).collect()
    assert len(got) == 5 and all(r.keep for r in got)
    some = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert op.assess_documents(docs, some).count() == 5
    assert op.assess_documents(docs.limit(0), some).count() == 0


def test_regression_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * (1, 5, 0.1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(float)
    m = op._regression(x, y)
    z = np.column_stack([np.ones(400), (x - m["mean"]) / m["scale"]])

    def loss(w):
        return np.logaddexp(0, z @ w).sum() - y @ (z @ w) + w @ w / 2

    least = loss(m["w"])
    assert all(loss(m["w"] + step) >= least for step in rng.normal(size=(300, 4)) * 0.05)


def test_labels_of_repeated_ids_are_the_worst_of_each(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} text {'bad' if k % 2 else 'fine'} " * 5, "s", "xx") for k in range(60)], "doc_id long, text string, source string, lang string")
    once = [(k, int(k % 2 == 0), 0) for k in range(60)]
    twice = [*once, *((k, 1, 0) for k in range(1, 60, 2)), *((k, q, None) for k, q, _ in once)]
    a, b = (op.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n)) for x, n in ((once, 1), (twice, 7)))
    assert abs(a["w"] - b["w"]).max() < 1e-9
