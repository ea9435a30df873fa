import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scriba.llm import quality
from tests.llm.test_minhash import brute as components
from tests.llm.test_mixing import brute as mixed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lo", "ne", "ka") for c in ("", "n", "du", "vi")]
    long = lambda n: [rng.choice(words) + rng.choice(("", "s", "t")) for _ in range(n)]
    bench = [(k, " ".join(long(30))) for k in range(5)]
    docs, labels = [], []
    for k in range(400):
        w = long(rng.randrange(30, 90))
        kind = rng.random()
        if kind < 0.15:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.25:
            w[3] = "vile"
        elif kind < 0.35 and docs:
            w = rng.choice(docs)[1].split(" ")
            if rng.random() < 0.5:
                w = [*w[:5], "edit", *w[6:]]
        elif kind < 0.42:
            w[10:10] = rng.choice(bench)[1].split(" ")
        docs.append((k * 2, " ".join(w), rng.choice(("xx", "yy")), rng.choices(("s0", "s1", "s2"), (8, 1, 1))[0], 0))
        if k % 2 == 0:
            text = docs[-1][1]
            labels.append((k * 2, int("!!" not in text), int("vile" in text)))
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in docs] + [(9001, "", "xx", "s1", 0), (9003, None, None, None, None)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs, bench


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_each_stage_equals_brute_force_on_what_the_one_before_kept(spark, folder, tmp_path):
    at, all_docs, bench = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["reject", "deduplicate", "decontaminate", "mix", "shard"]

    def run(name, docs):
        out = stages[name](spark, docs, at)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = run("reject", docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.assess_documents(docs, spark.read.parquet(f"{at}/labels.parquet")).where("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    texts = {r[0]: r[1] or "" for r in all_docs}
    clean = {i for i, t in texts.items() if t and "!!" not in t and "vile" not in t}
    assert len(good & clean) > 0.97 * len(clean) and len(good - clean) <= 4

    unique = run("deduplicate", kept)
    root = components([(r.doc_id, r.text) for r in kept.collect()])
    assert unique.columns == docs.columns
    assert key(unique.collect()) == key(r for r in kept.collect() if root[r.doc_id][1] == r.doc_id)

    pure = run("decontaminate", unique)
    items = [" ".join(re.findall(r"\w+", t.lower())) for _, t in bench]
    assert key(pure.collect()) == key(r for r in unique.collect() if not any(t in " ".join(re.findall(r"\w+", (r.text or "").lower())) for t in items))

    rows = run("mix", pure)
    want = Counter()
    plan = {}
    for i, n, *_, taken in mixed([(r.doc_id, r.source, r.text) for r in pure.collect()]):
        plan[i] = taken // n if n else None
    for r in rows.collect():
        want[r.doc_id] += 1
    assert rows.columns == docs.columns
    assert all(want[i] == n for i, n in plan.items() if n is not None)

    placed = run("shard", rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in placed.collect():
        size[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert sum(size.values()) == sum(len((r.text or "").encode()) + 1 for r in rows.collect())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.25 * sum(size.values()) / 8


def test_run_is_the_stages_in_turn(spark, folder, tmp_path):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, at)
    assert key(r[0:1] + r[5:7] for r in map(tuple, got.collect())) == key((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_empty_documents(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "xx", "s1", 0), (9001, "", "xx", "s1", 0), (9005, "one two", None, "s1", 7), (9006, "word " * 200_000, "xx", None, 1)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "1 as _id", "2 as doc", "3 as _key", "4 as u", "5 as kept", "map(1, 2) as m", "6 as _p", "7 as source_size", "8 as below", "9 as `range`", "10 as p_doc", "11 as `a.b`", "12 as c0", "13 as `p`")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns + (["shard", "slot"] if name == "shard" else [])
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = docs.collect()
    assert len(rows) > 20 and all((r._id, r.doc, r._key, r.u, r.kept, r.m, r._p, r.source_size, r.below, r["range"], r.p_doc, r["a.b"], r.c0, r.p) == (1, 2, 3, 4, 5, {1: 2}, 6, 7, 8, 9, 10, 11, 12, 13) for r in rows)
