"""Small intermediate tables take few tasks, however many a shuffle gives; the driver plans and tracks no more of them."""

import random
import uuid

import pytest

from scriba.llm import common, edit_embedding, minhash


@pytest.fixture
def many(spark):
    """A session that deals shuffles out to 64 tasks and puts none of them together."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "64")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return own


def rows_and_tasks(spark, made):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        rows = sorted(map(tuple, made().collect()))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    ran = [i for i in map(tracker.getStageInfo, stages) if i is not None and i.numCompletedTasks]
    return rows, sum(i.numCompletedTasks for i in ran), len(ran)


def test_components(many):
    rng = random.Random(2)
    edges = [(k, rng.randrange(max(k // 50 * 50, k - 3), k)) for k in range(400) if k % 50]
    rows, tasks, stages = rows_and_tasks(many, lambda: common.connected_components(many.createDataFrame(edges, "src long, dst long")))
    assert rows == [(k, k // 50 * 50) for k in range(400) if k % 50] and tasks < 22 * stages


def test_near_duplicates(many):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijkl") * 3 for _ in range(30)) for _ in range(12)]
    docs = [(k, texts[k % 12] + (" x" if k % 5 == 0 else "")) for k in range(120)]
    rows, tasks, stages = rows_and_tasks(many, lambda: minhash.near_duplicates(many.createDataFrame(docs, "doc_id long, text string")))
    assert [r[2] for r in rows] == [k % 12 for k in range(120)] and tasks < 12 * stages


def test_classes(many, monkeypatch):
    monkeypatch.setattr(edit_embedding, "BLOCK", 8)
    rng = random.Random(4)
    base = bytes(rng.randrange(256) for _ in range(64))
    prints = [(k, bytes(b if i >= k % 20 else (b + k) % 256 for i, b in enumerate(base)).hex()) for k in range(200)]
    rows, tasks, stages = rows_and_tasks(many, lambda: edit_embedding.fingerprint_classes(many.createDataFrame(prints, "doc_id long, fingerprint string")))
    assert len(rows) == 200 and tasks < 17 * stages
