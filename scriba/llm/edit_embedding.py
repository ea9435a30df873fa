"""Document fingerprints by randomised edit embedding.

A walk reads a text from its start: at step ``j`` on character ``c`` it goes on by one
or stays, as a random bit that all documents share for ``(j, c)`` says. Two texts that
differ by a few edits soon walk in step again, so their edit distance shows as a small
Hamming distance between what the walks saw (Chakraborty, Goldenberg and Koucky, 2016).

A fingerprint samples 64 steps, half of each of two independent walks, and keeps 8 bits
of what the walk sees there (the next four characters). The step a slot samples is the
minimum of a random function over all steps of a text of that length, so texts of about
the same length sample the same steps, whatever the length is.

Groups: two near fingerprints share a bucket of a band of sampled slots; those of a
bucket are compared as wholes, in large buckets over a sample and smaller buckets of one
slot more, and not at all where they are in one group already; connected components group
them. No near pair is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import U, _stream, connected_components, few_tasks, materialise, mix

WALKS, SLOTS = 2, 64
BANDS, ROWS = 16, 4
#: Fingerprints from this likeness on are near.
LIKE = 0.75
#: Nodes of a bucket that one task compares with each other.
BLOCK = 512
#: Nodes of a larger bucket that say what is usual in it.
SAMPLE = 24
#: Texts walk together until so many are left; from then on, one by one.
FEW = 24
#: Characters of documents that walk together.
AT_ONCE = 4_000_000
_TABLE = 4096


def _steps(n: int) -> int:
    """Steps of a walk over ``n`` characters: twice as many, and a margin for slow walks."""
    return 2 * n + 4 * isqrt(n) if n else 0


class _Walk:
    """The shared randomness of one walk."""

    def __init__(self, seed: int):
        bits = (_stream(seed, _TABLE * 256) >> np.uint64(63)).astype(np.int32).reshape(_TABLE, 256)
        bits[:, 0] = 0  # the end of a text
        self.bits, self.rows = bits, [r.astype(np.uint8).tobytes() for r in bits]
        self.order = (_stream(seed + 1, 1 << 16) % np.uint64(_TABLE)).astype(np.int64).tolist()
        self.random = [np.random.Generator(np.random.PCG64(seed * 1000 + s)) for s in range(SLOTS // WALKS)]
        self.low = [1.0] * (SLOTS // WALKS)
        self.records = [[] for _ in self.low]

    def sampled(self, steps: np.ndarray) -> np.ndarray:
        """For each slot and number of steps: the step with the least random value among the first so many."""
        out = np.zeros((len(self.records), len(steps)), dtype=np.int64)
        most = int(steps.max(initial=0))
        for s, (r, records) in enumerate(zip(self.random, self.records, strict=True)):
            while not records or records[-1] <= most:
                # the gap to the next smaller value is geometric; that value is uniform below the last
                gap = int(r.geometric(self.low[s])) if records else 0
                self.low[s] = max(self.low[s] * r.random(), 1e-15)
                records.append(records[-1] + gap if records else 0)
            known = np.array(records)
            out[s] = known[np.maximum(np.searchsorted(known, steps) - 1, 0)]
        return out


_walks: list[_Walk] = []


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of 64 bytes for each text."""
    if not _walks:
        _walks.extend(_Walk(71 + 10 * w) for w in range(WALKS))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    by = np.argsort(-size, kind="stable")
    steps = np.array([_steps(int(size[i])) for i in by], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size[by] + 4)))
    seen = np.zeros(start[-1], dtype=np.uint8)
    for i, at in zip(by.tolist(), start[:-1].tolist(), strict=True):
        code = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen[at : at + len(code)] = 1 + (code ^ (code >> 8)) % 255
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    per = SLOTS // WALKS
    for w, walk in enumerate(_walks):
        at = _positions(walk, seen, start[:-1], steps)
        near = sum(seen[at + q].astype(np.uint32) * np.uint32(m) for q, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)))
        near = (near ^ (near >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[by, w * per : (w + 1) * per] = (near >> np.uint32(24)).astype(np.uint8).T
    return out


def _positions(walk: _Walk, seen: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Where each text's walk stands at each slot's step. Texts come longest first, so those that still walk are the first ones."""
    sampled = walk.sampled(steps)
    slot, text = np.divmod(np.arange(sampled.size), max(1, len(start)))
    by = np.argsort(sampled.ravel(), kind="stable")
    when, slot, text = sampled.ravel()[by], slot[by], text[by]
    stop, first = np.unique(when, return_index=True)
    first = np.append(first, len(when))
    at = start.astype(np.int32 if len(seen) < 1 << 31 else np.int64)
    out = np.zeros(sampled.shape, dtype=np.int64)
    order, bits, rows = walk.order, walk.bits, walk.rows
    j, k = 0, 0
    see, go = np.empty(len(at), dtype=np.uint8), np.empty(len(at), dtype=np.int32)
    for k in range(len(stop)):
        active = int(np.searchsorted(-steps, -int(stop[k]), side="left"))
        if active <= FEW and stop[k] > 0:
            break
        a, s, g = at[:active], see[:active], go[:active]
        for j in range(j, int(stop[k])):  # noqa: B020
            seen.take(a, out=s, mode="clip")
            bits[order[j & 0xFFFF]].take(s, out=g, mode="clip")
            a += g
        j = int(stop[k])
        x = slice(first[k], first[k + 1])
        out[slot[x], text[x]] = at[text[x]]
    else:
        return out
    rest = {}
    for x in range(first[k], len(when)):
        rest.setdefault(int(text[x]), []).append((int(when[x]), int(slot[x])))
    raw = memoryview(seen)
    for t, wanted in rest.items():
        p, i = int(at[t]), j
        for end, s in wanted:
            while i < end:
                p += rows[order[i & 0xFFFF]][raw[p]]
                i += 1
            out[s, t] = p
    return out


def _like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _compare(docs: list[tuple[int | None, str]], nexts: list[str]) -> dict:
    """Columns of _ROW for documents and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), n in zip(docs, nexts, strict=True)]
    texts = list(dict.fromkeys([*(t for _, t in docs), *nexts, *edited]))
    at = {t: i for i, t in enumerate(texts)}
    f = fingerprints(texts)
    own, other, after = (f[[at[t] for t in x]] for x in ([t for _, t in docs], edited, nexts))
    return {
        "doc_id": [i for i, _ in docs], "n_chars": [len(t) for _, t in docs], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [x.tobytes().hex() for x in own], "edited_fingerprint": [x.tobytes().hex() for x in other], "near_edited": _like(own, other), "near_next": _like(own, after),
    }


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in _NAMES[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = _SCHEMA.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document of a sorted partition with the one after it; its first and last are given out whole."""
    part = TaskContext.get().partitionId()
    held: list[tuple[int | None, str]] = []
    size, first = 0, True

    def edge(kind: str) -> pa.RecordBatch:
        i, t = held[0] if kind == "head" else held[-1]
        row = {x: None for x in _EDGES.names} | {"doc_id": i, "part": part, "edge": kind, "text": t}
        return pa.RecordBatch.from_pylist([row], schema=_EDGES)

    def done() -> pa.RecordBatch:
        n = len(held) - 1
        out = _compare(held[:-1], [t for _, t in held[1:]])
        return pa.RecordBatch.from_pydict(out | {"part": [part] * n, "edge": [None] * n, "text": [None] * n}, schema=_EDGES)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((i, t or ""))
            size += len(t or "")
            if first:
                yield edge("head")
                first = False
            if size > AT_ONCE and len(held) > 1:
                yield done()
                held = held[-1:]
                size = len(held[0][1])
    if len(held) > 1:
        yield done()
    if held:
        yield edge("tail")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pydict(_compare([(r["doc_id"], r["text"]) for r in rows], [r["after"] for r in rows]), schema=_SCHEMA)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, and its likeness to an edited text and to the next document's.

    The edited text's last half is the start of the next document in ascending doc_id;
    after the last comes the first. Null ids come first; rows that repeat an id come in
    the order of a hash of their texts. Texts are read whole, however long. A null text counts as empty; empty texts are like each other
    and unlike others. One row for each row; other columns are ignored; an empty table
    gives an empty result.

    One range shuffle brings each document next to the one that follows it; only the
    first and last document of each partition meet in a join.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    out = materialise(dealt.mapInArrow(_in_order, f"{_ROW}, part int, edge string, text string"), "fingerprints")
    heads = out.where("edge = 'head'").select("part", F.col("text").alias("after"))
    order = Window.orderBy("part")  # one row for each partition
    turn = heads.select("part").withColumn("lowest", F.min("part").over(Window.partitionBy(F.lit(0)))).withColumn("to", F.coalesce(F.lead("part").over(order), "lowest"))
    tails = out.where("edge = 'tail'").select("doc_id", "text", "part").join(turn.select("part", "to"), "part")
    last = tails.join(heads.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "after").mapInArrow(_across, _ROW)
    return out.where("edge is null").select(*_NAMES).unionByName(last)


#: Slots in a fixed random order.
_ORDER = np.random.Generator(np.random.PCG64(5)).permutation(SLOTS)
#: Two near fingerprints agree in one of any so many slots.
FIRST = int((1 - LIKE) * SLOTS) + 1


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of fingerprints, of which two near ones share one or more.

    A band is four slots of a fixed random order. Near fingerprints differ in 16 slots
    at most: either not in every band, or once in each; then they share three slots of
    the first band, so that has a key for each choice of three.
    """
    order = _ORDER[: BANDS * ROWS].reshape(BANDS, ROWS)
    kept = [np.delete(order[0], j) for j in range(ROWS)] + list(order[1:])
    for batch in batches:
        f = np.array([np.frombuffer(bytes.fromhex(x), dtype=np.uint8) for x in batch.column(0).to_pylist()]).reshape(-1, SLOTS)
        key = [(f[:, x].astype(np.int64) << np.array([0, 8, 16, 24])[: len(x)]).sum(axis=1) + (b << 32) for b, x in enumerate(kept)]
        yield pa.RecordBatch.from_arrays([pa.array(list(np.stack(key, axis=1)), pa.list_(pa.int64()))] + [batch.column(1)], ["bands", "node"])


def _flood(f: np.ndarray) -> list[tuple[int, int]]:
    """``(row, root)`` of what is reachable over near rows; reached rows are not compared again."""
    out, left = [], np.arange(len(f))
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = _like(f[left], f[queue.pop()]) >= LIKE
            found, left = left[near].tolist(), left[~near]
            queue += found
            out += [(x, root) for x in found]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what near fingerprints of a bucket connect; ``bucket, node, print`` come sorted by bucket."""

    def linked(bucket: np.ndarray, node: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, dtype=np.int64)
        size = np.diff(start)
        two = start[:-1][size == 2]
        two = two[_like(f[two], f[two + 1]) >= LIKE]
        src, dst = [node[two + 1]], [node[two]]
        for at, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = np.array(_flood(f[at : at + n]), dtype=np.int64).reshape(-1, 2) + at
            src.append(node[found[:, 0]])
            dst.append(node[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (src, dst)], ["src", "dst"])

    held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, SLOTS), dtype=np.uint8))
    for batch in batches:
        if batch.num_rows:
            held = tuple(np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2))), strict=True))
            cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
            yield linked(*(x[:cut] for x in held))
            held = tuple(x[cut:] for x in held)
    yield linked(*held)


_PIVOTS = "bucket long, nodes array<long>, prints binary, classes array<long>, labels array<long>, pivot_print binary, usual binary, often binary"


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's sample: its nodes and prints, what of it is connected, the print with most of what is usual, and what is usual in each slot and how often."""
    for batch in batches:
        nodes, prints, classes, labels, pivot, usual, often = [], [], [], [], [], [], []
        for x in batch.column(1).to_pylist():
            f = np.frombuffer(b"".join(r["print"] for r in x), dtype=np.uint8).reshape(-1, SLOTS)
            n = (f[:, None, :] == f[None, :, :]).sum(axis=1)
            top, best = n.argmax(axis=0), int(n.sum(axis=1).argmax())
            label = np.array([r["label"] for r in x])
            near = ((f[:, None, :] == f[None, :, :]).mean(axis=2) >= LIKE) | (label[:, None] == label[None, :])
            own = label
            while True:  # the least label that is reached
                low = np.where(near, own[None, :], own.max()).min(axis=1)
                if (low == own).all():
                    break
                own = low
            # the pivot comes first
            order = [best, *(k for k in range(len(f)) if k != best)]
            nodes.append([x[k]["node"] for k in order])
            prints.append(f[order].tobytes())
            classes.append(own[order].tolist())
            labels.append(label[order].tolist())
            pivot.append(f[best].tobytes())
            usual.append(f[top, np.arange(SLOTS)].tobytes())
            often.append(n.max(axis=0).astype(np.uint8).tobytes())
        longs = (pa.array(x, pa.list_(pa.int64())) for x in (nodes, classes, labels))
        nodes, classes, labels = longs
        yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(prints, pa.binary()), classes, labels, *(pa.array(x, pa.binary()) for x in (pivot, usual, often))], [x.split()[0] for x in _PIVOTS.split(", ")])


_HELD = "bucket long, node long, label long, print binary, pivot_print binary, usual binary, often binary, near array<long>"


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, node, label, print, pivot_print, usual, often, nodes, prints, classes, labels`` with ``near``, the nodes of the bucket's sample that are near, in place of the sample.

    The new label says what is known to be connected in this bucket: nodes that are near
    connected ones of the sample, or have their label, have one.
    """
    for batch in batches:
        near, label = [], []
        for node, was, own, nodes, prints, classes, labels in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 7, 8, 9, 10)), strict=True):
            f = np.frombuffer(prints, dtype=np.uint8).reshape(-1, SLOTS)
            found = np.flatnonzero(_like(f, np.frombuffer(own, dtype=np.uint8)) >= LIKE).tolist()
            near.append([nodes[k] for k in found if nodes[k] != node])
            label.append(min([classes[k] for k in found] + [c for c, x in zip(classes, labels, strict=True) if x == was] or [was]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(label, pa.int64()), *batch.columns[3:7], pa.array(near, pa.list_(pa.int64()))], [x.split()[0] for x in _HELD.split(", ")])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, node, label`` for the smaller buckets of each node ``bucket, node, label, print, pivot_print, usual, often``.

    A node's smaller buckets are 17 slots in which it differs from the pivot, with what
    it has there, the least usual first. Of two near nodes that aren't both near the
    pivot, one has ``n > 16`` such slots; they agree in ``n - 16`` of them or more, and
    so in one that is among the first 17 of both. That holds for any pivot and any order.
    """
    for batch in batches:
        bucket, node, label = (batch.column(k).to_numpy() for k in range(3))
        f, g, usual, often = (_bytes(batch.column(k)) for k in range(3, 7))
        differs = f != g
        rank = np.where(differs, np.where(f == usual, often.astype(np.int32), 0), 1 << 16)
        first = np.argsort(rank, axis=1, kind="stable")[:, :FIRST]
        row, k = np.nonzero(np.take_along_axis(differs, first, axis=1))
        slot = first[row, k]
        with np.errstate(over="ignore"):
            key = mix(mix(bucket[row].view(U)) + (slot << 8 | f[row, slot].astype(np.int64)).astype(U)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node[row]), pa.array(label[row])], ["bucket", "node", "label"])


_LINK = "src long, dst long"


def _labelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, label)`` after more links: each node with the smallest that it reaches."""
    known = labels.where("label <> node").select(F.col("node").alias("src"), F.col("label").alias("dst"))
    roots = connected_components(known.unionByName(links))
    return materialise(labels.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")


def _linked(rows: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after what near fingerprints connect in the buckets of ``rows (bucket, node, label)``.

    Buckets whose nodes have one label connect nothing more. The others are compared as
    wholes; one of more than BLOCK nodes is first held against a sample of its own. Its
    nodes then fall into smaller buckets by what they differ from one of that sample in,
    and those that are left with several labels are dealt with in the same way. A smaller
    bucket's members agree in one slot more; where they agree in 48 they are all near,
    so this ends. In a round labels are those of a bucket, by its sample; what all links
    connect is found once, at the end. Later rounds have few rows, and so few tasks.
    """
    links = []
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        sizes = materialise(few_tasks(sizes.select("bucket", "n"), rows.count()), "sizes")
        small, large = F.col("n") <= BLOCK, F.col("n") > BLOCK
        n = sizes.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(small, F.col("n")), F.when(large, F.col("n")), F.when(large, SAMPLE)))).first()
        if n[0]:
            few = few_tasks(rows.join(sizes.where(small).select("bucket"), "bucket", "left_semi"), n[0])
            few = few_tasks(few.join(known, "node").select("bucket", "node", "print"), n[0])
            links.append(few_tasks(few.repartition("bucket"), n[0]).sortWithinPartitions("bucket").mapInArrow(_links, _LINK))
        if not n[1]:
            return _labelled(labels, reduce(DataFrame.unionByName, links)) if links else labels
        many = few_tasks(rows.join(sizes.where(large).select("bucket"), "bucket", "left_semi"), n[1])
        many = materialise(few_tasks(many.join(known, "node"), n[1]), "many")
        sample = F.array(*(F.min_by(F.struct("node", "print", "label"), F.xxhash64("node", F.lit(k))) for k in range(SAMPLE)))
        sample = many.groupBy("bucket").agg(F.sort_array(F.array_distinct(sample)).alias("sample"))
        pivots = materialise(few_tasks(sample, n[2]).mapInArrow(_pivots, _PIVOTS), "pivots")
        many = many.join(pivots, "bucket").select("bucket", "node", "label", "print", "pivot_print", "usual", "often", "nodes", "prints", "classes", "labels")
        many = materialise(few_tasks(many, n[1]).mapInArrow(_near_pivots, _HELD), "held")
        links.append(many.select(F.col("node").alias("src"), F.explode("near").alias("dst")))
        rows = materialise(many.drop("near").mapInArrow(_refine, "bucket long, node long, label long"), "refined")


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """``prints (doc_id, fingerprint, ...)`` with ``class_id``: the smallest id reachable over near fingerprints.

    Equal fingerprints are one node, whatever ids they have; rows that reach no id have a
    null class. Rows that repeat an id with another fingerprint are apart: each has the
    class of its own, and the id links nothing. Other columns pass through. An empty
    table gives an empty result. The buckets of one band come first; of the other bands,
    only those that hold more than one class of these are looked at. No pair is left out,
    and no task holds more than a block.
    """
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "prints")
    known = nodes.select("node", F.unhex("fingerprint").alias("print"))
    labels = nodes.select("node", F.col("node").alias("label"))
    bands = materialise(nodes.select("fingerprint", "node").mapInArrow(_bands, "bands array<long>, node long"), "bands")
    first = bands.select(F.col("bands")[ROWS].alias("bucket"), "node", F.col("node").alias("label"))
    labels = _linked(first, known, labels)
    others = bands.join(labels, "node").select("node", "label", F.explode(F.array_remove("bands", F.col("bands")[ROWS])).alias("bucket"))
    labels = nodes.join(_linked(materialise(others, "others"), known, labels), "node")
    least = labels.groupBy("label").agg(F.min("first").alias("class_id"))
    classes = labels.join(least, "label").select("fingerprint", "class_id")
    return prints.join(classes, "fingerprint", "left").select(*prints.columns, "class_id")
