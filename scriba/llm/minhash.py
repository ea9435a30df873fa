"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct word shingles. Two documents are linked where
their sets' Jaccard similarity is 0.75 or more; a component is what links connect.

1. One pass hashes each whole text to its set and SuperMinHash signature (Ertl, 2017):
   every element draws a value for each slot from its own permutation of ranks, rank by
   rank, until no further rank could lower a slot. 21 bands of 3 slots miss a pair at
   0.75 with a probability of 1e-5, and less above.
2. Equal sets are one node. A bucket is what shares a band; in each one a pivot, the node
   with most neighbours over all its buckets, of these the one of the smallest doc_id, is
   held against all others, on full sets,
   so the number of pairs is that of the buckets' rows.
3. Nodes far from their pivot (under 0.5) are dealt with again in two more rounds, with
   several pivots. Links that no pivot has show otherwise. With ``D(x)`` the symmetric
   difference of ``x`` and its pivot, two linked nodes, of which one isn't linked to the
   pivot and one isn't far from it, share more than about half of ``D(y)``, and so an
   element of a short prefix of it. Two linked nodes that both remain far share an
   element of a quarter of their sets (prefix filtering). In both prefixes, what the
   pivot lacks comes first, as it is rarer. What follows the first shared element bounds
   how much the two share; pairs of which this isn't enough for a link don't leave the
   join. The few others are held against each other on full sets too. No bucket is
   expanded into all its pairs, and no link is lost.
4. Links go through union-find inside tasks, then star rounds between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import GOLDEN, MASK64, U, columns_of, connected_components, few_tasks, fresh, materialise, passing, mix, shingle_hashes, utf8

SHINGLE, BANDS, ROWS = 5, 21, 3
#: Pivots of a bucket in the rounds after the first, and the number of rounds.
PIVOTS, ROUNDS = 8, 3
#: A row that bears a text or sets counts as so many rows of numbers when tasks are dealt out.
HEAVY = 10
#: Ids of repeated or dropped documents up to so many reach all tasks.
BROADCAST_IDS = 500_000


def superminhash(items: np.ndarray, m: int) -> np.ndarray:
    """The signature of ``m`` slots of a set of distinct uint64; slot values are rank * 2**32 + a random 32-bit value."""
    sig = np.full(m, U(MASK64))
    n, perm = len(items), None
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(m if n else 0):
            u = mix(items + U((j + 1) * GOLDEN & MASK64))
            k = j + (((u & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
            if j == 0:
                slot = first = k
            else:
                if perm is None:
                    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (n, 1))
                    perm[rows, first], perm[:, 0] = 0, first
                here = perm[:, j].copy()
                slot = perm[rows, k]
                perm[rows, k], perm[:, j] = here, slot
            np.minimum.at(sig, slot, (u >> U(32)) | U(j << 32))
            if sig.max() < U((j + 1) << 32):
                break
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=U) * U(GOLDEN)
        for j in range(rows):
            key = mix(key + sig[j : bands * rows : rows])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, bands = [], [], []
        for text in utf8(batch.column(1)):
            s = shingle_hashes(text, SHINGLE)
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_keys(superminhash(s, BANDS * ROWS), BANDS, ROWS) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the rows whose set has the expected key (another text may bear the same doc_id)."""
    for batch in batches:
        ids, sets = [], []
        for i, text, key in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            s = shingle_hashes(text, SHINGLE)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key:
                ids.append(i)
                sets.append(s.view(np.int64))
            if len(ids) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])
                ids, sets = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])


_VERIFIED = "pivot long, node long, linked boolean, near boolean, prefix array<long>, differs array<long>, whole array<long>, size int, extra int, n int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hold each pair's full sets against each other.

    ``prefix``: the elements of D(node) of which any link to a node that isn't linked to
    the pivot must share one; what the pivot lacks comes first, as it is rarer.
    ``differs``: D(node), where the node isn't linked to the pivot. Nodes under 0.25 to
    the pivot cannot be linked to one at 0.5 or more (the Jaccard distance is a metric).
    """
    for batch in batches:
        linked, near, prefix, differs, whole, size, extra, n = [], [], [], [], [], [], [], []
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            a = left[i].values.to_numpy(zero_copy_only=False).view(U)
            b = right[i].values.to_numpy(zero_copy_only=False).view(U)
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            hit = a[at] == b
            common = int(hit.sum())
            union = len(a) + len(b) - common
            is_linked, is_near = 100 * common >= 75 * union, 2 * common >= union
            mine = np.ones(len(a), dtype=bool)
            mine[at[hit]] = False
            d = np.concatenate((b[~hit], a[mine])).view(np.int64)
            must = (7 * len(d) + len(a) - len(b)) // 14 + 1
            linked.append(is_linked)
            near.append(is_near)
            prefix.append(d[: max(0, len(d) - must + 1)] if is_near else None)
            differs.append(d if not is_linked and 4 * common >= union else None)
            whole.append(None if is_near else np.concatenate((b[~hit], b[hit])).view(np.int64)[: len(b) - -(-75 * len(b) // 100) + 1])
            size.append(len(b))
            extra.append(len(b) - common)
            n.append(len(d))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefix, differs, whole)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), *lists, pa.array(size, pa.int32()), pa.array(extra, pa.int32()), pa.array(n, pa.int32())], [x.split()[0] for x in _VERIFIED.split(", ")])


def _held(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verify ``pairs (pivot, node)`` against ``sets (node, items)``; both are written tables."""
    a = sets.select(F.col("node").alias("pivot"), F.col("items").alias("a"))
    b = sets.select("node", F.col("items").alias("b"))
    n = HEAVY * (pairs.count() + sets.count())  # the sets are dealt out by the same tasks, even if few pairs meet them
    both = few_tasks(few_tasks(pairs.join(a, "pivot"), n).join(b, "node"), n)
    return both.select("pivot", "node", "a", "b").mapInArrow(_verify, _VERIFIED)


def _sharing(x: DataFrame, y: DataFrame, enough: str) -> DataFrame:
    """Pairs of ``(pivot, node, size, extra, n, at, item)`` that share an item and may share enough.

    Both have what the pivot lacks first, ``extra`` of their ``n`` items. If the item at
    ``at`` is the first that they share, they share ``most`` at most.
    """
    rest = "least(x.n - x.extra, y.n - y.extra)"
    most = f"if(y.at < y.extra, least(x.extra - x.at, y.extra - y.at) + {rest}, least(x.n - x.at, y.n - y.at))"
    pairs = x.alias("x").join(y.alias("y"), F.expr(f"x.pivot = y.pivot and x.item = y.item and ({enough.replace('most', most)})"))
    return pairs.select(F.least("x.node", "y.node").alias("pivot"), F.greatest("x.node", "y.node").alias("node")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    A null or wordless text has no shingle, is linked with nothing and is kept. Rows
    that repeat a text fall into its component; rows that repeat a doc_id are one
    document, linked with whatever any of their texts is linked with. A null doc_id is a
    document of its own set only and its component is that of its set's smallest id, null
    if none that it reaches has one. Texts are read whole, however long. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    known = signed.where("set_key is not null and doc_id is not null")
    nodes = known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.min_by("bands", "doc_id").alias("bands"))
    nodes = materialise(few_tasks(nodes, HEAVY * signed.count()).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # texts of one id are linked
    twice = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    twice = known.join(twice, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(nodes.select("set_key", "node"), "set_key")
    one = twice.groupBy("doc_id").agg(F.min("node").alias("dst"))

    rows = nodes.select("node", "first", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(few_tasks(rows.join(full, "bucket"), BANDS * nodes.count()), "buckets")
    n = shared.count()
    mass = shared.groupBy("node").agg(F.sum("n").alias("mass"))
    pivots = few_tasks(shared.join(mass, "node"), n).groupBy("bucket").agg(F.max(F.struct("mass", (-F.col("first")).alias("minus"), "node")).alias("x"))
    pivots = materialise(few_tasks(pivots.select("bucket", F.col("x.node").alias("pivot")), n), "pivots")
    far = shared.select("bucket", "node")

    links, held, seek, sets = [twice.join(one, "doc_id").select(F.col("node").alias("src"), "dst")], [], [], None
    for k in range(ROUNDS):
        n = (PIVOTS if k else 1) * far.count()
        tests = few_tasks(far.join(pivots, "bucket").where("node <> pivot"), n)
        pairs = materialise(few_tasks(tests.select("pivot", "node").distinct(), n), "pairs")
        if sets is None:
            wanted = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct().join(nodes.select("node", "set_key", F.col("first").alias("doc_id")), "node")
            most = HEAVY * nodes.count()
            sets = few_tasks(docs.join(few_tasks(wanted, most), "doc_id"), most).select("node", "text", "set_key")
            sets = materialise(few_tasks(sets.mapInArrow(_sets, "node long, items array<long>").dropDuplicates(["node"]), most), "sets")
        now = materialise(_held(pairs, sets), "verified")
        links.append(now.where("linked").select(F.col("node").alias("src"), F.col("pivot").alias("dst")))
        held.append(now.where("near").select("pivot", "node", "size", "extra", "n", F.posexplode("prefix").alias("at", "item")))
        seek.append(now.where("differs is not null").select("pivot", "node", "size", "extra", "n", F.posexplode("differs").alias("at", "item")))
        # what is far from all pivots of its bucket is dealt with again, among itself
        seen = few_tasks(tests.join(now.select("pivot", "node", "near"), ["pivot", "node"]), n).groupBy("bucket", "node").agg(F.max("near").alias("near"))
        rest = few_tasks(seen.where("not near").select("bucket", "node").join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti"), n)
        if k + 1 == ROUNDS:
            # one pivot of each bucket gives the order of all that remains far in it
            first = pivots.groupBy("bucket").agg(F.min("pivot").alias("pivot"))
            whole = rest.join(first, "bucket").select("pivot", "node").distinct().join(now.where("whole is not null").select("pivot", "node", "whole", "size", "extra"), ["pivot", "node"])
            whole = few_tasks(whole, n).select("pivot", "node", "size", "extra", F.col("size").alias("n"), F.posexplode("whole").alias("at", "item"))
        else:
            alone = rest.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
            far = materialise(few_tasks(rest.join(alone, "bucket", "left_semi"), n), "far")
            order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
            pivots = far.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS).select("bucket", F.col("node").alias("pivot"))
            pivots = materialise(few_tasks(pivots, n), "pivots")

    x, y = (reduce(DataFrame.unionByName, rows) for rows in (seek, held))
    bridge = _sharing(x, y, "x.node <> y.node and 14 * most >= 7 * (x.n + y.n) - (x.size + y.size)")
    apart = _sharing(whole, whole, "x.node < y.node and 7 * most >= 3 * (x.size + y.size)")
    # each join is a job of its own, so that the driver plans and tracks one at a time
    bridge, apart = materialise(bridge, "bridge"), materialise(apart, "apart")
    pairs = materialise(few_tasks(bridge.unionByName(apart).distinct(), bridge.count() + apart.count()), "pairs")
    more = _held(pairs, sets).where("linked").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    roots = connected_components(reduce(DataFrame.unionByName, [*links, materialise(more, "more")]))
    n = nodes.count()
    labels = few_tasks(nodes.join(roots, "node", "left").select("set_key", "first", F.coalesce("root", "node").alias("root")), n)
    least = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = few_tasks(labels.join(least, "root").select("set_key", "component_id"), n)
    out = signed.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id.

    Where rows repeat that id, the one of the least text stays, of equal ones the one of
    the least hash of its columns. Rows of null id or without words stay, unless the id
    goes for another text. Columns may have any name and any nulls; they and their order
    are kept. An empty table stays empty. Texts are shuffled for ids that repeat, and once
    more where over BROADCAST_IDS ids repeat or go.
    """
    with passing(docs.sparkSession, "kept"):
        found = materialise(near_duplicates(docs, id_col, text_col).where("doc_id is not null").select("doc_id", "kept"), "kept")
    once = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept")
    own, stays = fresh(docs, "id"), fresh(docs, "stays")
    once = materialise(once.select(F.col("doc_id").alias(own), F.col("kept").alias(stays)), "once")
    # a short list reaches the documents where they are; they meet a longer one in one shuffle
    rows = docs.withColumn(own, F.col(id_col).cast("long")).join(F.broadcast(once) if once.count() <= BROADCAST_IDS else once, own, "left")
    alone = rows.where(F.col(stays).isNull()).select(*columns_of(docs))
    rows = rows.where(F.col(stays))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    least = rows.groupBy(own).agg(F.min_by(F.struct(*columns_of(docs)), F.struct(F.col(text_col).cast("string"), F.xxhash64(*plain))).alias(own + "_"))
    return alone.unionByName(least.select(f"{own}_.*"))


#: All pairs that share a shingle, and all documents that links reach: for small tables.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM w UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, min(r.root) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n
"""
