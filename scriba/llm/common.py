"""What the corpus operators share: word hashes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriba.scratch import materialise, passing, scratch_dir  # noqa: F401

# --------------------------------------------------------------------------
# words and hashes inside a task
# --------------------------------------------------------------------------

U = np.uint64
MASK64 = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    """``n`` random uint64 from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(GOLDEN) + U(seed))


_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 17
_BYTE = _stream(11, 256)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for positions 0 to n."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _BLOCK + 1)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, b, dtype=U)
            table[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(table))
        _powers[:] = out
    return _powers[0], _powers[1]


def _hash_block(buf: np.ndarray) -> np.ndarray:
    word = ~_SPACE[buf]
    step = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    edge = np.flatnonzero(step)
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=U)
    up, down = _power_tables(len(buf))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, in order.

    Long texts are read in blocks that end between words, so that the working arrays
    stay small whatever the length of the text.
    """
    buf = np.frombuffer(text, dtype=np.uint8)
    if len(buf) <= _BLOCK:
        return _hash_block(buf)
    out, at = [], 0
    while at < len(buf):
        end = min(at + _BLOCK, len(buf))
        while end < len(buf):
            gap = np.flatnonzero(_SPACE[buf[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(end + _BLOCK, len(buf))
        out.append(_hash_block(buf[at:end]))
        at = end
    return np.concatenate(out)


_ORDER = _stream(23, 64) | U(1)


def shingle_hashes(text: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle of all its words."""
    if not text:
        return np.empty(0, dtype=U)
    w = word_hashes(text.lower())  # bytes.lower() changes A-Z alone
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        if n < k:
            s = np.array([(w * _ORDER[:n]).sum(dtype=U) + U(n)], dtype=U)
        else:
            s = np.zeros(n - k + 1, dtype=U)
            for j in range(k):
                s += w[j : n - k + 1 + j] * _ORDER[j]
        s = mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0``, ``c1`` and so on, as readers of schemas don't take any name; ``toDF(*df.columns)`` gives them back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Rows of an intermediate table that are worth a task.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as its stage's ``rows`` are worth, where a shuffle gives twice as many or more; nothing is shuffled or left out.

    A task of no rows still costs its start, twice where it runs Python, and its place in
    the driver. The number grows with the rows, from one for each core to half of what a
    shuffle gives; beyond that, the shuffle's own tasks stay.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.coalesce(n) if 2 * n <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------

_EDGES_AT_ONCE = 1_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of at most a million edges: emits each node with its root in that block."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        out = pa.RecordBatch.from_pydict({"src": pa.array(nodes, pa.int64()), "dst": pa.array([find(x) for x in nodes], pa.int64())})
        parent.clear()
        return out

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= _EDGES_AT_ONCE:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (src, dst)`` that isn't the smallest of its component.

    Each task first joins its own edges by union-find. Then rounds of large-star and
    small-star (Kiveris et al., 2014) link every node to the smallest one it can
    reach; the number of rounds grows with the logarithm of the size of a component.
    Minima are partial aggregates, so a node with very many edges is no hot spot.
    Self-loops and repeated edges are harmless. No edge reaches the driver.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    e = materialise(e.mapInArrow(_local_forest, "src long, dst long").distinct(), "forest")
    while True:
        n = 2 * e.count()
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"))
        large = few_tasks(both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst"), n).distinct()
        large = few_tasks(large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), n)
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("x")).select("x.*").where("src <> dst")
        e = materialise(few_tasks(few_tasks(small, n).distinct(), n), "stars")
        # done when no node has two links up, or one up and one down
        ends = e.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if few_tasks(open_, n).isEmpty():
            return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
