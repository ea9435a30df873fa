"""Benchmark decontamination by spaced seeds.

A seed mask reads some token positions and ignores others, so a window still matches
where an ignored token was replaced. The masks' hashes of all benchmark items are joined
with those of every position of every document; around each hit, the item and the
document are held against each other token by token, and a stretch that agrees but for
a few substitutions counts as a leak.

The seeds of the benchmark reach the tasks in blocks of a bounded size, and each block
meets all documents; one block is enough for two million seeds. Very long items are cut
into overlapping pieces. Documents aren't shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriba.llm.common import U, _stream, materialise, mix, plain_names, word_hashes

#: Masks over token positions; 1 is read, 0 is ignored. Wherever the substitutions of a
#: leak stand, one of the masks reads none of them, so no leak is without a hit: a stretch
#: of 13 or more tokens has a part of 13 to 25 that agrees as well as the whole.
MASKS = ("1111", "11101")
#: Items of under LENGTH tokens have less room and need these too.
SHORT = ("11011", "10111", "111001")
#: Items of fewer tokens say too little in a text; they leak where they are all of it.
LEAST = 5
#: A leak agrees over so many tokens, or over the whole of a shorter item, ...
LENGTH = 13
#: ... and in this share of them.
AGREE = 0.75
#: Seeds that tasks hold at once.
SEEDS_AT_ONCE = 4_000_000
#: Longer items come in pieces of so many tokens, which overlap by more than the parts of 25
#: tokens that every leak has, so that none falls between two pieces.
PIECE, OVERLAP = 1 << 14, 64
#: Hits of seeds that a task lays at once.
HITS = 1 << 21
#: Blocks of a benchmark that a task filters by in one pass.
BLOCKS_AT_ONCE = 4

_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_OTHER = re.compile(r"[ -©«-´¶-¹»-¿ -⁯　-〿]")
_WEIGHTS = _stream(37, 64) | U(1)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, without punctuation."""
    if not text:
        return np.empty(0, dtype=U)
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return word_hashes(text.encode("utf-8", "replace").translate(_PUNCTUATION))


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's tokens at every position where the mask fits."""
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    with np.errstate(over="ignore"):
        h = np.full(n, U(len(mask)))
        for j, c in enumerate(mask):
            if c == "1":
                h += t[j : j + n] * _WEIGHTS[j]
        return mix(h)


def agreement(item: np.ndarray, doc: np.ndarray, at: int, least: int = 0) -> tuple[int, int, int]:
    """``(start, length, matched)`` of the best stretch of ``least`` tokens or more of the item laid at position ``at`` of the document.

    The stretch maximises matches minus three times the mismatches: at that price one
    that holds a quarter of mismatches is worth nothing, so a stretch agrees in three
    quarters if and only if the best one does.
    """
    lo, hi = max(0, -at), min(len(item), len(doc) - at)
    same = item[lo:hi] == doc[at + lo : at + hi]
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1, -3))))
    if len(gain) <= least:
        return lo, 0, 0
    low = np.minimum.accumulate(gain[: len(gain) - least])
    last = int(np.argmax(gain[least:] - low))
    start, end = int(np.flatnonzero(gain[: last + 1] == low[last])[-1]), last + least
    return lo + start, end - start, int(same[start:end].sum())


_PIECES = "item_id long, part int, length int, tokens array<long>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as tokens; one of over PIECE tokens comes in pieces that overlap by OVERLAP."""
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = tokens(text).view(np.int64)
            for part, at in enumerate(range(0, max(1, len(t) - OVERLAP), PIECE - OVERLAP)):
                rows.append((i, part, len(t), t[at : at + PIECE]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["item_id", "part", "length", "tokens"])


class _Index:
    """The seeds of one block of items, or pieces of items, ``(item_id, part, tokens)``."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]]):
        self.ids, self.parts, self.tokens = [], [], []
        self.short: dict[bytes, list[int]] = {}
        found: dict[str, list] = {m: [] for m in MASKS + SHORT}
        for i, part, t in items:
            k = len(self.ids)
            if len(t):
                self.ids.append(i)
                self.parts.append(part)
                self.tokens.append(t)
            if 0 < len(t) < LEAST:
                self.short.setdefault(t.tobytes(), []).append(k)
            for m in () if len(t) < LEAST else MASKS if len(t) >= LENGTH else MASKS + SHORT:
                h = seeds(t, m)
                found[m].append((h, np.full(len(h), k, dtype=np.int32), np.arange(len(h), dtype=np.int32)))
        self.masks = {}
        for m, parts in found.items():
            if not parts:
                continue
            h, k, at = (np.concatenate([p[x] for p in parts]) for x in range(3))
            if not len(h):
                continue
            by = np.argsort(h, kind="stable")
            bits = int(min(26, max(12, np.ceil(np.log2(64 * len(h))))))
            maybe = np.zeros(1 << bits, dtype=bool)
            maybe[h >> U(64 - bits)] = True
            self.masks[m] = (h[by], k[by], at[by], maybe, U(64 - bits))

    def _hits(self, doc: np.ndarray) -> Iterator[np.ndarray]:
        """``(piece, diagonal)`` of the seeds' hits, each once in a block of at most about HITS."""
        for m, (known, item, offset, maybe, shift) in self.masks.items():
            h = seeds(doc, m)
            at = np.flatnonzero(maybe[h >> shift])
            if not len(at):
                continue
            first, last = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            found = first < last
            at, first, n = at[found], first[found], (last - first)[found]
            upto = np.cumsum(n)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HITS, "right")))
                within = np.arange(int(n[lo:hi].sum())) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
                seed = np.repeat(first[lo:hi], n[lo:hi]) + within
                diagonal = np.repeat(at[lo:hi], n[lo:hi]) - offset[seed]
                yield np.unique(item[seed].astype(np.int64) << 40 | (diagonal + (1 << 39)))
                lo = hi

    def leaks(self, text: str | None, any_one: bool = False) -> list[tuple[int, int, int, int, int, int]]:
        """``(item_id, part, position in the document, in the piece, length, matched)``, the best for each piece; with ``any_one``, the first."""
        doc = tokens(text)
        best = {k: (len(doc), 0, 0, len(doc)) for k in self.short.get(doc.tobytes(), ())}
        lain: set[int] = set()
        for hits in self._hits(doc) if not (any_one and best) else ():
            for hit in hits.tolist():
                k, at = hit >> 40, (hit & ((1 << 40) - 1)) - (1 << 39)
                item = self.tokens[k]
                if hit in lain or (k in best and best[k][0] == len(item)):
                    continue  # seen, or nothing better is left to find
                lain.add(hit)
                need = min(LENGTH, len(item))
                start, length, matched = agreement(item, doc, at, need)
                if length >= need and matched >= AGREE * length and (k not in best or (matched, -at - start) > best[k][:2]):
                    best[k] = (matched, -at - start, start, length)
                    if any_one:
                        break
            if any_one and best:
                break
        return [(self.ids[k], self.parts[k], -at, start, length, matched) for k, (matched, at, start, length) in best.items()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[_Index]:
    """Indexes of blocks of the benchmark, each of about SEEDS_AT_ONCE seeds at most."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    pieces = materialise(rows.mapInArrow(_pieces, _PIECES), "pieces")
    masks = F.when(F.col("length") < LENGTH, len(MASKS + SHORT)).otherwise(len(MASKS))
    n = max(1, -(-2 * (pieces.agg(F.sum(F.size("tokens") * masks)).first()[0] or 0) // SEEDS_AT_ONCE))
    for k in range(n):
        block = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(n)) == k)
        yield _Index([(r["item_id"], r["part"], np.array(r["tokens"], dtype=np.int64).view(U)) for r in block.collect()])


_LEAKS = "doc_id long, item_id long, item_part long, doc_token long, item_token long, length long, matched long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: where, how long, and how many tokens agree.

    A leak agrees in AGREE of LENGTH tokens or more, or of the whole of a shorter item; an
    item of under LEAST tokens must be all of the document. Of several passages of an
    item, the one of most agreeing tokens counts, the first of these. An item of over
    PIECE tokens is held in parts: a document has a row for each of which it holds a
    passage, and ``item_token`` counts from the part's start.

    Null and empty texts leak nothing, texts are read whole; items with a null id are left
    out. Repeated documents give repeated rows; items of equal text give a row each. Other
    columns are ignored. An empty benchmark or table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for index in _blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in held.value.leaks(t)]
                yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(_LEAKS.split(", "))})

        found = docs.mapInArrow(run, _LEAKS)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("agreement", F.col("matched") / F.col("length"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark, as ``find_leaks`` has it; rows are filtered where they are read.

    A row with a null or empty text stays, as does everything where the benchmark is
    empty. Repeated rows stay or go together. Columns may have any name and any nulls;
    they and their order are kept.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    docs = plain_names(docs)
    schema = docs.schema
    for k, index in enumerate(_blocks(benchmark, item_col, item_text_col)):
        if k and k % BLOCKS_AT_ONCE == 0:
            docs = materialise(docs, "decontaminated")
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.leaks(t, any_one=True) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs.toDF(*names)
