"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked.

Each text is encoded once by a byte-level BPE (A) and a piece model (B); what is kept are
the ids alone, as a token's length in bytes follows from its id. The ends of the tokens of
both sides cut the bytes of a text into intervals: each lies in one token of A and one of
B, so the intervals are the links, and those that end where both sides end close a group.

A link's pair of ids is packed into one integer, B's id above A's. Tasks count their pairs
by ``np.unique``; the partial counts are dealt out by ranges of the key, sorted, and runs
of equal keys summed. Each range becomes a shard in shared storage: its sorted keys, then
their counts. Tasks that look counts up map the shards into memory and search them by
bisection, so that nothing of the counts is held by the driver or sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriba.llm.byte_bpe import default_vocabulary
from scriba.llm.common import materialise, scratch_dir, utf8

#: Texts are encoded, and links found, in blocks of about so many bytes; a longer text is a block by itself.
BLOCK_BYTES = 1 << 18
#: A task counts its links whenever it has so many, and adds up what it counted when that makes so many pairs.
LINKS_AT_ONCE, PAIRS_AT_ONCE = 2_000_000, 4_000_000
#: Partial counts that one range takes, about.
RANGE_PAIRS = 4_000_000
_B = 32


@dataclass(frozen=True)
class Models:
    """The files of both tokenizers; every node has them at the same place."""

    a: str
    b: str

    @classmethod
    def installed(cls) -> Models:
        import public_tokenizers

        return cls(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


class Side:
    """A tokenizer in a task: ids of texts, and the bytes of ids."""

    def __init__(self, encode, tokens: list[bytes]):  # noqa: ANN001 - a function
        self.encode, self.tokens = encode, tokens
        self.length = np.array([len(x) for x in tokens], dtype=np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others, in order, as the characters from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(model: dict, tokens: list[bytes], added: set[int]) -> tiktoken.Encoding | None:
    """The same tokenizer as ranks, which encode several times as fast, if its file says that they are the same.

    That is, if it is plain byte-level BPE whose ids are in the order of its merges, after the bytes'.
    """
    bpe, split = model["model"], model["pre_tokenizer"] or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    first = len(bpe["vocab"]) - len(merges)
    plain = model["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = plain and not any(bpe.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or first != 256 or any(bpe["vocab"].get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    return tiktoken.Encoding("ranks", pat_str=default_vocabulary()[1], mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in added}, special_tokens={})


@lru_cache(maxsize=4)
def side_a(path: str) -> Side:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    byte, names = _byte_of_char(), model["model"]["vocab"]
    added = {x["id"]: x["content"] for x in model["added_tokens"]}
    tokens = [b""] * (max([*names.values(), *added]) + 1)
    for name, i in names.items():
        tokens[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    for i, name in added.items():
        tokens[i] = name.encode()
    ranks = _ranked(model, tokens, set(added))
    if ranks:
        return Side(lambda texts: [ranks.encode_ordinary(x) for x in texts], tokens)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True  # in a text they are plain text
    return Side(lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)], tokens)


@lru_cache(maxsize=4)
def side_b(path: str) -> Side:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


# --------------------------------------------------------------------------
# encoding
# --------------------------------------------------------------------------

_ENCODED = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _blocks(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    first = size = end = 0
    for end, n in enumerate(sizes, 1):
        size += n
        if size >= BLOCK_BYTES:
            yield first, end
            first, size = end, 0
    if first < end:
        yield first, end


def encode(docs: DataFrame, models: Models) -> DataFrame:
    """``(doc_id, a, b)`` of ``docs (doc_id, text)``: the ids of both sides as unsigned 16-bit integers.

    A has a space before the text, as B adds one. Both are empty for a text that is null
    or empty, or that one side doesn't give back byte for byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side_a(models.a), side_b(models.b)
        if max(len(a.tokens), len(b.tokens)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for batch in batches:
            raw = utf8(batch.column(1))
            for first, end in _blocks(len(x or b"") for x in raw):
                rows = [(x or b"").decode("utf-8", "replace") for x in raw[first:end]]
                some = [i for i, x in enumerate(rows) if x]
                ids_a, ids_b = [b""] * len(rows), [b""] * len(rows)
                texts = [rows[i] for i in some]
                for i, text, x, y in zip(some, texts, a.encode([f" {t}" for t in texts]), b.encode(texts), strict=True):
                    whole = f" {text}".encode()
                    if a.bytes_of(x) == whole and b.bytes_of(y) == whole:
                        ids_a[i], ids_b[i] = np.array(x, dtype="<u2").tobytes(), np.array(y, dtype="<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(ids_a, pa.binary()), pa.array(ids_b, pa.binary())], schema=_ENCODED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a binary, b binary")


# --------------------------------------------------------------------------
# links
# --------------------------------------------------------------------------


class Aligned:
    """The links and groups of a block of texts, whose bytes stand one after the other."""

    def __init__(self, a: Side, b: Side, raw_a: list[bytes], raw_b: list[bytes]):
        self.a, self.b = (np.frombuffer(b"".join(x), dtype="<u2").astype(np.int64) for x in (raw_a, raw_b))
        self.n_a, self.n_b = (np.array([len(y) // 2 for y in x], dtype=np.int64) for x in (raw_a, raw_b))
        self.end_a, self.end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        size = int(self.end_a[-1]) if len(self.a) else 0
        ends_a, ends_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        ends_a[self.end_a - 1] = True
        ends_b[self.end_b - 1] = True
        self.before_a, self.before_b = np.cumsum(ends_a, dtype=np.int64), np.cumsum(ends_b, dtype=np.int64)
        self.both = ends_a & ends_b
        cut = np.flatnonzero(ends_a | ends_b)
        #: the link that ends at each cut: the tokens whose ends are the first there or after it
        self.link_a, self.link_b = self.before_a[cut] - ends_a[cut], self.before_b[cut] - ends_b[cut]
        self.keys = (self.b[self.link_b] << _B) | self.a[self.link_a]
        last = np.concatenate(([0], np.cumsum(self.n_a)))
        limits = np.concatenate(([0], self.end_a))[last]  # where each text begins, and all end
        self.first_link = np.searchsorted(cut, limits)
        self.groups = np.flatnonzero(self.both)
        self.first_group = np.searchsorted(self.groups, limits)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's links."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[self.first_link]
        return np.diff(total)

    def written_groups(self, names: Names) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        upto = np.cumsum(self.both, dtype=np.int64)
        closes_a, closes_b = self.both[self.end_a - 1], self.both[self.end_b - 1]
        group_a, group_b = upto[self.end_a - 1] - closes_a, upto[self.end_b - 1] - closes_b
        b_before = np.concatenate(([0], self.before_b[self.groups]))
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[np.arange(len(self.a)) + b_before[group_a]] = np.where(closes_a, names.bar[self.a], names.comma[self.a])
        out[np.arange(len(self.b)) + self.before_a[self.groups][group_b]] = np.where(closes_b, names.semicolon[self.b], names.comma[self.b])
        ends = np.cumsum(self.n_a + self.n_b)
        for end, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True):
            yield b"".join(out[end - n : end].tolist())[:-1]


class Names:
    """Decimal ids with what may follow them."""

    def __init__(self, n: int):
        self.comma, self.bar, self.semicolon = (np.array([b"%d%c" % (i, ord(c)) for i in range(n)], dtype=object) for c in ",|;")


@lru_cache(maxsize=1)
def _names() -> Names:
    return Names(1 << 16)


def _aligned(batches: Iterator[pa.RecordBatch], models: Models) -> Iterator[tuple[pa.Array, Aligned]]:
    a, b = side_a(models.a), side_b(models.b)
    for batch in batches:
        raw_a, raw_b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for first, end in _blocks(3 * len(x) for x in raw_a):
            yield batch.column(0).slice(first, end - first), Aligned(a, b, raw_a[first:end], raw_b[first:end])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted keys, equal ones added up."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], counts[order])


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def partial_counts(encoded: DataFrame, models: Models) -> DataFrame:
    """``(key, n)``: the pairs that each task has linked; a key comes a few times from a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        n = size = 0

        def given(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, counts = _added(parts)
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], schema=_COUNTS)

        for _, x in _aligned(batches, models):
            links.append(x.keys)
            n += len(x.keys)
            if n >= LINKS_AT_ONCE:
                parts.append(np.unique(np.concatenate(links), return_counts=True))
                size += len(parts[-1][0])
                links, n = [], 0
                if size >= PAIRS_AT_ONCE:
                    yield from given(parts)
                    parts, size = [], 0
        if links:
            parts.append(np.unique(np.concatenate(links), return_counts=True))
        if parts:
            yield from given(parts)

    return encoded.mapInArrow(run, "key long, n long")


# --------------------------------------------------------------------------
# count shards
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Shard:
    """``n`` sorted keys from ``first`` on, and then as many counts, as little-endian 64-bit integers."""

    file: str
    first: int
    n: int


class Counts:
    """Counts of all pairs, in shards of ``folder``, and by id of B the highest of its pairs."""

    def __init__(self, folder: str, shards: list[Shard], highest: np.ndarray):
        self.folder, self.shards, self.highest = folder, shards, highest

    def opened(self) -> Lookup:
        return Lookup(self.folder, self.shards)


class Lookup:
    """Shards mapped into memory when they are first asked; a store without files of its own is copied to one that is gone when the task ends."""

    def __init__(self, folder: str, shards: list[Shard]):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.shards, self.first = shards, np.array([s.first for s in shards], dtype=np.int64)
        self.mapped: dict[int, np.ndarray] = {}

    def _shard(self, i: int) -> np.ndarray:
        if i not in self.mapped:
            at = f"{self.path}/{self.shards[i].file}"
            if isinstance(self.store, fs.LocalFileSystem):
                with open(at, "rb") as file:
                    view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            else:
                with tempfile.TemporaryFile() as file, self.store.open_input_stream(at, compression=None) as source:
                    shutil.copyfileobj(source, file)
                    file.flush()
                    view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            self.mapped[i] = np.frombuffer(view, dtype="<i8").reshape(2, -1)
        return self.mapped[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; all of them are there."""
        out = np.zeros(len(keys), dtype=np.int64)
        edges = [0, *np.searchsorted(keys, self.first[1:]).tolist(), len(keys)] if len(self.first) else []
        for i, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
            if start < end:
                known, n = self._shard(i)
                at = np.searchsorted(known, keys[start:end])
                out[start:end] = n[at]
        return out


_SHARDS = pa.schema([("file", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("b", pa.list_(pa.int64())), ("highest", pa.list_(pa.int64()))])


def count_shards(partial: DataFrame, folder: str) -> Counts:
    """Sum partial counts by ranges of the key and write a shard for each.

    The driver gets a row a shard: its name, first key and length, and the ids of B in it
    with their highest counts, that is one entry for each id of B and one more for each
    shard. A task that is lost or runs twice leaves a file that no row names.
    """
    spark = partial.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            k, n = _summed(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if keys and len(k) and keys[-1][-1] == k[0]:
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n.copy())
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(counts)
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.counts"
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(k.astype("<i8").tobytes())
            out.write(n.astype("<i8").tobytes())
        ids = k >> _B
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(k[0])]), pa.array([len(k)]), pa.array([ids[first].tolist()]), pa.array([np.maximum.reduceat(n, first).tolist()])], schema=_SHARDS)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // RANGE_PAIRS))
    ordered = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    rows = sorted(ordered.mapInArrow(run, "file string, first long, n long, b array<long>, highest array<long>").collect(), key=lambda r: r["first"])
    highest = np.zeros(1 << 16, dtype=np.int64)
    for r in rows:
        np.maximum.at(highest, np.array(r["b"]), np.array(r["highest"]))
    return Counts(folder, [Shard(r["file"], r["first"], r["n"]) for r in rows], highest)


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _counted(encoded: DataFrame, counts: Counts, models: Models) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = counts.opened(), _names()
        for ids, x in _aligned(batches, models):
            keys, where = np.unique(x.keys, return_inverse=True)
            n = known.counts(keys)
            best = n == counts.highest[keys >> _B]
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.written_groups(names)]
            found = [x.n_a, x.n_b, np.diff(x.first_group), np.diff(x.first_link), x.sums(best[where]), x.sums(n[where])]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in found), pa.array(digests, pa.string())], schema=_RESULT)

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in _RESULT))


def align(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every text.

    ``n_best`` counts a text's links whose pair is linked as often as any of its id of B,
    ``count_sum`` adds up their pairs' counts over the whole table. A null or empty text,
    and one that a tokenizer doesn't give back byte for byte, has zeros and an empty
    digest. Repeated rows and ids are rows of their own and count each time; a null id
    stays null. Texts are encoded whole, however long. Other columns are ignored. An empty
    table gives an empty result.
    """
    models = models or Models.installed()
    encoded = materialise(encode(docs, models), "encoded")
    partial = materialise(partial_counts(encoded, models), "partial")
    counts = count_shards(partial, f"{scratch_dir(docs.sparkSession)}/pairs-{uuid.uuid4().hex}")
    return _counted(encoded, counts, models)
