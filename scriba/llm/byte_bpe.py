"""Byte-level BPE: exact merges in linear time, without merging.

A text is cut by the vocabulary's pattern, and each piece is encoded by itself. Its bytes,
as Latin-1 characters, go through an Aho-Corasick automaton of all tokens, which gives the
longest token that starts at each place. Tokens are then laid from left to right, the
longest first. Two neighbours must be compatible, that is, merging the bytes of both must
give these two tokens again; where no token fits, the last one is taken back for its next
shorter prefix. A sequence whose neighbours are all compatible is the one that merging
gives, so the prefix up to a place has one encoding, a place that leads nowhere is marked
once, and the work is linear in the length of the piece. Compatibility is memoised by pair
of tokens, and the ids of short pieces by piece, both up to a stated number of entries.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriba.llm.common import columns_of, fresh, utf8

#: Memoised pairs of tokens and pieces in a task; a full memo starts again.
PAIRS, PIECES = 1 << 20, 1 << 18
#: Longer pieces aren't memoised.
PIECE_CHARS = 64
#: Texts of more characters are cut into pieces by and by.
AT_ONCE = 1 << 20
_NEVER = 1 << 62


def default_vocabulary() -> tuple[str, str]:
    """The file of ranks and the pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Vocabulary:
    """Ranked byte strings, and what encoding and decoding need of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of: dict[int, bytes] = {r: b for b, r in ranks.items()}
        self.length = {r: len(b) for b, r in ranks.items()}
        self.shorter = {r: self._prefix(b) for b, r in ranks.items()}
        self.tokens = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.tokens.add_word(b.decode("latin-1"), (len(b) - 1, r))
        self.tokens.make_automaton()
        self._edges: dict[tuple[int, int], list[int] | None] = {}
        self._fits: dict[int, bool] = {}  # left << 32 | right, less than half of a tuple's memory
        self._known: dict[str, bytes] = {}

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix; -1 for none."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that a token is merged from at last; None if merging its bytes gives no single token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, token: int, side: int) -> list[int] | None:
        """What stands at the left (0) or right (1) edge of a token while it is merged: from a byte to the token itself."""
        found = self._edges.get((token, side), False)
        if found is False:
            own, found = self.bytes_of[token], [token]
            if len(own) > 1:
                halves = self._halves(own)
                inner = [self._edge(self.ranks[h], side) for h in halves] if halves and all(h in self.ranks for h in halves) else [None]
                found = None if None in inner else [*inner[side], token]
            self._edges[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two tokens.

        Parts only grow into tokens of higher rank, so both edges grow in the order of
        ranks. A merge over the border comes first where its rank is below that of what
        the left edge grows into, and not above that of the right one: of equal merges
        the leftmost is made.
        """
        pair = left << 32 | right
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            found = self._fits[pair] = self._replay(self._edge(left, 1), self._edge(right, 0))
        return found

    def _replay(self, ends: list[int] | None, starts: list[int] | None) -> bool:
        if ends is None or starts is None:
            return False
        i = j = 0
        while True:
            end_grows = ends[i + 1] if i + 1 < len(ends) else _NEVER
            start_grows = starts[j + 1] if j + 1 < len(starts) else _NEVER
            across = self.ranks.get(self.bytes_of[ends[i]] + self.bytes_of[starts[j]], _NEVER)
            if across < end_grows and across <= start_grows and across != _NEVER:
                return False
            if end_grows == start_grows == _NEVER:
                return True
            if end_grows <= start_grows:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern. A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        longest = array("q", [-1]) * n
        for end, (before, token) in self.tokens.iter(piece.decode("latin-1")):
            longest[end - before] = token  # ends ascend, so the last is the longest
        out: list[int] = []
        dead, at, token = bytearray(n + 1), 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
            else:
                raise ValueError(f"the vocabulary lacks the byte {piece[at]:#04x}")
        return out

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while block := [m.group() for m in islice(matches, AT_ONCE // 8)]:
            yield block

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self._known, []
        for pieces in self._pieces(text):
            for piece in pieces:
                ids = known.get(piece)
                if ids is None:
                    ids = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
                    if len(piece) <= PIECE_CHARS:
                        if len(known) >= PIECES:
                            known.clear()
                        known[piece] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that ``encode`` gives."""
        return _joined(self.bytes_of, ids)


def _joined(bytes_of: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``, as the node that runs the task has it."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(_ranks(path), pattern)


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    """What decoding needs of a vocabulary."""
    return {r: b for b, r in _ranks(path).items()}


def _one_by_one(column: pa.Array) -> Iterator[bytes | None]:
    """A string column's values as UTF-8 bytes; few of them are copied at once."""
    for first in range(0, len(column), 64):
        yield from utf8(column.slice(first, 64))


def _in_blocks(values: Iterable[tuple[int, bytes, bytes]], most: int = 8 << 20) -> Iterator[tuple[int, int, list[tuple[bytes, bytes]]]]:
    """Consecutive pairs of values in blocks of some bytes: first, end, values."""
    first, block, size = 0, [], 0
    for i, *x in values:
        block.append(x)
        size += len(x[0]) + len(x[1])
        if size >= most:
            yield first, i + 1, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, first + len(block), block


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None, pattern: str | None = None, back: str | None = None) -> DataFrame:
    """``docs`` with its text's tokens as the binary column ``ids``: little-endian unsigned 32-bit integers.

    ``back`` names one more binary column: the bytes that those ids decode to, in the same
    tasks, so that neither the ids nor the vocabulary go to other workers for it.

    Every row stays by itself, nothing is shuffled: repeated rows and ids keep their rows.
    A null or empty text has no tokens, a text of any length is encoded whole. A column of
    the name ``ids`` or ``back``, in any case, is replaced; others stay as they are, whatever
    their names. Special tokens are plain text. An empty table gives an empty one.
    """
    at, split = default_vocabulary() if path is None or pattern is None else (path, pattern)
    at, split = path or at, pattern or split
    made = [ids] if back is None else [ids, back]
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in made]]
    own = docs.select(*[c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name in kept])
    plain = own.toDF(*(f"c{i}" for i in range(len(kept))))  # names that any reader of schemas takes
    read = fresh(plain, "text")
    rows = plain.withColumn(read, F.col(f"c{kept.index(text)}").cast("string"))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(x, T.BinaryType()) for x in ("ids", "back")[: len(made)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(at, split)
        for batch in batches:
            coded = (words.encode(x.decode("utf-8", "replace")) if x else b"" for x in _one_by_one(batch.column(batch.num_columns - 1)))
            found = ((i, x, b"" if back is None else words.decode(x)) for i, x in enumerate(coded))
            for first, end, block in _in_blocks(found):
                columns = [c.slice(first, end - first) for c in batch.columns[:-1]]
                new = [pa.array(list(x), pa.binary()) for x in zip(*block, strict=True)][: len(made)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, *made)


def decoded(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that a column of ``encode`` stands for; null for null. The pattern has no part in it."""
    at = path or default_vocabulary()[0]

    @F.pandas_udf("binary")
    def run(column):  # noqa: ANN001, ANN202 - pandas reads hints of its own
        tokens = _bytes_of(at)
        return column.map(lambda x: None if x is None else _joined(tokens, x))

    return run(ids)


def round_trip(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text; see ``encode`` for what odd rows give."""
    rows = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), back="decoded")
    n = F.call_function("div", F.octet_length("token_ids"), F.lit(4)).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
