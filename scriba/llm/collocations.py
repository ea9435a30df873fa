"""Phrases of words that stand together more often than their parts would.

Texts are dealt into blocks of one language and a bounded number of words, and a block
keeps vertical lists: by phrase, the positions where it stands. A phrase of k words is the
phrase of its first k - 1 words at a position and that of its last k - 1 at the next one,
so lists of the next level are a merge join of adjacent positions, and a list's length is
the phrase's frequency in the block. Frequencies are summed over all blocks; only phrases
with enough of them get an id, go back to the blocks they stand in, and are extended.
Nothing of a level is held by the driver or by all tasks, but for frequent phrases while
these are few.

A phrase is known by the ids of its two parts, so counts are exact, not those of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import materialise, utf8

#: Words of a phrase, its least frequency, phrases by language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A task closes its largest block when its open ones have so many words; a piece stays whole.
BLOCK_WORDS = 1 << 21
#: Long texts are cut into words by and by.
SLICE_BYTES = 1 << 22
#: Frequent phrases of a level up to so many reach the tasks, and blocks stay where they are; more are joined by shuffles.
BROADCAST_PHRASES = 500_000

_END = b"\xff"  # is in no UTF-8 text
_PLAIN = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_zstd = pa.Codec("zstd", compression_level=1)


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def _unpacked(value: bytes) -> bytes:
    return _zstd.decompress(value[8:], int.from_bytes(value[:8], "little")).to_pybytes()


Lists = tuple[np.ndarray, np.ndarray]  # their lengths, and the ascending positions of each
Keys = tuple[np.ndarray, ...]  # what each list's phrase is: its word, or the ids of its two parts


def _packed_lists(lists: Lists) -> bytes:
    lengths, positions = lists
    steps = np.diff(positions.astype(np.int32), prepend=np.int32(0))
    return _packed(np.concatenate((np.array([len(lengths)]), lengths, steps)).astype(np.int32).tobytes())


def _read_lists(value: bytes) -> Lists:
    raw = np.frombuffer(_unpacked(value), dtype=np.int32)
    n = int(raw[0])
    return raw[1 : 1 + n].astype(np.int64), np.cumsum(raw[1 + n :], dtype=np.int64)


def _packed_keys(keys: Keys) -> bytes:
    return _packed(b"\n".join(keys[0]) if len(keys) == 1 else np.concatenate((np.diff(keys[0], prepend=0), keys[1])).tobytes())


def _read_keys(value: bytes, parts: int) -> Keys:
    raw = _unpacked(value)
    if parts == 1:
        return (np.array(raw.split(b"\n"), dtype=object),)
    both = np.frombuffer(raw, dtype=np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _columns(keys: Keys) -> dict[str, pa.Array]:
    if len(keys) == 1:
        return {"word": pa.array([w.decode("utf-8", "replace") for w in keys[0]], pa.string())}
    return {"p": pa.array(keys[0], pa.int64()), "s": pa.array(keys[1], pa.int64())}


class _Codes(dict):
    """Numbers of words in the order in which they come; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    def __init__(self) -> None:
        self.codes, self.parts, self.size = _Codes({_END: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("lists", pa.binary()), ("keys", pa.binary())])
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _told(*columns: str) -> pa.Schema:
    """Rows of a block's phrases."""
    kinds = {"lang": pa.string(), "word": pa.string()}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in columns])


def _rows(schema: pa.Schema, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for at in range(0, size, 1 << 16):
        yield pa.RecordBatch.from_arrays([columns[f.name].slice(at, 1 << 16) for f in schema], schema=schema)


def _block_row(number: int, lang: str, lists: Lists, keys: Keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": number, "lang": lang, "lists": _packed_lists(lists), "keys": _packed_keys(keys)}], schema=_BLOCKS)


def _closed(number: int, lang: str, block: _Block) -> pa.RecordBatch:
    """A block's words, and the list of each."""
    codes = np.concatenate(block.parts)
    n = np.bincount(codes, minlength=len(block.codes))
    words = np.array([*block.codes][1:], dtype=object)
    return _block_row(number, lang, (n[1:], np.argsort(codes, kind="stable")[n[0] :]), (words,))


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts that end with a piece, or at least between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE_BYTES:
            end = max(text.rfind(_END, at, at + SLICE_BYTES) + 1, 0) or max(text.rfind(b" ", at, at + SLICE_BYTES) + 1, 0)
            if end <= at:  # one word that is longer
                after = [x for x in (text.find(_END, at), text.find(b" ", at)) if x >= 0]
                end = min(after) + 1 if after else len(text)
        yield text[at:end]
        at = end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal ``(lang, text)`` into blocks."""
    blocks: dict[str, _Block] = {}
    number, total = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            for part in _slices((text or b"").lower().translate(_PLAIN) + _END):  # lower() changes A-Z alone
                words = part.replace(_END, b" " + _END + b" ").split()
                block = blocks.setdefault(lang, _Block())
                block.add(words)
                total += len(words)
                if total >= BLOCK_WORDS and words and words[-1] == _END:
                    largest = max(blocks, key=lambda x: blocks[x].size)
                    full = blocks.pop(largest)  # all of them end with a piece
                    total -= full.size
                    yield _closed(number, largest, full)
                    number += 1
    for lang, block in blocks.items():
        yield _closed(number, lang, block)
        number += 1


def _extended(lists: Lists, known: np.ndarray) -> tuple[Lists, Keys]:
    """The lists of the next level, of lists and the ids (-1 for none) of the phrases that they are of."""
    lengths, positions = lists
    local = np.repeat(np.arange(len(lengths)), lengths)
    kept = known[local] >= 0
    at, local = positions[kept], known[local[kept]]
    order = np.argsort(at, kind="stable")
    at, local = at[order], local[order]
    first = np.flatnonzero(at[1:] == at[:-1] + 1)  # the merge join: what stands here, and one further
    p, s = local[first], local[first + 1]
    order = np.lexsort((s, p))
    p, s, at = p[order], s[order], at[first[order]]
    start = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])))) if len(p) else np.zeros(0, dtype=np.int64)
    return (np.diff(np.append(start, len(p))), at), (p[start], s[start])


class _Words:
    """Ids of frequent words, by language."""

    def __init__(self, frequent: pa.Table):
        order = frequent.sort_by("lang").combine_chunks()
        ends: dict[str, tuple[int, int]] = {}
        for i, lang in enumerate(order["lang"].to_pylist()):
            ends[lang] = (ends.get(lang, (i, i))[0], i + 1)
        self.known = {x: (order["word"][a:b].combine_chunks(), order["id"][a:b].to_numpy()) for x, (a, b) in ends.items()}

    def ids(self, lang: str, keys: Keys) -> np.ndarray:
        if lang not in self.known:
            return np.full(len(keys[0]), -1, dtype=np.int64)
        values, ids = self.known[lang]
        at = pc.index_in(_columns(keys)["word"], value_set=values)
        return np.where(at.is_valid(), ids[at.fill_null(0).to_numpy()], -1)


class _Pairs:
    """Ids of frequent phrases, by the ids of their two parts."""

    def __init__(self, frequent: pa.Table):
        p, s, ids = (frequent[c].to_numpy() for c in ("p", "s", "id"))
        self.p, self.s = np.unique(p), np.unique(s)
        key = self._key(p, s)
        order = np.argsort(key)
        self.key, self.id = key[order], ids[order]

    def _key(self, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        """One number for both, -1 where a part is in no frequent phrase."""
        x, y = (np.minimum(np.searchsorted(a, b), len(a) - 1) for a, b in ((self.p, p), (self.s, s)))
        return np.where((self.p[x] == p) & (self.s[y] == s), x * len(self.s) + y, -1)

    def ids(self, lang: str, keys: Keys) -> np.ndarray:
        if not len(self.key):
            return np.full(len(keys[0]), -1, dtype=np.int64)
        key = self._key(*keys)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.id[at], -1)


class _Levels:
    """Blocks of some level as they are written, and what leads from there to the present one: the frequent phrases of the levels between."""

    def __init__(self, blocks: DataFrame, parts: int):
        self.blocks, self.parts, self.held = blocks, parts, []

    @property
    def keys(self) -> list[str]:
        return ["lang", "word"] if self.parts == 1 and not self.held else ["p", "s"]

    def extend(self, frequent: DataFrame, few: bool) -> None:
        """Go on to the next level. A few frequent phrases are sent to where the blocks are; otherwise ids meet the blocks in shuffles, and these are written again."""
        if few:
            kind = _Words if self.keys[0] == "lang" else _Pairs
            self.held.append(self.blocks.sparkSession.sparkContext.broadcast(kind(frequent.select(*self.keys, "id").toArrow())))
            return
        rest = [c for c in self.keys if c != "lang"]
        ids = self.phrases("block", "lang", "idx", *rest).join(frequent.select(*self.keys, "id"), self.keys).select("block", "idx", "id")

        def met(own: pa.Table, ids: pa.Table) -> pa.Table:
            if not own.num_rows or not ids.num_rows:
                return _BLOCKS.empty_table()
            number, lang, lists = (own.column(c)[0].as_py() for c in ("of", "lang", "lists"))
            lists = _read_lists(lists)
            known = np.full(len(lists[0]), -1, dtype=np.int64)
            known[ids.column("idx").to_numpy()] = ids.column("id").to_numpy()
            lists, keys = _extended(lists, known)
            return pa.Table.from_batches([_block_row(number, lang, lists, keys)] if len(keys[0]) else [], schema=_BLOCKS)

        own = self._mapped(lambda number, lang, lists, keys: iter([_block_row(number, lang, lists, keys)]), _BLOCKS).select(F.col("block").alias("of"), "lang", "lists")
        written = own.groupBy("of").cogroup(ids.groupBy("block")).applyInArrow(met, _ddl(_BLOCKS))
        self.blocks, self.parts, self.held = materialise(written, "blocks"), 2, []

    def phrases(self, *columns: str) -> DataFrame:
        """The phrases of each block at the present level, of ``block, lang, idx, n`` and the keys."""
        schema = _told(*columns)

        def rows(number: int, lang: str, lists: Lists, keys: Keys) -> Iterator[pa.RecordBatch]:
            size = len(keys[0])
            own = {"block": lambda: pa.array(np.full(size, number)), "lang": lambda: pa.array([lang] * size, pa.string()), "idx": lambda: pa.array(np.arange(size)), "n": lambda: pa.array(lists[0].astype(np.int64))}
            yield from _rows(schema, **{c: own[c]() for c in columns if c in own}, **_columns(keys))

        return self._mapped(rows, schema)

    def _mapped(self, give, schema: pa.Schema) -> DataFrame:  # noqa: ANN001 - a function of a block
        parts, held = self.parts, list(self.held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, lang, lists, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lists, keys = _read_lists(lists), _read_keys(keys, parts)
                    if not len(lists[0]):
                        continue  # no word
                    for x in held:
                        lists, keys = _extended(lists, x.value.ids(lang, keys))
                    if len(keys[0]):
                        yield from give(number, lang, lists, keys)

        return self.blocks.mapInArrow(run, _ddl(schema))


def _numbered(frequent: DataFrame, name: str) -> DataFrame:
    """``frequent`` written, with ``id`` from 0 without gaps: small numbers take little in shuffles."""
    rows = materialise(frequent.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each task that wrote
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("id", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_id")


def _next(rows: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    """The frequent phrases of a level: lang, words, and the frequencies of all that begins (``heads``) or ends (``tails``) them."""
    f = rows.groupBy("p", "s").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)
    side = lambda x: F.broadcast(x) if few else x
    first = parts.select(F.col("id").alias("p"), "lang", F.col("words").alias("_begin"), F.concat("heads", F.array("f")).alias("heads"))
    second = parts.select(F.col("id").alias("s"), F.element_at("words", -1).alias("_end"), F.concat("tails", F.array("f")).alias("tails"))
    out = f.join(side(first), "p").join(side(second), "s")
    return out.select("lang", "p", "s", "f", F.concat("_begin", F.array("_end")).alias("words"), "heads", "tails")


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``, all words of a language, and by number of words from 1 the phrases that come LEAST times or more."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    at = _Levels(materialise(texts.mapInArrow(_split, _ddl(_BLOCKS)), "blocks"), 1)
    words = at.phrases("lang", "word", "n").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    none = F.array().cast("array<bigint>")
    sizes = materialise(at.phrases("lang", "n").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    levels = [_numbered(words.where(F.col("f") >= LEAST).select("lang", "word", "f", F.array("word").alias("words"), none.alias("heads"), none.alias("tails")), "phrases1")]
    for k in range(2, LONGEST + 1):
        few = levels[-1].count() <= BROADCAST_PHRASES
        at.extend(levels[-1], few)
        levels.append(_numbered(_next(at.phrases("p", "s", "n"), levels[-1], few), f"phrases{k}"))
    return sizes, levels


def _worst_cut(n: Column) -> Column:
    """The cut of a phrase with the lowest score, the first of equals: ``score, k, l, r``."""
    wide = lambda x: x.cast("decimal(17,0)")

    def cut(k: Column) -> Column:
        before, after = F.element_at("heads", k), F.element_at("tails", F.size("words") - k)
        score = F.call_function("div", wide(F.col("f")) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(before) * wide(after))
        return F.struct(score.alias("score"), k.alias("k"), before.alias("l"), after.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))


def mine(docs: DataFrame) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: by language the TOP phrases of 2 to LONGEST words.

    A phrase that comes no more often than a longer one it is in is left out. It is
    enough to look at those of one word more: whatever lies in a longer phrase of that
    frequency lies in one of these, which is as frequent.

    A null language is ``und``. Null and empty texts have no words. Repeated rows count
    each time. A text of any length counts whole, and so does a word. Ties are ordered by
    frequency, then by phrase. Other columns are ignored; an empty table gives an empty
    result.
    """
    sizes, levels = frequent_phrases(docs)
    covered = [x.where(F.col("f") >= F.element_at(y, -1)).select(F.lit(k).alias("k"), F.col(c).alias("id")) for k, x in enumerate(levels[2:], 2) for c, y in (("p", "heads"), ("s", "tails"))]
    phrases = [x.select(F.lit(k).alias("k"), "id", "lang", "f", "words", "heads", "tails") for k, x in enumerate(levels[1:], 2)]
    rows, gone = phrases[0], covered[0]
    for x in phrases[1:]:
        rows = rows.unionByName(x)
    for x in covered[1:]:
        gone = gone.unionByName(x)
    rows = rows.join(gone.distinct(), ["k", "id"], "left_anti").join(sizes, "lang")
    rows = rows.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", _worst_cut(F.col("n")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {LONGEST + 1}) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, k, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS tail
         FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.j, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
           FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT lang, part FROM (
             SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS part
             FROM (SELECT lang, f, k, phrase, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM f WHERE k > 2)) WHERE j - i + 1 < k)
           x JOIN f y USING (lang) WHERE y.phrase = x.part AND x.f >= y.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS "rank"
           FROM worst w WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = w.lang AND i.part = w.phrase))
SELECT lang, "rank"::BIGINT AS "rank", phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked WHERE "rank" <= {TOP}
"""
