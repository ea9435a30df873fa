"""Secret scans: fixed patterns, and the cost of guessing a value.

Patterns find assigned secrets, access keys and long hexadecimal runs. Values in other
credential contexts (a login, a passphrase, a private key, or an assigned value that is
shorter than the pattern's) are weighed: the least number of guesses that finds the
value when it is put together from words, dates, repeats, keyboard walks and brute force.
Dynamic programming over the value's positions finds the cheapest segmentation, of the
whole value and of any number of parts. A value that takes many guesses is a secret.

The words are what people often pick, and then the most frequent words of the corpus
itself, counted over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriba.llm.common import materialise

#: Values that take 10 to this power guesses are secrets.
COST = 10.0
#: Words of the corpus that an attacker tries, and their length.
WORDS, SHORTEST, LONGEST = 20_000, 3, 20
#: Characters of a repeated unit, as many as a word may have.
UNIT = LONGEST
#: Words that a task holds.
_HELD = 400_000

# What people often pick, the most frequent first.
COMMON = (
    "password", "123456", "qwerty", "admin", "letmein", "welcome", "login", "abc123", "iloveyou", "monkey", "dragon", "football", "master", "sunshine", "princess",
    "secret", "changeme", "default", "test", "guest", "root", "user", "example", "sample", "demo", "dummy", "placeholder", "your", "token", "key", "pass", "api", "none",
    "null", "true", "false", "undefined", "empty", "hidden", "redacted", "removed", "value", "string", "here", "insert", "my", "the", "and", "for", "this", "that", "with",
    "love", "hello", "shadow", "superman", "batman", "summer", "winter", "spring", "autumn", "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "red", "blue", "green", "black", "white",
    "house", "dog", "cat", "home", "work", "office", "server", "client", "database", "local", "host", "prod", "dev", "staging", "public", "private", "access", "system",
)
# Rows of a keyboard without and with shift, and how far each is moved to the right.
KEYS = (("`1234567890-=", "~!@#$%^&*()_+", 0.0), ("qwertyuiop[]", "QWERTYUIOP{}", 1.5), ("asdfghjkl;'", 'ASDFGHJKL:"', 1.75), ("zxcvbnm,./", "ZXCVBNM<>?", 2.25))

_COMMON = {w: k + 1 for k, w in enumerate(COMMON)}
_LEET = str.maketrans("@4301!$57", "aaeoiisst")
# What a date looks like, and how many there are (as a power of 10).
_DATES = ((re.compile(r"(?:19|20)\d\d"), 2.1), (re.compile(r"(?:19|20)\d\d[-/.]?\d\d?(?:[-/.]?\d\d?)?"), 4.6), (re.compile(r"\d\d?[-/.]\d\d?[-/.](?:19|20)?\d\d"), 4.6))
#: What each part costs as such: which of the five kinds it is.
PART = log10(5)


def _key_places() -> dict[str, tuple[int, float, bool]]:
    """Row, distance from the left, and whether it takes shift, of each character on a keyboard."""
    return {c: (row, at + k, shift) for row, (low, high, at) in enumerate(KEYS) for shift, keys in enumerate((low, high)) for k, c in enumerate(keys)}


_PLACES = _key_places()
#: A walk starts at some key in some direction: one of six on the keyboard, or two in the alphabet. It goes straight on, or turns.
_TURN = log10(8)
_START, _STRAIGHT, _SHIFT = log10(sum(len(low) for low, _, _ in KEYS)) + _TURN, 0.1, log10(2)


def directions(a: str, b: str) -> list[int]:
    """The directions in which one steps from ``a`` to ``b``: 0 to 5 to a key beside it, 6 and 7 along the alphabet."""
    out = []
    if a in _PLACES and b in _PLACES:
        (row, x, _), (to, y, _) = _PLACES[a], _PLACES[b]
        if abs(to - row) <= 1 and 0 < abs(y - x) <= 1 and (to == row or abs(y - x) < 1):
            out.append(2 * (to - row + 1) + (y > x))
    low, high = a.lower(), b.lower()
    if low.isascii() and high.isascii() and low.isalpha() and high.isalpha() and abs(ord(high) - ord(low)) == 1:
        out.append(6 + (high > low))
    return out


def _shifted(c: str) -> bool:
    return c.isupper() or (c in _PLACES and bool(_PLACES[c][2]))


def _alphabet(s: str) -> int:
    return max(10, 10 * bool(re.search(r"\d", s)) + 26 * bool(re.search("[a-z]", s)) + 26 * bool(re.search("[A-Z]", s)) + 33 * bool(re.search("[^0-9A-Za-z]", s)))


def _lower(value: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of a value; 0 for an empty one.

    A segmentation costs the product of its parts' guesses, where the kind of each part
    has to be guessed too. ``words`` gives ranks. The value is read once: what is open at
    a position is one cost for brute force, one for each direction of a walk, and the
    starts of repeats that may still become the cheapest. A repeat costs its unit's own
    cheapest segmentation and how often it comes.
    """
    words = _COMMON if words is None else words
    return _cost(value, words, log10(_alphabet(value)), {}) if value else 0.0


def _cost(value: str, words: dict[str, int], each: float, units: dict[str, float]) -> float:
    """``guess_cost`` where a character of brute force costs ``each``; ``units`` has the costs of repeated units."""
    n, inf = len(value), float("inf")
    low = _lower(value)
    plain, shifts = low.translate(_LEET), [_shifted(c) for c in value]
    best = [0.0] + [inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}  # parts that end further on: (start, cost)
    brute = inf  # the cheapest brute force from here on, less what its characters cost
    two: dict[int, float] = {}  # open walks of two keys, and of more, by direction
    more: dict[int, float] = {}
    same = [0] * (UNIT + 1)  # so many characters up to here equal those a unit before
    live: list[list[list[tuple[float, int]]]] = [[[] for _ in range(size)] for size in range(UNIT + 1)]
    for j in range(1, n + 1):
        i = j - 1
        for end, cost in _short_parts(value, low, plain, i, words):
            ends.setdefault(end, []).append((i, cost))
        brute = min(brute, best[i] - each * i)
        now = brute + each * j + PART
        for start, cost in ends.pop(j, ()):
            now = min(now, best[start] + cost + PART)
        if i:
            shift = _SHIFT * (shifts[i] != shifts[i - 1])
            steps = directions(value[i - 1], value[i])
            walks = {d: min(c + (_STRAIGHT if d == e else _TURN) for x in (two, more) for e, c in x.items()) + shift for d in steps} if two or more else {}
            two = {d: best[i - 1] + _START + _SHIFT * shifts[i - 1] + shift for d in steps}
            more = walks
            now = min([now, *(c + PART for c in more.values())])
        for size in range(1, min(UNIT, i) + 1):  # a unit and how often it comes again
            if value[i] != value[i - size]:
                if same[size] >= size:
                    live[size] = [[] for _ in range(size)]
                same[size] = 0
                continue
            same[size] += 1
            if same[size] >= size:
                starts = live[size][j % size]
                starts.append((best[j - 2 * size], j - 2 * size))
                unit = value[j - size : j]
                if unit not in units:
                    units[unit] = _cost(unit, words, each, units)
                now = min(now, _cheapest(starts, j, size, units[unit]) + PART)
        best[j] = now
    return best[n]


def _short_parts(value: str, low: str, plain: str, i: int, words: dict[str, int]) -> Iterator[tuple[int, float]]:
    """``(end, cost)`` of the words and dates from ``i`` on."""
    for j in range(i + 2, min(len(value), i + LONGEST) + 1):
        for text, extra in ((low, 0.0), (plain, 0.6)):
            if rank := words.get(text[i:j]):
                case = 0.0 if value[i:j] in (text[i:j], low[i:j]) else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.2
                yield j, log10(rank + 1) + extra + case
    if value[i].isdigit():
        for pattern, cost in _DATES:
            if m := pattern.match(value, i):
                yield m.end(), cost


def _cheapest(starts: list[tuple[float, int]], j: int, size: int, unit: float) -> float:
    """The least cost of a repeat that ends at ``j``; starts that no later end makes the cheapest are taken out.

    The logarithm of the count grows faster for a later start: one that is no cheaper
    than an earlier one now never will be, and an earlier one that isn't cheaper to
    reach never will be either.
    """
    least, kept = float("inf"), []
    for c, i in starts:
        cost = c + (unit + log10((j - i) // size))
        if cost < least:
            least = cost
            while kept and kept[-1][0] >= c:
                kept.pop()
            kept.append((c, i))
    starts[:] = kept
    return least


# --------------------------------------------------------------------------
# words of the corpus
# --------------------------------------------------------------------------

_BETWEEN = r"[^\p{L}\p{N}]+"


def _counts(texts: pa.Array) -> pa.Table:
    """``word, n``: how often each word occurs in the texts, outside of values in credential contexts."""
    named = pc.fill_null(pc.match_substring_regex(texts, _CONTEXT_NAMED.pattern, ignore_case=True), False)
    if pc.any(named).as_py():
        texts = pc.replace_with_mask(texts, named, pa.array([_CONTEXT.sub(" ", t) for t in pc.filter(texts, named).to_pylist()], texts.type))
    found = pc.value_counts(pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(texts), _BETWEEN)))
    words, n = found.field(0), found.field(1)
    size = pc.utf8_length(words)
    kept = pc.and_(pc.and_(pc.greater_equal(size, SHORTEST), pc.less_equal(size, LONGEST)), pc.utf8_is_alpha(words))
    return pa.table({"word": pc.filter(words, kept).cast(pa.string()), "n": pc.filter(n, kept)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_counts`` of a task's texts; given out whenever so many words are held."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        held.append(_counts(batch.column(0).cast(pa.large_string())))
        if sum(t.num_rows for t in held) > _HELD:
            held = [summed()]
            if held[0].num_rows > _HELD // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from summed().to_batches()


def vocabulary(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Ranks of words: COMMON, then the most frequent others of ``docs``, counted over all of it.

    These are the words of the highest levels of frequency, each a twentieth above the
    next, as many whole levels as hold WORDS or fewer in all. The driver gets a number
    for each level, and then those words. A word stands between other characters than
    letters and digits, so parts of keys are none.
    """
    counts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(~F.col("word").isin(*COMMON)).withColumn("level", F.floor(F.log("n") / log(1.05)).cast("int")), "words")
    sizes = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    held, least = 0, max(sizes, default=0) + 1
    for level in sorted(sizes, reverse=True):
        held += sizes[level]
        if held > WORDS:
            break
        least = level
    found = sorted((-r["n"], r["word"]) for r in counts.where(F.col("level") >= least).select("word", "n").collect())
    return _COMMON | {w: len(COMMON) + 1 + k for k, (_, w) in enumerate(found)}


_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_NAMED = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as of [0-9a-f]+, of 16 and more
_CONTEXT = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth)[\"']?[ \t]*(?:[:=]|:=|=>)[ \t]*[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE | re.ASCII)
_CONTEXT_NAMED = re.compile("pass|pwd|secret|token|key|credential|auth", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "guess")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches, of each kind leftmost and without overlap, in order."""
    out = []
    if _NAMED.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, words: dict[str, int] | None = None) -> list[tuple[int, int, int, float]]:
    """``(start, kind, end, cost)`` of values in credential contexts that take many guesses."""
    if not _CONTEXT_NAMED.search(text):
        return []
    found = [(m.start(1), 3, m.end(1), guess_cost(m[1], words)) for m in _CONTEXT.finditer(text)]
    return [x for x in found if x[3] >= COST]


def _written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in spans)


_ROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("max_cost", pa.float64())])


_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows of ``doc_id, text``; only texts that hold a part of some pattern are looked at one by one."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        named = pc.match_substring_regex(texts, _CONTEXT_NAMED.pattern, ignore_case=True)
        some = pc.or_(named, pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{16}")))
        n = batch.num_rows
        kinds, digests, spans, cost = np.zeros((3, n), dtype=np.int64), [_NOTHING] * n, [""] * n, [None] * n
        at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
        for k, text, more in zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), named.take(pa.array(at)).to_pylist(), strict=True):
            base, guessed = base_spans(text), guessed_spans(text, words) if more else []
            kinds[:, k] = np.bincount([x[1] for x in base], minlength=3)
            digests[k], spans[k] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted([*base, *(x[:3] for x in guessed)]))
            cost[k] = max((x[3] for x in guessed), default=None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, kinds), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(cost, pa.float64())], schema=_ROW)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of secrets for every row of ``docs``, in code points with the end exclusive.

    ``base_sha256`` is that of the patterns' spans, ``kind:start:end`` joined by commas
    in the order of start and kind; ``spans`` adds those found by their guess cost, and
    ``max_cost`` is the highest of these. The words that make a value cheap come from all
    of ``docs``. A null text counts as empty; an empty list of spans is an empty string.
    Texts and values are read whole, however long. Each row is scanned by itself, so
    repeated rows and null ids are no special case; other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, held.value)

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_cost double")
