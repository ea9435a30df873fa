"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits, a binary classifier on hashed byte
n-grams tells the languages that have the bit from those that haven't. Decoding adds up,
for each language, the logistic losses of the classifiers' margins against its codeword,
weighted by how well each classifier knows that language (Escalera et al., 2010), and
takes the least; a small gap to the second is flagged as ambiguous.

The classifiers are log-ratios of n-gram frequencies. They come from sums over all
learning rows, which tasks add up before the shuffle: one pass, no sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams.
DIMS = 8192
#: Frequencies of a document are summed as integers of this scale, so that the sums don't depend on their order.
SCALE = 1_000_000
#: So many n-grams of evidence make a margin certain; more don't add to it.
CERTAIN = 60
#: Documents whose score doesn't exceed that of the second language by this are ambiguous.
GAP = 0.2
UNKNOWN = "und"
_BLOCK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128][[not chr(c).isalpha() for c in range(128)]] = 32


def ngrams(text: str) -> tuple[np.ndarray, int]:
    """Counts of the text's 1- to 3-grams of bytes by bucket, and their number. Long texts are counted in blocks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(DIMS, dtype=np.int64)
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    for at in range(0, len(raw), _BLOCK):
        x = _FOLD[raw[at : at + _BLOCK + 2]]
        own = min(_BLOCK, len(raw) - at)
        two = x[:-1] * np.uint32(257) + x[1:]
        three = two[:-1] * np.uint32(263) + x[2:]
        for gram, salt in ((x, 0x3C6EF372), (two, 0x1B873593), (three, 0x5BD1E995)):
            code = ((gram[:own] + np.uint32(salt & 0xFFFF)) * np.uint32(0x9E3779B1)) >> shift
            counts += np.bincount(code.astype(np.int64), minlength=DIMS)
    return counts, int(counts.sum())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(text):
                counts, n = ngrams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(DIMS, dtype=np.int64)
                sums[lang] += counts * SCALE // n
    for lang, v in sums.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "total": pa.array(v[at], pa.int64())})


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """``n`` codewords of -1 and 1: all distinct splits for up to five languages, else the widest apart of random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        bits = [[1 if i == n - 1 or (k >> i) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=float).T
    random, best, far = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], size=(n, 10 * ceil(log2(n))))
        code = code[:, abs(code.sum(axis=0)) < n]
        apart = (code[:, None] != code[None]).sum(axis=2)
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """Learn from all rows of ``docs`` that have a language and a letter.

    The driver gets one integer for each language and bucket (8192 buckets, so 64 KB a
    language), whatever the number of rows.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_summed, "lang string, bucket int, total long").groupBy("lang", "bucket").agg(F.sum("total").alias("total")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.zeros((len(langs), DIMS))
    table[[langs.index(x) for x in sums["lang"]], sums["bucket"].astype(int)] = sums["total"]
    p = table + 0.02 * SCALE
    p /= p.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((DIMS, code.shape[1]))
    for b in range(code.shape[1]):
        weights[:, b] = np.log(p[code[:, b] > 0].mean(axis=0)) - np.log(p[code[:, b] < 0].mean(axis=0))
    knows = np.maximum((p @ weights) * code, 1e-6)  # the mean margin each classifier gives each language
    knows /= np.maximum(knows.sum(axis=1, keepdims=True), 1e-12)
    return {"langs": langs, "code": code, "weights": weights.astype(np.float32), "knows": knows}


def decode(model: dict, text: str | None) -> tuple[str, float, bool]:
    """``(language, score, ambiguous)`` of one text."""
    langs = model["langs"]
    if not langs or not has_letter(text):
        return UNKNOWN, 0.0, False
    if len(langs) == 1:
        return langs[0], 1.0, False
    counts, n = ngrams(text)
    margin = counts @ model["weights"] / n * min(n, CERTAIN)
    loss = (model["knows"] * np.logaddexp(0, -model["code"] * margin)).sum(axis=1)
    score = np.exp(-(loss - loss.min()))
    score /= score.sum()
    first, second = np.argsort(-score, kind="stable")[:2]
    return langs[first], float(score[first]), bool(score[first] - score[second] < GAP)


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``, from the text alone; existing columns of those names are replaced."""
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select([f.name for f in fields])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(model, t) for t in batch.column(at).to_pylist()]
            own = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = type(docs.schema)(list(fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for a fifth of the ids, by their CRC; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out and predict all: ``doc_id, held_out, lang_pred, score, ambiguous``.

    Texts that are null or have no letter are ``und`` with a score of 0; so is every text
    where there is nothing to learn from. Texts are read whole, however long. Of languages
    that score the same, the first in order is taken. Null ids are held out; rows that
    repeat are each learned from, or not, and predicted. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    model = fit(docs.where(~held_out(id_col)), lang_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
