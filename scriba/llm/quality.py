"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic regression on its style and on words that tell
good from bad and toxic from clean documents. Its site says more: sums of that evidence
by host, and by path within the host, give posterior shares of good documents, each
level shrunk towards the one above, sparse sites most. How strongly sites shrink is
learned from how much they differ (method of moments). A document's final odds are its
own odds times what its site's posterior odds, without that document, are against the
global ones.

The classifier learns from a bounded sample of labelled rows; the site levels are sums
over all documents, which tasks add up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriba.llm.common import U, columns_of, fresh, materialise, plain_names
from scriba.llm.decontamination import tokens

#: Labelled rows that the classifier learns from, those of the least hash.
SAMPLE = 20_000
#: Hash buckets of words, and how telling a word must be to count (log-likelihood ratio).
BUCKETS, TELLING = 1 << 18, 30.0
#: A document goes where its final probability is under this.
KEEP = 0.5
#: A site counts as at most and at least so many documents of the level above.
STRENGTH = (2.0, 10_000.0)
#: Probabilities are summed as integers of this scale, and squares as decimals, so that sums don't depend on their order.
UNITS, _EXACT = 1_000_000, "decimal(20,12)"

_KINDS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 symbols
for _c in range(128):
    _KINDS[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 5 if chr(_c) in ".,'\"-:;?" else 6
_STYLE = 14


def style(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Style features of a whole text, and the buckets of its distinct words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=7)[:7] if len(raw) else np.zeros(7)
    share = kinds / max(1, len(raw))
    t = tokens(text)
    n = len(t)
    own, counts = np.unique(t, return_counts=True)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    x = np.array([
        *share,
        np.log1p(n),
        len(own) / n if n else 0,
        float((t[1:] == t[:-1]).mean()) if n > 1 else 0,
        counts.max() / n if n else 1,
        len(raw) / n / 10 if n else 1,
        1 - len(set(lines)) / len(lines) if lines else 0,
        kinds[2] / max(1, kinds[1] + kinds[2]),
    ])
    return x, (own >> U(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by word bucket over a task's labelled rows: documents that are bad, good, toxic, clean."""
    sums = np.zeros((4, BUCKETS), dtype=np.int32)
    for batch in batches:
        for text, good, toxic in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            _, words = style(text)
            words = np.unique(words)
            sums[1 if good else 0, words] += 1
            sums[2 if toxic else 3, words] += 1
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32())} | {f"n{k}": pa.array(sums[k, at].astype(np.int64)) for k in range(4)})


def _evidence(words: np.ndarray, tables: np.ndarray) -> list[float]:
    v = tables[:, words]
    return [float(v[0].sum()) / 10, float(np.minimum(v[1], 0).min(initial=0)), float(np.maximum(v[1], 0).sum() + np.minimum(v[1], 0).sum())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Learn what to keep: documents of good quality that aren't toxic.

    At most SAMPLE labelled rows are used; an id with several labels has the worst of
    each. The driver holds their features and one row
    for each word bucket.
    """
    y = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("good"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))
    y = y.where("good is not null and _id is not null").groupBy("_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(y), F.col("_doc") == F.col("_id"))  # SAMPLE rows at most
    rows = materialise(rows.select("text", "good", "toxic"), "labelled")
    sums = rows.mapInArrow(_telling, "bucket int, n0 long, n1 long, n2 long, n3 long").groupBy("bucket").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).first()
    tables = np.zeros((2, BUCKETS))
    if n["n"]:
        counts = sums.where("n0 + n1 >= 3").toPandas()
        for k, (a, b, of_a) in enumerate((("n0", "n1", n["n"] - n["good"]), ("n2", "n3", n["toxic"]))):
            x, z = counts[a].to_numpy(), counts[b].to_numpy()
            log = np.log((x + 0.5) / (of_a + 1)) - np.log((z + 0.5) / (n["n"] - of_a + 1))
            p = (of_a + 1) / (n["n"] + 2)
            ratio = x * np.log(np.maximum(x, 1) / ((x + z) * p)) + z * np.log(np.maximum(z, 1) / ((x + z) * (1 - p)))
            sure = 2 * ratio > TELLING
            tables[k, counts["bucket"].to_numpy()[sure]] = -log[sure]
    tables = tables.astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                x, words = style(text)
                found.append([*x, *_evidence(words, tables)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "good", "toxic"])

    known = rows.mapInArrow(features, "x array<double>, good int, toxic int").toPandas()
    x = np.array(known["x"].tolist(), dtype=float).reshape(-1, _STYLE + 3)
    keep = ((known["good"] == 1) & (known["toxic"] != 1)).to_numpy(dtype=float)
    return {"tables": tables} | _regression(x, keep)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """Logistic regression by Newton's steps on standardised features. Without rows, everything is kept."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        p = y.mean() if len(y) else 1.0
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.array([4.0 if p > 0 else -4.0, *np.zeros(width)])}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return {"mean": mean, "scale": scale, "w": w}


def probability(model: dict, text: str | None) -> float:
    """The classifier's own probability that a text is worth keeping."""
    x, words = style(text)
    z = (np.array([*x, *_evidence(words, model["tables"])]) - model["mean"]) / model["scale"]
    v = float(model["w"][0] + np.clip(z, -10, 10) @ model["w"][1:])
    return 1 / (1 + float(np.exp(-np.clip(v, -9, 9))))


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "p_doc") -> DataFrame:
    """``docs`` with the classifier's own probability as ``name``."""
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [probability(held.value, t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "p"])

    plain = plain_names(docs)
    return plain.mapInArrow(run, type(plain.schema)(list(plain.schema.fields)).add("p", "double")).toDF(*docs.columns, name)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _units(p: Column) -> Column:
    """A probability as an integer, so that sums don't depend on their order."""
    return F.round(p * UNITS).cast("long")


def site_sums(scored: DataFrame, levels: list[str]) -> tuple[DataFrame, float, list[float]]:
    """``(sites, share, strengths)`` of ``scored (*levels, p_doc)``; ``levels`` come host first, nulls are a site of their own.

    ``sites`` has, for each combination of levels, the sum of ``p_doc`` (in UNITS) and
    the number of documents at each level, ``s_0, n_0, s_1, n_1`` and so on. ``share`` is
    the global share of good documents; a level's strength says for how many documents of
    the level above a site of it counts. It is learned from the variance between sites,
    beyond that of their sampling.
    """
    sums = materialise(scored.groupBy(*levels).agg(F.sum(_units(F.col("p_doc"))).alias("s"), F.count(F.lit(1)).alias("n")), "sites")
    total = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    share = min(max(total["s"] / UNITS / total["n"] if total["n"] else 0.5, 1e-4), 1 - 1e-4)
    out, strengths = sums.select(*levels), []
    for k in range(len(levels)):
        keys = levels[: k + 1]
        level = sums.groupBy(*keys).agg(F.sum("s").alias(f"s_{k}"), F.sum("n").alias(f"n_{k}"))
        apart, chance = F.pow(F.col(f"s_{k}") / F.col(f"n_{k}") / UNITS - share, 2), share * (1 - share) / F.col(f"n_{k}")
        spread = level.agg(F.sum(apart.cast(_EXACT)).alias("apart"), F.sum(chance.cast(_EXACT)).alias("chance"), F.count(F.lit(1)).alias("n")).first()
        extra = max(float(spread["apart"] - spread["chance"]) / spread["n"] if spread["n"] else 0.0, 1e-9)
        strengths.append(min(max(share * (1 - share) / extra - 1, STRENGTH[0]), STRENGTH[1]))
        same = reduce(lambda a, b: a & b, (F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys))
        out = out.alias("_l").join(level.alias("_r"), same).select(*(F.col(f"_l.{c}") for c in out.columns), f"_r.s_{k}", f"_r.n_{k}")
    return materialise(out, "levels"), share, strengths


def posteriors(share: float, strengths: list[float], own: Column | None = None) -> list[Column]:
    """The share of good documents at each level of ``site_sums``, shrunk towards the level above.

    With ``own``, the document's own evidence in UNITS, it is left out of its site at
    every level: what a site says of a document is what its other documents say.
    """
    out, above = [], F.lit(share)
    for k, strength in enumerate(strengths):
        s, n = F.col(f"s_{k}"), F.col(f"n_{k}")
        if own is not None:
            s, n = s - own, n - 1
        above = (s / UNITS + strength * above) / (n + strength)
        out.append(above)
    return out


def assess(docs: DataFrame, labels: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, tuple[DataFrame, float, list[float]]]:
    """The fitted model and the site sums of ``docs``; ``levels`` names the site of a row, host first."""
    model = fit(docs, labels, id_col, text_col)
    slim = score(docs.select(*(c.cast("string").alias(n) for n, c in levels.items()), F.col(text_col).cast("string").alias("text")), model)
    return model, site_sums(slim.drop("text"), list(levels))


def judged(docs: DataFrame, model: dict, sites: tuple[DataFrame, float, list[float]], levels: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``doc``, a struct of the row's own columns, and ``p_doc, p_host, p_path, score, keep``."""
    sums, share, strengths = sites
    own, site = fresh(docs, "p"), {n: fresh(docs, n) for n in levels}
    scored = score(docs, model, text_col, own).select(F.struct(*columns_of(docs)).alias("doc"), F.col(own).alias("p_doc"), *(c.cast("string").alias(site[n]) for n, c in levels.items()))
    same = reduce(lambda a, b: a & b, (F.col(site[n]).eqNullSafe(F.col(f"_s.{n}")) for n in levels))
    p = posteriors(share, strengths, _units(F.col("p_doc")))
    joined = scored.join(sums.alias("_s"), same).select("doc", "p_doc", p[0].alias("p_host"), p[-1].alias("p_path"))
    odds = _logit(F.col("p_doc")) + _logit(F.col("p_path")) - _logit(F.lit(share))
    return joined.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("score") >= KEEP)


def document_levels() -> dict[str, Column]:
    """Sites of documents that have no URL: the source is the host, its language sections are the paths."""
    return {"host": F.col("source"), "path": F.col("lang")}


def url_levels(url: str) -> dict[str, Column]:
    """Sites of a URL: its host and the first part of its path."""
    return {"host": F.lower(F.parse_url(F.col(url), F.lit("HOST"))), "path": F.regexp_extract(F.coalesce(F.parse_url(F.col(url), F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)}


def assess_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, p_doc, p_host, p_path, score, keep)`` for every row of ``docs``.

    ``p_host`` and ``p_path`` are what the other documents of the site say. A null or
    empty text has no words; its style alone counts. Texts are read whole, however long.
    Null sources and languages are sites of their own. Without labels everything is kept.
    Repeated rows give repeated rows, each other's evidence; other columns are ignored.
    An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    model, sites = assess(slim, labels, document_levels())
    return judged(slim, model, sites, document_levels()).select("doc.doc_id", "p_doc", "p_host", "p_path", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, as ``assess_documents`` judges them.

    Columns may have any name and any nulls; they and their order are kept. Repeated rows
    stay or go together; without labels everything stays. An empty table stays empty.
    """
    model, sites = assess(docs, labels, document_levels())
    return judged(docs, model, sites, document_levels()).where("keep").select("doc.*")
