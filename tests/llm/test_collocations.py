import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriba.llm import collocations as op

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, least, top):
    freq, size = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    freq[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in freq.items():
        phrases = [p for p, a in f.items() if len(p) > 1 and a >= least]
        dropped = set()
        for q in phrases:
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q) and 100 * f[q] >= 100 * f[q[i:j]]:
                        dropped.add(q[i:j])
        rows = []
        for p in phrases:
            if p in dropped:
                continue
            cuts = [(1000 * f[p] * size[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, size[lang], -s))
    return sorted(out)


def mined(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(docs)], "doc_id long, text string, lang string").repartition(parts)
    got = op.mine(df)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(tuple(r) for r in got.collect())


def some_docs(rng, n):
    words = ["a", "b", "c", "d", "É", "x-y", "🙂"]
    phrases = ["a b c d a", "b b b", "x-y a", "É É"]
    return [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words + phrases) + rng.choice(["", "", "", ".", ", ", "\t", "\n", "?A"]) for _ in range(rng.randrange(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "least", "top", "block"), [(1, 3, 1000, 60), (2, 5, 7, 1 << 21), (3, 2, 1000, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, least, top, block):
    monkeypatch.setattr(op, "LEAST", least)
    monkeypatch.setattr(op, "TOP", top)
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    if seed == 3:
        monkeypatch.setattr(op, "BROADCAST_PHRASES", -1)
    docs = some_docs(random.Random(seed), 120)
    assert mined(spark, docs) == brute(docs, least, top)


def test_odd_rows_and_repeated_ones(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST", 2)
    docs = [("en", None), ("en", ""), (None, "to be or not to be"), ("und", "to be"), ("en", "one two. one two"), ("en", "one two. one two"), ("", "a a a a"), ("en", " \t. ")]
    assert mined(spark, docs) == brute(docs, 2, 2000)


def test_long_texts_in_slices(spark, monkeypatch):
    text = " ".join(random.Random(4).choice(["ab", "cd", "ef,", "g" * 90]) for _ in range(3000))
    monkeypatch.setattr(op, "LEAST", 20)
    want = brute([("en", text), ("de", "w " * 500)], 20, 2000)
    # in the tasks as here: a slice ends with a piece, between words, or after a word that is longer
    parts = list(op._slices(text.encode().lower().translate(op._PLAIN) + op._END))
    assert len(parts) == 1
    monkeypatch.setattr(op, "SLICE_BYTES", 64)
    raw = text.encode().lower().translate(op._PLAIN) + op._END
    parts = list(op._slices(raw))
    assert b"".join(parts) == raw and len(parts) > 100 and all(p[-1:] in (b" ", op._END) for p in parts)
    assert mined(spark, [("en", text), ("de", "w " * 500)]) == want


def test_large_products_are_exact(spark):
    rows = spark.createDataFrame([(3_000_000_000_000, 2_999_999_999_999, ["x", "y"], [3_000_000_000_001], [3_000_000_000_007])], "f long, n long, words array<string>, heads array<long>, tails array<long>")
    got = rows.select(op._worst_cut(rows["n"]).alias("x")).select("x.*").collect()[0]
    assert got.score == 1000 * 3_000_000_000_000 * 2_999_999_999_999 // (3_000_000_000_001 * 3_000_000_000_007)


def test_lists_come_back():
    lengths, positions = np.array([2, 1, 3]), np.array([5, 9, 0, 1, 2, 70_000])
    got = op._read_lists(op._packed_lists((lengths, positions)))
    assert got[0].tolist() == lengths.tolist() and got[1].tolist() == positions.tolist()


def test_empty_table_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST", 2)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.mine(empty).collect() == []
    docs = spark.createDataFrame([("x y. x y", "en")], "text string, lang string").selectExpr("*", "1 as block", "2 as idx", "3 as word", "4 as n", "5 as lists", "6 as `a.b`", "7 as id")
    assert [tuple(r) for r in op.mine(docs).collect()] == [("en", 1, "x y", 2, 2, 2, 4, 2000)]
