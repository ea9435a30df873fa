import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scriba.llm import token_alignment as op

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text):
    """Ids and byte ends of both sides, or None; a token of A is decoded by its characters' places."""
    if not text:
        return None
    whole = f" {text}".encode()
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    byte = {}
    for x in range(256):
        byte[chr(x) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174 else chr(256 + sum(not (33 <= y <= 126 or 161 <= y <= 172 or y >= 174) for y in range(x)))] = x
    parts = [[bytes(byte[c] for c in A.id_to_token(i)) for i in a], [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(p) != whole for p in parts):
        return None
    return [list(zip(ids, np.cumsum([len(x) for x in p]).tolist(), [len(x) for x in p], strict=True)) for ids, p in zip((a, b), parts, strict=True)]


def brute(docs):
    read, count = [tokens(t) for _, t in docs], Counter()
    links = []
    for x in read:
        links.append([(a, b) for a, ea, na in x[0] for b, eb, nb in x[1] if max(ea - na, eb - nb) < min(ea, eb)] if x else [])
        count.update(links[-1])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), x, own in zip(docs, read, links, strict=True):
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        shared = sorted({e for _, e, _ in x[0]} & {e for _, e, _ in x[1]})
        groups = []
        for low, high in zip([0, *shared], shared, strict=False):
            groups.append("|".join(",".join(str(t) for t, e, _ in side if low < e <= high) for side in x))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(x[0]), len(x[1]), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest))
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(7)
    words = ["the", "Überraschung", "tokenization", "123456", "日本語", "🙂", "x", "naïve", "don't", "a\tb", "\n", "<|endoftext|>", "<s>", "ﬁ", "▁", "\x01"]
    docs = [(k, " ".join(rng.choices(words[:13], k=rng.randrange(0, 14)))) for k in range(120)]
    return docs + [(7, "again"), (7, "again"), (None, "no id"), (500, None), (501, ""), (502, " "), (503, "  two  spaces "), (504, "a ▁ b"), (505, "ﬁ２"), (506, "\x01\x00 \r\n"), (507, "ab" * 400)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("BLOCK_BYTES", 50), ("LINKS_AT_ONCE", 30), ("PAIRS_AT_ONCE", 60), ("RANGE_PAIRS", 40)):
            monkeypatch.setattr(op, name, n)
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as a", "2 as b", "3 as key", "4 as n", "5 as `a.b`", "6 as Doc").repartition(5)
    got = op.align(df)
    assert [t for _, t in got.dtypes] == [*["bigint"] * 7, "string"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_ranks_are_the_same_tokenizer_and_others_are_not_taken_for_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b" for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [t or "" for _, t in some_docs()]
    assert op.side_a(path).encode(texts) == [x.ids for x in A.encode_batch(texts, add_special_tokens=False)]
    model = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "model": {"vocab": {}, "merges": []}}
    assert op._ranked(model, [], set()) is None
    assert op._ranked(json.load(open(public_tokenizers.path("word_bpe_49k.json"))), [], set()) is None


def test_shards_hold_the_counts_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "RANGE_PAIRS", 50)
    rng = random.Random(2)
    rows = [((rng.randrange(20) << 32) | rng.randrange(30), rng.randrange(1, 9)) for _ in range(2000)] + [(5 << 32, 1)] * 700
    want = Counter()
    for k, n in rows:
        want[k] += n
    counts = op.count_shards(spark.createDataFrame(rows, "key long, n long").repartition(7), f"file://{tmp_path}")
    assert len(counts.shards) > 4 and sum(s.n for s in counts.shards) == len(want)
    keys = np.array(sorted(want))
    assert counts.opened().counts(keys).tolist() == [want[k] for k in keys.tolist()]
    assert counts.opened().counts(keys[::3]).tolist() == [want[k] for k in keys[::3].tolist()]
    assert all(counts.highest[b] == max(n for k, n in want.items() if k >> 32 == b) for b in {k >> 32 for k in want})


def test_a_long_text(spark):
    docs = [(1, "".join(random.Random(1).choice("abc de\n") for _ in range(300_000))), (2, "abc")]
    got = {r.doc_id: r for r in op.align(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    x = tokens(docs[0][1])
    assert (got[1].n_a, got[1].n_b) == (len(x[0]), len(x[1]))
    assert got[1].n_links == len({e for side in x for _, e, _ in side})


def test_empty_tables(spark):
    assert op.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = op.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
