import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scriba.llm import byte_bpe as op


@lru_cache(maxsize=1)
def both():
    words = op.vocabulary(*op.default_vocabulary())
    return words, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(both()[0].encode(text), dtype="<u4").tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_those_of_merging(seed):
    rng, (words, merging) = random.Random(seed), both()
    tokens = list(words.ranks)
    for _ in range(2000):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))).decode("utf-8", "ignore")
        assert ids(text) == merging.encode_ordinary(text)
    for letters in ("abeinrst ", "aA1 .\n'", "éß日🙂 \t", "a"):
        for _ in range(500):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 90)))
            assert ids(text) == merging.encode_ordinary(text)


def test_special_tokens_are_plain_text():
    assert ids("a<|endoftext|>b") == both()[1].encode_ordinary("a<|endoftext|>b")


def test_a_small_vocabulary_needs_to_go_back():
    """Merging ``bc`` first makes ``abcd`` a, bcd; the longest token at its start is abc."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"bcd": 258, b"abc": 259, b"cd": 260}
    words, merging = op.Vocabulary(ranks, r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(words.encode(text), dtype="<u4").tolist() == merging.encode_ordinary(text), text


def test_long_pieces_take_linear_work(monkeypatch):
    words, merging = both()
    text = "".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    asked = []
    fits = words.compatible
    monkeypatch.setattr(words, "compatible", lambda a, b: asked.append(1) or fits(a, b))
    assert ids(text) == merging.encode_ordinary(text)
    assert len(asked) < 4 * len(text)


def test_long_texts_are_cut_by_and_by(monkeypatch):
    text = "Some words, 12 numbers; and  spaces\n" * 200
    whole = ids(text)
    monkeypatch.setattr(op, "AT_ONCE", 64)
    assert ids(text) == whole == both()[1].encode_ordinary(text)


def test_full_memos_start_again(monkeypatch):
    monkeypatch.setattr(op, "PAIRS", 3)
    monkeypatch.setattr(op, "PIECES", 2)
    words = op.Vocabulary(both()[0].ranks, public_tokenizers.PATTERN)
    text = "unheard of words, reencoded again and again; unheard"
    assert np.frombuffer(words.encode(text), dtype="<u4").tolist() == both()[1].encode_ordinary(text)
    assert len(words._known) <= 2 and len(words._fits) <= 3


def test_a_missing_byte_is_an_error():
    with pytest.raises(ValueError, match="lacks the byte"):
        op.Vocabulary({b"a": 0, b"b": 1}, r"\S+").encode("abc")


ODD = [(1, "Hello  world\n"), (2, ""), (3, None), (None, "x"), (1, "Hello  world\n"), (1, "another"), (4, "a" * 300_000 + " " + "wörd " * 50_000), (5, " \t\n ")]


def test_round_trip_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = op.round_trip(docs.selectExpr("*", "1 as token_ids", "2 as `a.b`", "3 as decoded", "4 as n_tokens").repartition(3)).collect()
    merging = both()[1]
    want = []
    for i, t in ODD:
        x = merging.encode_ordinary(t or "")
        want.append((i, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x y", "p", 2.5)], "doc_id long, text string, `a.b` string, Token_IDs double").selectExpr("*", "'q' as c0", "7 as _text")
    got = op.encode(docs)
    assert got.columns == ["doc_id", "text", "a.b", "c0", "_text", "token_ids"]
    row = got.collect()[0]
    assert row[:5] == (1, "x y", "p", "q", 7) and np.frombuffer(row[5], dtype="<u4").tolist() == both()[1].encode_ordinary("x y")
    assert bytes(got.select(op.decoded(got["token_ids"])).collect()[0][0]) == b"x y"


def test_empty_table(spark):
    assert op.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_are_decoded_where_they_are_made(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = op.encode(docs.selectExpr("*", "1 as Back"), back="back")
    assert got.columns == ["doc_id", "text", "token_ids", "back"]
    assert all(bytes(r.back) == (r.text or "").encode() == bytes(r.again) for r in got.withColumn("again", op.decoded(got["token_ids"])).collect())
    plan = op.round_trip(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # one worker a task, with one vocabulary
    monkeypatch.setattr(op, "Vocabulary", None)
    op._bytes_of.cache_clear()
    assert op._joined(op._bytes_of(op.default_vocabulary()[0]), both()[0].encode("x y")) == b"x y"  # decoding makes no automaton
