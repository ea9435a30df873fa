import random
import zlib

import pytest

from scriba.llm import language_codes as op

SYLLABLES = {"aa": ["the", "ing", "tion", "er"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["que", "ción", "ñ", "ado"]}


def docs_of(rng, n):
    out = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = docs_of(random.Random(4), 300) + [(1000, None, "aa"), (1001, "123 456 ...", "aa"), (1002, "", None), (None, "theing", "aa"), (1003, "einsch " * 300_000, "bb"), (1003, "einsch", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = op.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and sum(by[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.98
    for i, _, _ in rows[:300]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].held_out and by[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert op.identify(df.limit(0)).count() == 0


def test_held_out_rows_and_other_columns_change_nothing(spark):
    rows = docs_of(random.Random(6), 120)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, op.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect())) for x in (rows, other))
    assert a == b


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = op.codewords(n)
    least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert code.shape[0] == n and least >= max(1, code.shape[1] // 4)
    assert (abs(code.sum(axis=0)) < n).all()


def test_counting_in_blocks_changes_nothing(monkeypatch):
    t = "Überschall und que ción " * 50
    whole = op.ngrams(t)[0]
    monkeypatch.setattr(op, "_BLOCK", 37)
    assert (op.ngrams(t)[0] == whole).all()


def test_few_languages(spark):
    one = spark.createDataFrame([(k, "abc def", "aa") for k in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in op.identify(one).collect()} == {"aa"}
    none = spark.createDataFrame([(k, "abc def", None) for k in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in op.identify(none).collect()} == {"und"}


def test_predictions_equal_brute_force(spark):
    """The whole method again, gram by gram, in plain Python."""
    import random
    import zlib
    from math import exp, log

    rng = random.Random(4)
    letters = {"aa": "abcde ", "bb": "abxyz ", "cc": "ghkxa "}
    docs = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 90))), lang) for k, lang in enumerate(rng.choice(sorted(letters)) for _ in range(120))]
    docs += [(500, None, "aa"), (501, "12 34", "bb"), (502, "é! abc", None)]

    def grams(text):
        raw = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
        out = {}
        for n, salt in ((1, 0x3C6EF372), (2, 0x1B873593), (3, 0x5BD1E995)):
            for i in range(len(raw) - n + 1):
                x = raw[i]
                if n > 1:
                    x = x * 257 + raw[i + 1]
                if n > 2:
                    x = x * 263 + raw[i + 2]
                b = ((x + (salt & 0xFFFF)) * 0x9E3779B1 & 0xFFFFFFFF) >> 19
                out[b] = out.get(b, 0) + 1
        return out, sum(out.values())

    spelled = lambda t: bool(t) and any(c.isalpha() for c in t)
    totals = {lang: [0] * op.DIMS for lang in sorted(letters)}
    for i, t, lang in docs:
        if lang and spelled(t) and zlib.crc32(str(i).encode()) % 5:
            found, n = grams(t)
            for b, c in found.items():
                totals[lang][b] += c * op.SCALE // n
    langs = sorted(totals)
    p = {x: [(v + 0.02 * op.SCALE) / (sum(totals[x]) + 0.02 * op.SCALE * op.DIMS) for v in totals[x]] for x in langs}
    code = op.codewords(3)
    weight = []
    for bit in range(code.shape[1]):
        sides = [[x for k, x in enumerate(langs) if (code[k, bit] > 0) == yes] for yes in (True, False)]
        weight.append([log(sum(p[x][b] for x in sides[0]) / len(sides[0])) - log(sum(p[x][b] for x in sides[1]) / len(sides[1])) for b in range(op.DIMS)])
    knows = {}
    for k, x in enumerate(langs):
        own = [max(sum(a * w for a, w in zip(p[x], weight[bit], strict=True)) * code[k, bit], 1e-6) for bit in range(code.shape[1])]
        knows[x] = [v / sum(own) for v in own]
    got = {r.doc_id: r for r in op.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in docs:
        if not spelled(t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        found, n = grams(t)
        margins = [sum(c * w[b] for b, c in found.items()) / n * min(n, op.CERTAIN) for w in weight]
        loss = {x: sum(knows[x][bit] * log(1 + exp(-code[k, bit] * m)) for bit, m in enumerate(margins)) for k, x in enumerate(langs)}
        score = {x: exp(min(loss.values()) - v) for x, v in loss.items()}
        first = max(langs, key=lambda x: score[x])
        assert abs(got[i].score - score[first] / sum(score.values())) < 1e-4
        assert got[i].lang_pred == first or abs(got[i].score - sorted(score.values())[-2] / sum(score.values())) < 1e-4
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
