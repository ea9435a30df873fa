import random
import re

import pytest
from pyspark.sql import functions as F

from scriba.llm import quotes as op

SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(spark, rows):
    return {(r.conv_id, r.turn): r for r in op.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_links_nested_quotes_to_their_messages(spark):
    rows = [
        (1, 0, "user", "How do I boil an egg?\nAnd for how long?"),
        (1, 1, "assistant", "In water, for six minutes."),
        (1, 2, "user", "A remark in between."),
        (1, 3, "assistant", "On Monday, A wrote:\n> In Water -- for SIX minutes!\n>> how do i boil an egg\nThat was too short."),
        (1, 4, "user", "> nobody ever said this\nWell."),
        (2, 0, "user", "In water, for six minutes."),
        (2, 1, "user", "> > In water, for six minutes.\n\n> > \nYes."),
    ]
    got = by_turn(spark, rows)
    r = got[1, 3]
    assert (r.reply_to, r.linked, r.quotes, r.n_quoted, r.max_depth, r.content) == (1, True, [0, 1], 2, 2, "That was too short.")
    r = got[1, 4]
    assert (r.reply_to, r.linked, r.quotes, r.n_quoted, r.content) == (3, False, [], 1, "Well.")
    r = got[2, 1]
    assert (r.reply_to, r.linked, r.quotes, r.max_depth, r.content) == (0, True, [0], 2, "Yes.")
    assert (got[1, 0].reply_to, got[1, 0].linked, got[1, 1].reply_to) == (None, False, 0)


def test_partial_and_joined_quotations(spark):
    rows = [
        (1, 0, "user", "Line A.\nLine B.\nLine C."),
        (1, 1, "user", "Line X."),
        (1, 2, "user", "Line B."),
        (1, 3, "assistant", "> line b\n> line c\nTwo of three."),
        (1, 4, "user", "> Line C.\n> Line X.\n> altered\nOf two messages."),
        (1, 5, "user", "> Line A. Line B.\n> Line C.\nWrapped anew."),
    ]
    got = by_turn(spark, rows)
    assert got[1, 3].quotes == [0] and got[1, 3].reply_to == 0  # the run, though a later message said its first line
    assert got[1, 4].quotes == [0, 1] and got[1, 4].reply_to == 1
    assert got[1, 5].quotes == [0] and got[1, 5].linked


def test_reply_order(spark):
    rows = [(1, 0, "u", "zero"), (1, 1, "u", "one"), (1, 2, "u", "> zero\ntwo"), (1, 3, "u", "> one\nthree"), (1, 4, "u", "four"), (2, 5, "u", "a"), (2, 9, "u", "b")]
    got = by_turn(spark, rows)
    in_order = sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: r.place)
    assert [r.turn for r in in_order] == [0, 1, 3, 4, 2] and [r.level for r in in_order] == [0, 1, 2, 3, 1]
    assert [(got[2, t].place, got[2, t].level) for t in (5, 9)] == [(0, 0), (1, 1)]


def plain(rows):
    """Links and order by trying all earlier messages in turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        said, parent, kids = {}, {}, {}
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
        for _, turn, _, text in mine:
            runs, own, before = [], [], None
            for raw in text.split("\n"):
                marks = re.match(r"[ \t]*((?:>[ \t]*)*)", raw)[1]
                depth, line = marks.count(">"), norm(raw)
                if not line:
                    continue
                if depth and depth == before:
                    runs[-1][1].append(line)
                elif depth:
                    runs.append((depth, [line]))
                else:
                    own.append(line)
                before = depth
            latest = lambda part: max((t for t, lines in said.items() if any(" ".join(lines[i:j]) == " ".join(part) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1))), default=None)
            found = []
            for depth, lines in runs:
                at = latest(lines)
                found += [(depth, at)] if at is not None else [(depth, t) for t in map(lambda x: latest([x]), lines) if t is not None]
            reply = max(found, key=lambda x: (-x[0], x[1]))[1] if found else max(said, default=None)
            parent[turn] = reply
            kids.setdefault(reply, []).append(turn)
            said[turn] = own
            out[conv, turn] = (sorted({t for _, t in found}), reply)
        order, stack = [], [(t, 0) for t in reversed(kids.get(None, []))]
        while stack:
            t, level = stack.pop()
            order.append(t)
            out[conv, t] += (level, len(order) - 1)
            stack += [(k, level + 1) for k in reversed(kids.get(t, []))]
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "_BLOCK", block)
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randrange(1, 24)):
            lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 5))]
            for _ in range(rng.randrange(0, 3) if texts else 0):
                origin = [x for x in rng.choice(texts).split("\n") if not x.startswith(">")]
                i = rng.randrange(len(origin))
                part = origin[i : i + rng.randrange(1, 4)]
                if rng.random() < 0.2:
                    part[rng.randrange(len(part))] = "altered"
                lines[:0] = [rng.choice(["> ", ">", ">> "]) + x for x in part]
            texts.append("\n".join(lines))
            rows.append((conv, turn * 2, "u", texts[-1]))
    got = by_turn(spark, rows)
    want = plain(rows)
    assert {k: (r.quotes, r.reply_to, r.level, r.place) for k, r in got.items()} == want
    assert sum(bool(x[0]) for x in want.values()) > 40


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "again"), (1, 1, "user", ""), (None, 2, "user", "> again"), (1, None, "user", "> again\nx"), (1, 3, "user", ">"), (1, 4, "user", "> again\n" * 20_000), (1, 4, "user", "> again")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("x"), "_row": F.lit(1), "key": F.lit(2)})
    got = op.conversations(df)
    assert got.count() == len(rows)
    found = {(r.conv_id, r.turn): r for r in got.collect()}
    assert found[None, 2].linked is False and found[None, 2].reply_to is None and found[None, 2].place is None and found[1, None].level is None
    assert found[1, 3].content == "" and found[1, 3].n_quoted == 0 and found[1, 4].reply_to == 0
    assert sorted(r.place for r in got.collect() if r.place is not None) == [0, 0, 1, 2, 3, 3]
    assert op.conversations(df.limit(0)).count() == 0


def test_long_conversations_are_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "_BLOCK", 4)
    turns = [0, 1, 3, 9, 9, 30, 31, 32, 33]
    got = op.conversations(spark.createDataFrame([(1, t, "u", "x") for t in turns], SCHEMA)).orderBy("turn").collect()
    assert [r.reply_to for r in got] == [max((u for u in turns if u < t), default=None) for t in turns]
    assert [r.place for r in got] == [sorted(set(turns)).index(t) for t in turns]


def test_a_line_that_all_say_gives_no_pairs(spark):
    n = 300
    rows = [(1, t, "u", "> me too\nme too") for t in range(n)]
    got = op.linked(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [r.quotes for r in got] == [[t - 1] if t else [] for t in range(n)]


def test_plan_runs_no_python(spark):
    plan = op.conversations(spark.createDataFrame([(1, 0, "u", "> x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
