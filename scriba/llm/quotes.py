"""Chat formatting by quotation linking.

A message's lines are parsed for quote marks; a run of lines at one depth is a passage.
The normalised hash of a passage is joined with the hashes of what earlier messages of
the same conversation said themselves: a whole message, as many consecutive lines, or,
where no one said the passage as such, each of its lines alone. The latest message that
said it is the one that is quoted. A message replies to the latest message it quotes, at
the least depth; without a quotation, to the one before it. Conversations are the
messages in reply order (each thread after the message that opens it, threads by their
turns), each with its own lines alone.

All of it is DataFrame functions: no Python runs on the executors. "The latest before"
and "how many before" are found in blocks of turns, and then between blocks, so that
neither a long conversation nor a passage that all its messages repeat is one task's. A
quotation gives one row for its passage, or one for each line, however often it was said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import materialise

#: Quote marks at the start of a line; spaces may stand between them.
_MARKS = r"^[ \t]*((?:>[ \t]*)+)"
_QUOTING = r"(?m)^[ \t]*>"
_LINES = r"\r\n|\r|\n"
#: Turns of a conversation that one task puts in order.
_BLOCK = 1024
#: A line that says whom the next one quotes.
_CREDIT = r"^(On .* wrote:|.* (wrote|schrieb|escribió|a écrit) ?:)[ \t]*$"


def _normal(text: Column) -> Column:
    """Lower case, with one space for all between letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(lines: Column) -> Column:
    """The hash of normalised lines, read as one text."""
    return F.md5(F.array_join(lines, " "))


def lines_of(text: Column) -> Column:
    """The non-blank lines of a text: ``depth, norm, credit``."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, _MARKS, 1)
        depth = F.length(marks) - F.length(F.replace(marks, F.lit(">")))
        return F.struct(depth.alias("depth"), _normal(F.regexp_replace(raw, _MARKS, "")).alias("norm"), raw.rlike(_CREDIT).alias("credit"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _LINES), line), lambda x: x["norm"] != "")


def passages_of(lines: Column) -> Column:
    """The runs of quoted lines of one depth: ``depth, norms``; ``lines`` is a column of a table, as it is looked up for each line."""
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))

    def ends(step: int) -> Column:
        return F.filter(places, lambda k: (F.get(lines, k)["depth"] > 0) & ~F.get(lines, k)["depth"].eqNullSafe(F.get(lines, k + step)["depth"]))

    runs = F.arrays_zip(ends(-1).alias("first"), ends(1).alias("last"))
    return F.transform(runs, lambda r: F.struct(F.get(lines, r["first"])["depth"].alias("depth"), F.transform(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), lambda x: x["norm"]).alias("norms")))


# --------------------------------------------------------------------------
# orders in blocks
# --------------------------------------------------------------------------


def _block(of: str) -> Column:
    return F.floor(F.col(of) / _BLOCK)


def latest_before(points: DataFrame, asked: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each distinct ``asked (*by, turn)``: as ``name``, the largest turn under it among ``points (*by, turn)``, or null."""
    cols = [*by, "turn"]
    both = points.select(*cols, F.lit(True).alias("_is")).unionByName(asked.select(*cols, F.lit(False).alias("_is")))
    both = both.groupBy(*cols).agg(F.max("_is").alias("_point"), F.min("_is").alias("_no")).withColumn("_block", _block("turn"))
    point = F.when(F.col("_point"), F.col("turn"))
    inner = Window.partitionBy(*by, "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*by, "_block").agg(F.max(point).alias("_top"))
    ends = ends.select(*by, "_block", F.max("_top").over(order).alias("_earlier"))
    rows = both.withColumn("_inner", F.max(point).over(inner)).where("not _no").join(ends, [*by, "_block"])
    return rows.select(*cols, F.coalesce("_inner", "_earlier").alias(name))


def _counted(nodes: DataFrame, name: str) -> DataFrame:
    """Distinct ``nodes (conv_id, turn)`` with how many turns of the conversation come before."""
    rows = nodes.withColumn("_block", _block("turn"))
    order = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", "_block", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("turn")) - 1
    return rows.withColumn("_inner", inner).join(before, ["conv_id", "_block"]).withColumn(name, (F.col("_inner") + F.col("_before")).cast("long")).drop("_block", "_inner", "_before")


# --------------------------------------------------------------------------
# links
# --------------------------------------------------------------------------


def _links(quoting: DataFrame, talk: DataFrame) -> DataFrame:
    """``(_row, quotes, quoted)``: the turns that the messages ``quoting`` quote, of the ``talk`` of their conversations."""
    parsed = quoting.select("_row", "conv_id", "turn", F.posexplode("_passages").alias("_n", "_x")).where("conv_id is not null and turn is not null")
    passages = parsed.select("_row", "conv_id", "turn", "_n", "_x.depth", "_x.norms", F.size("_x.norms").alias("m"), _key(F.col("_x.norms")).alias("key"), F.md5(F.get("_x.norms", F.lit(0))).alias("first"))
    passages = materialise(passages, "passages")

    # what was said: messages, lines, and runs of lines that begin and are as long as a quoted passage
    messages = talk.where(F.size("_own") > 0)
    lines = messages.select("_row", "conv_id", "turn", F.posexplode("_own").alias("at", "norm")).select("_row", "conv_id", "turn", "at", F.md5("norm").alias("key"))
    lengths = passages.where("m > 1").groupBy("conv_id", "first").agg(F.collect_set("m").alias("lengths"))
    places = lines.withColumnRenamed("key", "first").join(lengths, ["conv_id", "first"]).groupBy("_row").agg(F.collect_list(F.struct("at", "lengths")).alias("places"))
    runs = messages.join(places, "_row").select("conv_id", "turn", "_own", F.explode("places").alias("p")).select("conv_id", "turn", "_own", "p.at", F.explode("p.lengths").alias("m"))
    runs = runs.where("at + m <= size(_own)").select("conv_id", "turn", _key(F.expr("slice(_own, at + 1, m)")).alias("key"))
    whole = messages.select("conv_id", "turn", _key(F.col("_own")).alias("key"))
    said = lines.select("conv_id", "turn", "key").unionByName(whole).unionByName(runs)

    parts = passages.where("m > 1").select("_row", "conv_id", "turn", "_n", "depth", F.explode(F.transform("norms", F.md5)).alias("key"))
    asked = passages.select("conv_id", "turn", "key").unionByName(parts.select("conv_id", "turn", "key"))
    said = said.join(asked.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    found = materialise(latest_before(said, asked, ["conv_id", "key"], "origin").where("origin is not null"), "quoted")

    as_such = materialise(passages.join(found, ["conv_id", "key", "turn"], "left").select("_row", "_n", "depth", "origin"), "linked")
    alone = parts.join(as_such.where("origin is null").select("_row", "_n"), ["_row", "_n"], "left_semi").join(found, ["conv_id", "key", "turn"]).select("_row", "depth", "origin")
    links = as_such.where("origin is not null").select("_row", "depth", "origin").unionByName(alone)
    return links.groupBy("_row").agg(F.array_sort(F.collect_set("origin")).alias("quotes"), F.max(F.struct((-F.col("depth")).alias("d"), "origin"))["origin"].alias("quoted"))


def _talk(m: DataFrame) -> DataFrame:
    """``(_row, conv_id, turn, _own)``: what the messages of conversations with quote marks say themselves, line by line."""
    talk = m.join(m.where("_quoting and conv_id is not null").select("conv_id").distinct(), "conv_id", "left_semi").where("turn is not null")
    talk = talk.select("_row", "conv_id", "turn", "_quoting", lines_of(F.col("text")).alias("_lines"))
    own = F.transform(F.filter("_lines", lambda x: (x["depth"] == 0) & ~(x["credit"] & F.col("_quoting"))), lambda x: x["norm"])
    return materialise(talk.select("_row", "conv_id", "turn", own.alias("_own")), "talk")


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """``(conv_id, turn, role, content, n_quoted, max_depth, quotes, reply_to, linked)`` for every message.

    ``content`` is the message without quotations and the lines that introduce them,
    ``n_quoted`` its number of passages, ``quotes`` the turns it quotes, ``linked``
    whether ``reply_to`` comes from a quotation. A passage quotes the latest earlier
    message that said it; if none did, each of its lines does so by itself. What quotes
    what is told by 128-bit hashes of the normalised text.

    Null and empty texts are empty messages. Rows with a null conversation or turn quote
    nothing and nothing quotes them. Rows that repeat a turn are each a row with its own
    quotations; what any of them said is said by that turn. Texts are read whole, however
    long. An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    m = materialise(m.withColumns({"_row": F.monotonically_increasing_id(), "_quoting": F.coalesce(F.col("text").rlike(_QUOTING), F.lit(False))}), "messages")

    quoting = materialise(m.where("_quoting").select("_row", "conv_id", "turn", lines_of(F.col("text")).alias("_lines")), "lines")
    quoting = materialise(quoting.select("_row", "conv_id", "turn", passages_of(F.col("_lines")).alias("_passages")), "quoting")
    # without a quotation there is nothing to look up, and only conversations with quote marks are parsed
    links = quoting.select("_row", F.array().cast("array<long>").alias("quotes"), F.lit(None).cast("long").alias("quoted")) if quoting.isEmpty() else _links(quoting, _talk(m))
    counts = quoting.select("_row", F.size("_passages").cast("long").alias("n_quoted"), F.coalesce(F.array_max(F.transform("_passages", lambda x: x["depth"])), F.lit(0)).alias("max_depth"))

    kept = F.filter(F.split("text", _LINES), lambda x: ~x.rlike(_MARKS) & ~x.rlike(_CREDIT))
    content = F.when(F.col("_quoting"), F.array_join(kept, "\n")).otherwise(F.coalesce("text", F.lit("")))
    turns = m.select("conv_id", "turn").where("conv_id is not null and turn is not null")
    previous = latest_before(turns, turns, ["conv_id"], "previous")
    out = m.select("_row", "conv_id", "turn", "role", F.regexp_replace(content, r"^\s+|\s+$", "").alias("content")).join(previous, ["conv_id", "turn"], "left")
    out = out.join(counts, "_row", "left").join(links, "_row", "left")
    return out.select("conv_id", "turn", "role", "content", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"), F.coalesce("quotes", F.array().cast("array<long>")).alias("quotes"), F.coalesce("quoted", "previous").alias("reply_to"), F.col("quoted").isNotNull().alias("linked"))


# --------------------------------------------------------------------------
# reply order
# --------------------------------------------------------------------------


def _walked(segments: DataFrame) -> DataFrame:
    """``(conv_id, at, place, level)`` for the trees ``segments (conv_id, at, parent, n)`` of ``n`` messages each.

    A walk goes down into each segment, through its children in order, and up again. Every
    step points to the next one; pointers are doubled until all reach the end, and what
    they pass over adds up: messages, and how deep they stand.
    """
    child = segments.where("parent is not null")
    family = child.select("conv_id", "parent", (-F.col("at")).alias("turn"))
    later = latest_before(family, family, ["conv_id", "parent"], "next").select("conv_id", (-F.col("turn")).alias("at"), (-F.col("next")).alias("sibling"))
    first = child.groupBy("conv_id", F.col("parent").alias("at")).agg(F.min(F.col("at")).alias("child"))
    rows = segments.join(first, ["conv_id", "at"], "left").join(later, ["conv_id", "at"], "left")
    down = F.struct((F.col("at") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("at") * 2 + 1).alias("to"), F.col("n").alias("w"), F.col("n").alias("d"))
    up = F.struct((F.col("at") * 2 + 1).alias("step"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("w"), (-F.col("n")).alias("d"))
    steps = materialise(rows.select("conv_id", F.explode(F.array(down, up)).alias("x")).select("conv_id", "x.*"), "steps")
    while not steps.where("to is not null").isEmpty():
        ahead = steps.select("conv_id", F.col("step").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("d").alias("_d"))
        moved = steps.join(ahead, ["conv_id", "to"], "left")
        steps = materialise(moved.select("conv_id", "step", F.col("_to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")), "steps")
    total = steps.where("step % 2 = 0").groupBy("conv_id").agg(F.max("w").alias("total"))
    return steps.where("step % 2 = 0").join(total, "conv_id").select("conv_id", (F.col("step") / 2).cast("long").alias("at"), (F.col("total") - F.col("w")).alias("place"), (-F.col("d")).alias("level"))


def reply_order(rows: DataFrame) -> DataFrame:
    """``rows (conv_id, turn, reply_to, linked, ...)`` with ``level`` and ``place``.

    ``level`` counts the messages that a message replies to, one after the other;
    ``place`` is its place in the conversation, from 0: a message, then all that replies
    to it, thread by thread in the order of turns. A turn that rows repeat is one place,
    and replies to the latest that one of them quotes. Both are null where the
    conversation or the turn is.

    Messages of which each replies to the one before it, alone, are one segment; only
    the tree of segments is walked.
    """
    rows = materialise(rows, "replies")
    known = rows.where("conv_id is not null and turn is not null")
    nodes = known.groupBy("conv_id", "turn").agg(F.max(F.struct("linked", "reply_to"))["reply_to"].alias("parent"))
    nodes = materialise(_counted(nodes, "rank"), "ranked")
    ranks = nodes.select("conv_id", F.col("turn").alias("parent"), F.col("rank").alias("parent_rank"))
    kids = nodes.groupBy("conv_id", "parent").agg(F.count(F.lit(1)).alias("kids"))
    tree = materialise(nodes.join(ranks, ["conv_id", "parent"], "left").join(kids, ["conv_id", "parent"], "left"), "tree")
    tree = tree.withColumn("opens", F.coalesce((F.col("kids") > 1) | (F.col("parent_rank") != F.col("rank") - 1), F.lit(True)))
    opens = tree.where("opens").select("conv_id", F.col("rank").alias("turn"))
    inside = latest_before(opens, tree.select("conv_id", (F.col("rank") + 1).alias("turn")), ["conv_id"], "segment")
    inside = materialise(inside.select("conv_id", (F.col("turn") - 1).alias("rank"), "segment"), "segments")
    sizes = inside.groupBy("conv_id", F.col("segment").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    heads = tree.where("opens").select("conv_id", F.col("rank").alias("at"), F.col("parent_rank").alias("rank"))
    heads = heads.join(inside.withColumnRenamed("segment", "parent"), ["conv_id", "rank"], "left").select("conv_id", "at", "parent").join(sizes, ["conv_id", "at"])
    forks = heads.where("parent is not null").select("conv_id").distinct()
    walked = _walked(heads.join(forks, "conv_id", "left_semi")).withColumnRenamed("at", "segment")
    placed = nodes.select("conv_id", "turn", "rank").join(inside, ["conv_id", "rank"]).join(walked, ["conv_id", "segment"], "left")
    offset = F.col("rank") - F.col("segment")
    placed = placed.select("conv_id", "turn", (F.coalesce("level", F.lit(0)) + offset).alias("level"), (F.coalesce("place", F.lit(0)) + offset).alias("place"))
    return rows.join(placed, ["conv_id", "turn"], "left").select(*rows.columns, "level", "place")


def conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """All messages as ``linked`` and ``reply_order`` give them: one row each, so that a conversation of any size is no single task's."""
    return reply_order(linked(messages, **columns))


def _oracle(table: str) -> str:
    return rf"""
m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS raw FROM {table}),
q AS (SELECT *, regexp_matches(text, '(?m)^[ \t]*>') AS quoting FROM m),
l AS (SELECT conv_id, turn, quoting, unnest(raw) AS raw, generate_subscripts(raw, 1) AS n FROM q WHERE conv_id IN (SELECT conv_id FROM q WHERE quoting)),
d AS (SELECT conv_id, turn, n, len(replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]*)+)', 1), ' ', '')) AS depth, quoting AND regexp_matches(raw, '^(On .* wrote:|.* (wrote|schrieb|escribió|a écrit) ?:)[ \t]*$') AS credit,
             trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*((?:>[ \t]*)+)', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM l),
e AS (SELECT * FROM d WHERE norm <> ''),
r AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY conv_id, turn ORDER BY n) THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY n) AS passage FROM r),
p AS (SELECT conv_id, turn, passage, depth, list(norm ORDER BY n) AS norms FROM g WHERE depth > 0 GROUP BY ALL),
o AS (SELECT conv_id, turn, list(norm ORDER BY n) AS own FROM e WHERE depth = 0 AND NOT credit GROUP BY ALL),
w AS (SELECT conv_id, turn, own, unnest(range(1, len(own) + 1)) AS a FROM o),
s AS (SELECT conv_id, turn, unnest(list_transform(range(a, len(own) + 1), lambda b: array_to_string(own[a:b], ' '))) AS norm FROM w),
a AS (SELECT p.conv_id, p.turn, p.passage, any_value(p.depth) AS depth, any_value(p.norms) AS norms, max(s.turn) AS origin
      FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s.norm = array_to_string(p.norms, ' ') AND s.turn < p.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, depth, unnest(norms) AS norm FROM a WHERE origin IS NULL),
k AS (SELECT conv_id, turn, list_sort(list(DISTINCT origin)) AS quotes, arg_max(origin, (-depth, origin)) AS quoted FROM (
        SELECT conv_id, turn, depth, origin FROM a WHERE origin IS NOT NULL
        UNION ALL SELECT b.conv_id, b.turn, b.depth, max(s.turn) FROM b JOIN s ON s.conv_id = b.conv_id AND s.norm = b.norm AND s.turn < b.turn GROUP BY b.conv_id, b.turn, b.depth, b.norm) GROUP BY ALL),
c AS (SELECT conv_id, turn, count(*) AS n_quoted, max(depth) AS max_depth FROM p GROUP BY ALL),
z AS (SELECT q.conv_id, q.turn, q.role,
       regexp_replace(CASE WHEN quoting THEN array_to_string(list_filter(q.raw, lambda x: NOT regexp_matches(x, '^[ \t]*>') AND NOT regexp_matches(x, '^(On .* wrote:|.* (wrote|schrieb|escribió|a écrit) ?:)[ \t]*$')), chr(10)) ELSE q.text END, '^\\s+|\\s+$', '', 'g') AS content,
       coalesce(c.n_quoted, 0)::BIGINT AS n_quoted, coalesce(c.max_depth, 0)::INTEGER AS max_depth, coalesce(k.quotes, []::BIGINT[]) AS quotes,
       coalesce(k.quoted, max(q.turn) OVER (PARTITION BY q.conv_id ORDER BY q.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reply_to, k.quoted IS NOT NULL AS linked
      FROM q LEFT JOIN c ON c.conv_id = q.conv_id AND c.turn = q.turn LEFT JOIN k ON k.conv_id = q.conv_id AND k.turn = q.turn),
t AS (SELECT conv_id, turn, [turn] AS path FROM z WHERE reply_to IS NULL UNION ALL SELECT z.conv_id, z.turn, list_append(t.path, z.turn) FROM t JOIN z ON z.conv_id = t.conv_id AND z.reply_to = t.turn)
SELECT z.*, (len(path) - 1)::BIGINT AS level, (row_number() OVER (PARTITION BY z.conv_id ORDER BY path) - 1)::BIGINT AS place FROM z JOIN t ON t.conv_id = z.conv_id AND t.turn = z.turn
"""


ORACLE = f"WITH RECURSIVE {_oracle('conversations')}"
#: Every other message quotes the one two turns before it, and that one's first line in the one before it.
REPLIES = r"""
v AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS one, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS two FROM conversations),
quoted AS (SELECT conv_id, turn, role, CASE WHEN two IS NOT NULL AND turn % 2 = 0 THEN '> ' || replace(two, chr(10), chr(10) || '> ') || chr(10) || '>> ' || split_part(one, chr(10), 1) || chr(10) || text
                                            WHEN two IS NOT NULL AND turn % 3 = 0 THEN 'On Monday, A wrote:' || chr(10) || '> ' || split_part(two, chr(10), 1) || chr(10) || '> ' || one || chr(10) || text ELSE text END AS text FROM v)
"""
ORACLE_OF_REPLIES = f"WITH RECURSIVE {REPLIES}, {_oracle('quoted')}"
