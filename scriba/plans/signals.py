"""Signal queries: slices of embeddings stand for samples, labels for files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.functions import engines
from scriba.functions.digests import span_key
from scriba.operators import recognition, signal
from scriba.plans.registry import query, table
from scriba.scratch import scratch_dir
from scriba.sources.sinks import append_log

#: Eight windows of eight samples; their loudness differs less than that of audio.
SIZE, RANGE_DB = 8, 6.0


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    return signal.windows_of(chunks, SIZE)


WINDOWS = """
b AS (SELECT label AS file_id, vec_id AS seq, unnest(range(0, 8)) AS "window", embedding FROM embeddings),
w AS (SELECT file_id, seq, "window"::INTEGER AS "window", 8::BIGINT AS n, sqrt(list_sum(list_transform(embedding["window" * 8 + 1:"window" * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8) AS rms FROM b)
"""
ENERGETIC = f"""{WINDOWS},
e AS (SELECT *, max(rms) OVER (PARTITION BY file_id) AS peak FROM w),
g AS (SELECT *, peak >= 1e-3 AND rms >= peak * pow(10, -6.0 / 20) AS energetic FROM e)
"""


@query(f'WITH {WINDOWS} SELECT file_id, seq, "window", n, round(rms, 9) AS rms FROM w')
def rms_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("rms", F.round("rms", 9))


@query(f"WITH {ENERGETIC} SELECT file_id, sum(n)::BIGINT AS decoded, round(max(peak), 9) AS peak, sum(CASE WHEN energetic THEN n ELSE 0 END)::BIGINT AS energetic FROM g GROUP BY file_id")
def energetic_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = signal.energetic(_windows(spark, sf_dir), range_db=RANGE_DB)
    return loud.groupBy("file_id").agg(F.sum("n").alias("decoded"), F.round(F.max("peak"), 9).alias("peak"), F.sum(F.when(F.col("energetic"), F.col("n")).otherwise(0)).alias("energetic"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments stand for spans: from the ship date on, as many days as pieces."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return rows.agg(F.min(F.unix_date(F.col("l_shipdate").cast("date"))).cast("long").alias("start"), F.sum("l_quantity").cast("long").alias("n"))


SPANS = """
p AS (SELECT l_suppkey AS file_id, l_orderkey * 10 + l_linenumber AS seq, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS s, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL),
h AS (SELECT *, coalesce(max(s + n) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark FROM p),
v AS (SELECT file_id, sum(greatest(0, s + n - greatest(s, mark)))::BIGINT AS voiced, sum(n)::BIGINT AS all_n FROM h GROUP BY file_id)
"""


@query(f"WITH {SPANS} SELECT file_id, voiced FROM v")
def voiced_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.union_length(_spans(spark, sf_dir))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced days by supplier against a tenth of all pieces shipped; none for every ninth supplier."""
    spans = _spans(spark, sf_dir)
    pieces = spans.groupBy("file_id").agg(F.sum("n").alias("all_n"))
    energetic = F.when(F.col("file_id") % 9 == 0, 0.0).otherwise(F.col("all_n") / 10)
    return signal.union_length(spans).join(pieces, "file_id").select("file_id", "voiced", energetic.alias("energetic"))


COVERAGE = f"{SPANS}, c AS (SELECT file_id, voiced, CASE WHEN file_id % 9 = 0 THEN 0 ELSE all_n / 10 END::DOUBLE AS energetic FROM v), r AS (SELECT *, CASE WHEN energetic > 0 THEN least(voiced / energetic, 1) END AS ratio FROM c)"


@query(f"WITH {COVERAGE} SELECT file_id, round(ratio, 9)::DOUBLE AS ratio FROM r")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("file_id", F.round(signal.coverage_ratio("voiced", "energetic"), 9).alias("ratio"))


@query(f"WITH {COVERAGE} SELECT file_id, CASE WHEN energetic < 1 THEN false ELSE coalesce(ratio < 0.7, false) END AS recover FROM r")
def guard_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("file_id", signal.should_recover("voiced", "energetic").alias("recover"))


@query("""WITH t AS (SELECT conv_id AS file_id, sum(length(text) * 80)::BIGINT AS total FROM conversations GROUP BY conv_id),
b AS (SELECT file_id, total, unnest(range(0, (total - 1) // 20000 + 1)) AS block FROM t WHERE total > 0)
SELECT file_id, block, block * 20000 AS start, least(20000, total - block * 20000) AS n FROM b""")
def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.length("text") * 80).cast("long").alias("n"))
    return signal.fixed_blocks(chunks, 20_000)


@query("""SELECT conv_id AS file_id, turn AS seq, length(text)::BIGINT AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations""")
def chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.chunk_starts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("n")))


def _two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.col("text").alias("text"))
    first = turns.where("seq % 2 = 0")
    kept = turns.groupBy("file_id").agg(F.sum(F.when(F.col("seq") % 2 == 0, F.length("text")).otherwise(0)).alias("voiced"), F.sum(F.length("text")).cast("double").alias("energetic"))
    verdicts = kept.select("file_id", signal.should_recover("voiced", "energetic").alias("recovered"))
    return signal.two_pass(first, turns, verdicts)


@query("""WITH k AS (SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END) / sum(length(text)) < 0.7 AS recovered FROM conversations GROUP BY conv_id),
s AS (SELECT c.conv_id AS file_id, c.turn AS seq, c.text, k.recovered FROM conversations c JOIN k ON k.conv_id = c.conv_id WHERE k.recovered OR c.turn % 2 = 0)
SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1)::INTEGER AS seg_id FROM s WHERE length(text) > 0""")
def two_pass_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass keeps every other turn; where that is too little, all turns are read again."""
    return signal.segments_of(_two_pass(spark, sf_dir))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "ts", F.col("value").alias("score"))
    return signal.gap_sessions(frames, threshold=20.0, gap="6 hours")


SESSIONS = """
f AS (SELECT user_id AS file_id, ts FROM events WHERE value >= 20),
o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY file_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
s AS (SELECT file_id, min(ts) AS "start", max(ts) AS "end", count(*) AS frames FROM i GROUP BY file_id, k)
"""


@query(f'WITH {SESSIONS} SELECT file_id, "start", "end", frames FROM s')
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@query(f"""WITH {SESSIONS}, q AS (SELECT file_id, epoch("start")::DOUBLE AS s, epoch("end")::DOUBLE AS e FROM s), l AS (SELECT *, unnest(range(0, greatest(ceil((e - s) / 14400)::BIGINT - 1, 0) + 1)) AS part FROM q WHERE e - s >= 1800)
SELECT file_id, part::INTEGER AS part, greatest(s + part * 14400 - CASE WHEN part = 0 THEN 600 ELSE 0 END, 0)::DOUBLE AS span_start, least(e, s + part * 14400 + 14400)::DOUBLE AS span_end FROM l""")
def pad_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of half an hour and more, in parts of four hours at most, with ten minutes before the first."""
    rows = _sessions(spark, sf_dir).withColumns({f"{c}_s": F.col(c).cast("timestamp").cast("double") for c in ("start", "end")})
    spans = signal.speech_spans(rows, shortest=1800.0, longest=14_400.0, pad=600.0)
    return spans.select("file_id", "part", "span_start", "span_end")


@query("""WITH l AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, CASE WHEN before IS NULL THEN 64 ELSE 72 END AS n, round(list_sum(list_transform(list_concat(coalesce(before[57:64], []), embedding), lambda x: x::DOUBLE)), 6) AS total FROM l""")
def pad_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    total = F.aggregate("padded", F.lit(0.0), lambda a, x: a + x)
    return signal.padded(rows, 8).select(F.col("seq").alias("vec_id"), F.size("padded").alias("n"), F.round(total, 6).alias("total"))


# -- frames ----------------------------------------------------------------

#: Chunks have 64 samples, so a frame of 24 often has parts of two.
FRAME, LOUD = 24, 0.12


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, seq, start, samples``: the embeddings of a label, one after the other."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    return signal.chunk_starts(rows.withColumn("n", F.size("samples").cast("long"))).drop("n")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = signal.frames_of(_chunks(spark, sf_dir), FRAME)
    return frames.select("file_id", "frame", "start", F.size("samples").cast("long").alias("n"), signal.rms("samples").alias("score"))


FRAMES = f"""
s AS (SELECT label AS file_id, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY label),
i AS (SELECT file_id, x, unnest(range(0, (len(x) - 1) // {FRAME} + 1)) AS frame FROM s),
f AS (SELECT file_id, frame, frame * {FRAME} AS start, x[frame * {FRAME} + 1:frame * {FRAME} + {FRAME}] AS y FROM i),
q AS (SELECT file_id, frame, start, len(y)::BIGINT AS n, sqrt(list_sum(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE)) / len(y)) AS score FROM f)
"""


@query(f"WITH {FRAMES} SELECT file_id, frame, start, n, round(score, 9) AS score FROM q")
def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"""WITH {FRAMES}, t AS (SELECT file_id, start, start + n AS stop FROM q WHERE round(score, 9) >= {LOUD}),
o AS (SELECT *, CASE WHEN start - lag(stop) OVER w >= 48 THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY file_id ORDER BY start)),
k AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM o),
g AS (SELECT file_id, min(start) AS a, max(stop) AS b FROM k GROUP BY file_id, span),
p AS (SELECT file_id, a, b, unnest(range(0, (b - a - 1) // 200 + 1)) AS part FROM g)
SELECT file_id, (a + part * 200)::BIGINT AS start, least(b - a - part * 200, 200)::BIGINT AS n FROM p WHERE least(b - a - part * 200, 200) >= 48""")
def voice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are loud enough; two silent ones end a span, which has two frames at least and 200 samples at most."""
    return signal.voice_spans(_frames(spark, sf_dir).withColumn("score", F.round("score", 9)), LOUD, silence=48, shortest=48, longest=200)


@query("""WITH c AS (SELECT label AS file_id, vec_id, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS first FROM embeddings),
s AS (SELECT file_id, flatten(list(embedding ORDER BY vec_id)) AS x FROM c GROUP BY file_id),
p AS (SELECT file_id, vec_id, first + 32 AS start, first + 64 * (1 + vec_id % 30) AS seen FROM c),
k AS (SELECT p.*, greatest(start - 100, 0) AS b, CASE WHEN least(seen, len(x)) < 1344 THEN 0 ELSE 704 * ((least(seen, len(x)) - 1344) // 704 + 1) END AS kept, x FROM p JOIN s USING (file_id)),
y AS (SELECT file_id, vec_id AS span, CASE WHEN b >= kept THEN x[b + 1:start] ELSE [] END AS y FROM k)
SELECT file_id, span, len(y)::INTEGER AS n, coalesce(round(list_sum(list_transform(y, lambda v: v::DOUBLE)), 6), 0) AS total FROM y""")
def context_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples before each span, as far as a history of 640 still has them; spans are closed up to 30 chunks later."""
    chunks = _chunks(spark, sf_dir)
    spans = chunks.select("file_id", F.col("seq").alias("span"), (F.col("start") + 32).alias("start"), F.lit(32).cast("long").alias("n"), (F.col("start") + 64 * (1 + F.col("seq") % 30)).alias("seen"))
    found = signal.with_context(spans, chunks, 100, retained=640)
    context = F.coalesce("context", F.array().cast("array<float>"))
    return found.select("file_id", "span", F.size(context).alias("n"), F.round(F.aggregate(context, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# -- recognition -----------------------------------------------------------


def _loudest() -> engines.Recognise:
    """Says where a span is loudest; at every fifth place it hears nothing."""
    return lambda samples: "" if int(samples.argmax()) % 5 == 0 else f"at {int(samples.argmax())}"


#: Not registered: a query leaves the list of engines as it is.
LOUDEST = engines.Engine("loudest", "Loudest sample", _loudest)

_SPANS = """
c AS (SELECT label::VARCHAR AS file_id, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS start, embedding, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings),
t AS (SELECT file_id, start::BIGINT AS start, 64::BIGINT AS n, vec_id % 3 = 0 AS old, CASE WHEN vec_id % 3 = 0 THEN 'kept ' || vec_id WHEN top % 5 = 0 THEN '' ELSE 'at ' || top END AS text FROM c)
"""


@query(f"WITH {_SPANS} SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY start) - 1)::INTEGER AS seg_id, start, n, text, old AS reused FROM t WHERE text <> ''")
def recognised_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was stopped had recorded every third span, in other words than the engine of this one has."""
    log = f"{scratch_dir(spark)}/{uuid.uuid4().hex[:12]}/log"
    spans = _chunks(spark, sf_dir)
    before = spans.where("seq % 3 = 0").select(F.col("file_id").cast("string").alias("file_id"), span_key(F.call_function("div", F.col("start") * 1_000_000_000, F.lit(16_000).cast("long")), "samples").alias("span"), F.col("start").alias("seq"), F.concat(F.lit("kept "), F.col("seq").cast("string")).alias("text"))
    append_log(before, log, "file_id", "span", number=0)
    return recognition.recognise_spans(spans, LOUDEST, log, number=1)
