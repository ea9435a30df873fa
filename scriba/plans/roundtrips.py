"""Queries that write files of a table to shared storage and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.functions import tables
from scriba.operators import jobs, subtitles
from scriba.plans.jobs import COUNTERS, job_events
from scriba.plans.registry import query, table
from scriba.plans.scoring import PAIRS, pairs
from scriba.plans.signals import SESSIONS
from scriba.plans.subtitles import SEGMENTS, STAMP, segments
from scriba.scratch import scratch_dir
from scriba.sources import documents, files, pcm, sinks
from scriba.sources.scripted import scripted_events
from scriba.streaming import jobs as streams


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex[:12]}/{name}"


def _written(rows: DataFrame, name: str) -> str:
    """The folder with a file for each of ``rows (name, content)``."""
    at = _folder(rows.sparkSession, name)
    sinks.write_rendered(rows, at).count()
    return at


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, each with a name of two words and a few more; a file each in what follows, so their number grows with the tables."""
    key = F.col("s_suppkey")
    named = table(spark, sf_dir, "supplier").select(key.alias("n_nationkey"), F.concat(F.lit("SUPPLIER "), key.cast("string")).alias("n_name"), (F.col("s_nationkey") % 5).alias("n_regionkey"))
    return named.withColumn("n_comment", F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")))


def _documents(spark: SparkSession, sf_dir: str, content: str, name: str = "concat('d', n_nationkey, '.json')") -> str:
    return _written(_nations(spark, sf_dir).select(F.expr(name).alias("name"), F.expr(content).alias("content")), "documents")


@query("SELECT 'customers' AS dataset, (row_number() OVER (ORDER BY c_custkey))::INTEGER AS line, c_custkey::VARCHAR AS utt_id, 'customers/wav/' || c_custkey || '.wav' AS path, c_name || chr(9) || c_mktsegment AS reference FROM customer")
def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest whose references hold a tab."""
    key = F.col("c_custkey").cast("string")
    lines = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.concat_ws("\t", key, F.concat(F.lit("wav/"), key, F.lit(".wav")), "c_name", "c_mktsegment").alias("value"))
    at = _folder(spark, "customers")
    lines.coalesce(1).write.text(at)
    return files.read_manifest(spark, at).withColumn("path", F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1))


@query(r"""SELECT printf('%06d', row_number() OVER (ORDER BY doc_id) - 1) AS id, octet_length(encode(source)) AS n, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS reference FROM documents WHERE doc_id % 7 <> 0 AND trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''""")
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has no bytes."""
    audio = F.struct(F.when(F.col("doc_id") % 7 != 0, F.encode("source", "utf-8")).alias("bytes"))
    rows = table(spark, sf_dir, "documents").select("doc_id", audio.alias("audio"), F.col("text").alias("original_text"), F.lit("x").alias("answer"))
    return files.audio_corpus(rows, "doc_id").select("id", F.octet_length("bytes").cast("long").alias("n"), "reference")


_NATION = "(SELECT s_suppkey AS n_nationkey, 'SUPPLIER ' || s_suppkey AS n_name, s_nationkey % 5 AS n_regionkey FROM supplier)"
_NAME = "concat(n_name, case n_nationkey % 3 when 0 then '.WAV' when 1 then '.part' else '.txt' end)"
_NAME_SQL = "n_name || CASE n_nationkey % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.part' ELSE '.txt' END"


@query(f"SELECT {_NAME_SQL} AS name, octet_length(encode(n_comment)) AS size, true AS known FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION})")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _documents(spark, sf_dir, "n_comment", _NAME)
    rows = files.identified(files.list_files(spark, at))
    return rows.select(F.regexp_replace("name", "%20", " ").alias("name"), "size", (F.split("key", r"\|")[1].cast("long") == F.col("size")).alias("known"))


@query(f"SELECT {_NAME_SQL} AS name FROM {_NATION} WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'odd.xyz'")
def inputs_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio below a folder, named twice, and a file by its name."""
    at = _documents(spark, sf_dir, "n_comment", _NAME)
    return files.expand_inputs(spark, [at, at], ["odd.xyz", "odd.xyz"]).select(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "%20", " ").alias("name"))


@query(f"SELECT {_NAME_SQL} AS name, octet_length(encode(n_comment)) AS size FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION}) WHERE n_nationkey % 3 = 1")
def partial_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.partial_files(spark, _documents(spark, sf_dir, "n_comment", _NAME)).select(F.regexp_replace("name", "%20", " ").alias("name"), "size")


_SEGMENT = "named_struct('id', n_nationkey, 'start', named_struct('secs', n_nationkey, 'nanos', 5), 'end', named_struct('secs', n_nationkey + 1, 'nanos', 0), 'text', n_name)"


@query(f"SELECT 'd' || n_nationkey AS key, n_name AS text, n_nationkey::BIGINT AS secs, 5 AS nanos, n_regionkey / 2 AS voiced, n_regionkey % 2 = 0 AS recovered FROM {_NATION} WHERE n_nationkey % 4 NOT IN (0, 3)")
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth entry is of another version, and every fourth is cut."""
    entry = f"to_json(named_struct('version', if(n_nationkey % 4 = 0, 2, 1), 'transcript', named_struct('segments', array({_SEGMENT}), 'language', 'en'), 'coverage', named_struct('decoded_seconds', 9.5D, 'voiced_seconds', n_regionkey / 2, 'energetic_seconds', 1.0D), 'recovered', n_regionkey % 2 = 0))"
    at = _documents(spark, sf_dir, f"if(n_nationkey % 4 = 3, left({entry}, 40), {entry})")
    rows = files.read_cache(spark, at).withColumn("s", F.col("transcript.segments")[0])
    return rows.select("key", "s.text", "s.start.secs", "s.start.nanos", F.col("coverage.voiced_seconds").alias("voiced"), "recovered")


@query(f"SELECT n_nationkey::VARCHAR AS span, n_nationkey + 100 AS id FROM {_NATION}")
def resume_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second record of a span counts, and a cut line doesn't."""
    line = "to_json(named_struct('span', string(n_nationkey), 'segments', array(named_struct('id', n_nationkey + {}, 'text', n_name))))"
    at = _documents(spark, sf_dir, f"concat_ws('\\n', {line.format(0)}, {line.format(100)}, '{{\"span\": \"x\", \"seg')", "concat('run-', n_nationkey, '.jsonl')")
    return files.read_resume_log(spark, at).select("span", F.col("segments")[0]["id"].alias("id"))


@query(f"SELECT n_name AS input, n_comment AS output, n_nationkey * 10 AS finished_at_ms FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION}) WHERE n_nationkey % 4 <> 0")
def history_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _documents(spark, sf_dir, "to_json(named_struct('version', if(n_nationkey % 4 = 0, 7, 1), 'entries', array(named_struct('input', n_name, 'output', n_comment, 'engine', 'e', 'finished_at_ms', n_nationkey * 10))))")
    return files.read_history(spark, at).select("input", "output", "finished_at_ms")


@query(f"SELECT n_name AS source, n_comment AS output FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION})")
def ownership_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_ownership(spark, _documents(spark, sf_dir, "to_json(named_struct('version', 1, 'outputs', map(n_name, n_comment)))"))


@query(f"SELECT n_nationkey % 2 AS pos, n_name AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'quit' ELSE 'tray' END AS close FROM {_NATION}")
def settings_and_pending_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of files that waits, beside how its window is closed."""
    waiting = _documents(spark, sf_dir, "to_json(named_struct('version', 1, 'files', if(n_nationkey % 2 = 0, array(n_name), array('-', n_name)), 'engine', n_name))")
    chosen = files.read_settings(spark, _documents(spark, sf_dir, "to_json(named_struct('version', 1, 'close', if(n_nationkey % 2 = 0, 'quit', 'tray')))")).distinct()
    rows = files.read_pending(spark, waiting).where("path <> '-'").select("pos", "path")
    return rows.join(chosen, (F.col("pos") == 1) == (F.col("close") == "tray"))


@query("SELECT 'm' || r_regionkey AS id, r_name AS display_name, CASE WHEN r_regionkey > 0 THEN ['m0'] ELSE [] END AS requires, 'f' || r_regionkey AS local, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END::BIGINT AS size, 'https://' || r_regionkey AS base_url FROM region")
def catalogue_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.expr("""named_struct('id', concat('m', r_regionkey), 'display_name', r_name, 'description', '', 'files', array(named_struct('remote', 'r', 'local', concat('f', r_regionkey), 'size', if(r_regionkey % 2 = 0, r_regionkey, null))),
      'requires', if(r_regionkey > 0, array('m0'), array()), 'mirrors', array(named_struct('name', 'a', 'base_url', concat('https://', r_regionkey), 'repo', 'x')))""")
    rows = table(spark, sf_dir, "region").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(model).alias("models"))).alias("content"))
    models, parts, mirrors = files.read_catalogue(spark, _written(rows.select(F.lit("c.json").alias("name"), "content"), "catalogue"))
    return models.join(parts, "id").join(mirrors, "id").select("id", "display_name", "requires", "local", "size", "base_url")


@query(f"SELECT n_name || '.txt' AS file, n_comment || chr(10) || '  ' || n_name || chr(10) AS vocabulary FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION})")
def vocabulary_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _documents(spark, sf_dir, "concat(n_comment, '\\n  ', n_name, '\\n')", "concat(n_name, '.txt')")
    return files.source("vocabulary")(spark, at).withColumn("file", F.regexp_replace("file", "%20", " "))


@query(f"SELECT n_name || '.srt' AS name, octet_length(encode(n_comment)) AS bytes, n_comment AS content FROM (SELECT *, n_name || ' ' || n_regionkey AS n_comment FROM {_NATION})")
def rendered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer says of its files, beside what is in them."""
    at = _folder(spark, "rendered")
    said = sinks.write_rendered(_nations(spark, sf_dir).select(F.concat("n_name", F.lit(".srt")).alias("name"), F.col("n_comment").alias("content")), at)
    said = spark.createDataFrame(said.collect(), said.schema)  # a row for each nation
    there = spark.read.text(at, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), "%20", " ").alias("name"), F.col("value").alias("content"))
    return said.join(there, "name")


@query("SELECT o_custkey AS span, arg_min(o_orderkey, (o_orderkey % 3, o_orderkey)) AS seq FROM orders GROUP BY o_custkey")
def log_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the second one twice; the first record of a span stays."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("span"), F.col("o_orderkey").alias("seq"))
    at = _folder(spark, "log")
    for n in (0, 1, 1, 2):
        sinks.append_log(rows.where(F.col("seq") % 3 == n), at, "span", number=n)
    return sinks.read_log(spark, at, rows.schema)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey")
def table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is replaced by what is read from it."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    at = _folder(spark, "replaced")
    sinks.replace_table(rows, at)
    sinks.replace_table(sinks.current_table(spark, at, rows.schema).where("o_orderkey % 2 = 0"), at)
    return sinks.current_table(spark, at, rows.schema).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_name AS input, n_nationkey + 25 AS finished_at_ms FROM {_NATION} ORDER BY n_nationkey DESC LIMIT 10")
def autosaved_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript is saved twice; ten entries are kept."""
    rows = _nations(spark, sf_dir).select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.col("n_comment").alias("content"), F.col("n_name").alias("input"), F.col("n_name").alias("output"), F.lit("e").alias("engine"), F.col("n_nationkey").cast("long").alias("finished_at_ms"))
    at = _folder(spark, "autosave")
    for n in (0, 25):
        sinks.autosave(rows.withColumn("finished_at_ms", F.col("finished_at_ms") + n), f"{at}/out", f"{at}/history", keep=10)
    return sinks.current_table(spark, f"{at}/history", "input string, output string, engine string, finished_at_ms long").select("input", "finished_at_ms")


@query("SELECT j AS job, 'done' AS state, 12::BIGINT AS segments FROM unnest(range(1, 41)) AS t(j)")
def scripted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.outcomes(scripted_events(spark, 40)).select("job", "state", "segments")


@query("""WITH x AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
s AS (SELECT label, k * 64 + unnest(range(0, 64)) AS q, unnest(embedding)::DOUBLE AS v FROM x)
SELECT label::VARCHAR AS file, (q // 1600)::BIGINT AS seq, (q // 1600 * 1600)::BIGINT AS start, count(*) AS n, round(sum(v), 4) AS total FROM s GROUP BY ALL""")
def pcm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as the samples of a file, in the order of their ids."""
    at = _folder(spark, "pcm")

    def run(key: tuple, pdf):  # noqa: ANN001, ANN202
        import numpy as np
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(at)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{key[0]}.f32") as out:
            for x in pdf.sort_values("vec_id")["embedding"]:
                out.write(np.asarray(x, dtype="<f4").tobytes())
        return pdf[["label"]].head(1)

    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    rows.groupBy("label").applyInPandas(run, rows.select("label").schema).count()
    pcm.register(spark)
    chunks = spark.read.format("pcm").load(at)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return chunks.select(F.regexp_extract("file_id", r"([^/]+)\.f32$", 1).alias("file"), "seq", "start", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"))


# -- documents and lines ---------------------------------------------------


@query(f"""WITH {SEGMENTS} SELECT file_id || '.srt' AS name, string_agg(cue || chr(10) || {STAMP.format("start_ms")} || ' --> ' || {STAMP.format("end_ms")} || chr(10) || shown || chr(10) || chr(10), '' ORDER BY cue) AS content FROM q GROUP BY file_id
UNION ALL SELECT file_id || '.txt', regexp_replace(string_agg(text, chr(10) ORDER BY seg_id), '^\\n+', '') || CASE WHEN max(length(text)) > 0 THEN chr(10) ELSE '' END FROM g GROUP BY file_id""")
def documents_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtitle file and a text for each conversation, as they are in the folder after both jobs."""
    at, rows = _folder(spark, "documents"), segments(spark, sf_dir)
    documents.write_subtitles(rows, at)
    documents.write_transcripts(rows, at)
    return spark.read.text(at, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


@query("SELECT 'o' || o_custkey % 20 || '.txt' AS file, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS line, o_orderkey || ' ' || o_orderpriority AS value FROM orders")
def lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the lines of twenty files, which are read in ranges of bytes."""
    at = _folder(spark, "lines")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), (F.col("o_custkey") % 20).cast("string")).alias("file_id"), F.col("o_orderkey").alias("seg_id"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("text"))
    documents.write_transcripts(rows, at)
    return files.read_lines(spark, at).withColumn("file", F.regexp_extract("file", "([^/]*)$", 1))


@query(f"WITH {SEGMENTS} SELECT file_id, (cue - 1)::INTEGER AS seg_id, start_ms, end_ms, shown AS text FROM q")
def subtitles_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle documents and their cues, in SQL alone."""
    tables.register(spark)
    subtitles.to_srt(segments(spark, sf_dir)).createOrReplaceTempView("scriba_documents")
    return spark.sql("SELECT file_id, seg_id, start_ms, end_ms, text FROM scriba_documents, LATERAL parse_srt(srt)")


@query(f"WITH {PAIRS} SELECT utt_id, errors FROM s")
def alignments_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each pair's alignment that aren't a match, in SQL alone; a pair of empty texts has no step."""
    tables.register(spark)
    pairs(spark, sf_dir).createOrReplaceTempView("scriba_pairs")
    return spark.sql(r"""
        WITH n AS (SELECT utt_id, lower(regexp_replace(reference, '[^\\p{IsAlphabetic}\\p{N}]', '')) AS r, lower(regexp_replace(hypothesis, '[^\\p{IsAlphabetic}\\p{N}]', '')) AS h FROM scriba_pairs)
        SELECT utt_id, count_if(step IS NOT NULL AND NOT ref_char <=> hyp_char) AS errors FROM n LEFT JOIN LATERAL align_chars(r, h) GROUP BY utt_id""")


# -- streams ---------------------------------------------------------------


@query(f"""WITH {SESSIONS} SELECT file_id AS job, "start", "end" + INTERVAL 6 HOUR AS "end", frames FROM s""")
def stream_sessions_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions, those that are still open too."""
    frames = job_events(streams.read_events(spark, sf_dir)).where("position >= 20").select("job", "ts")
    out = streams.snapshot(streams.drain(streams.speech_sessions(frames, "6 hours"), "sessions", "complete"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"{COUNTERS} SELECT c.job, segments, round(position, 6) AS position, last_seq FROM c LEFT JOIN p ON p.job = c.job")
def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then the rest by a stream that goes on from its checkpoint."""
    rows, at = table(spark, sf_dir, "events"), _folder(spark, "restart")
    middle = rows.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    out = None
    for n, part in enumerate((rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle))):
        part.write.parquet(f"{at}/in/n={n}")
        stream = streams.live_counters(job_events(streams.read_events(spark, f"{at}/in/*", "*.parquet")))
        out = streams.drain(stream, "restart", "update", at)
    return streams.latest_updates(out, "job").select("job", "segments", F.round("position", 6).alias("position"), "last_seq")


@query(f"{COUNTERS}, n AS (SELECT kind, count(*) AS n FROM e GROUP BY kind) SELECT kind, n, (SELECT count(*) FROM c) AS jobs FROM n")
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams over one source: events of each kind, and jobs."""
    def events() -> DataFrame:
        return job_events(streams.read_events(spark, sf_dir))

    kinds = streams.latest_updates(streams.drain(events().groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kinds", "update"), "kind")
    counts = streams.latest_updates(streams.drain(streams.live_counters(events()), "jobs", "update"), "job").agg(F.count(F.lit(1)).alias("jobs"))
    return kinds.join(F.broadcast(counts))  # one row
