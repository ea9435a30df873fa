"""Queries of lists, queues, records and settings: orders stand for files that came one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriba.functions import digests, engines, numbers, paths, text, times
from scriba.operators import catalogue, jobs, punctuation, segmenters, signal, store, worklist
from scriba.operators import scoring as scores
from scriba.plans import catalogues, scoring
from scriba.plans.catalogues import MODELS
from scriba.plans.registry import query, table
from scriba.sources.files import TRANSCRIPT_EXTENSIONS, numbered

# -- lists -----------------------------------------------------------------


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are their list; every third customer's runs its first open one, every third's waits for a model."""
    key = F.col("o_custkey")
    order = Window.partitionBy("list", "_open").orderBy("pos")
    rows = table(spark, sf_dir, "orders").select(key.alias("list"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("in/"), (F.col("o_orderkey") % 40).cast("string")).alias("input"), (F.col("o_orderstatus") != "F").alias("_open"))
    first = F.row_number().over(order) == 1
    state = F.when(~F.col("_open"), "done").when(first & (F.col("list") % 3 == 0), worklist.RUNNING).when(first & (F.col("list") % 3 == 1), worklist.NEEDS_MODEL).otherwise(worklist.QUEUED)
    return rows.withColumn("state", state).drop("_open")


LISTED = """
o AS (SELECT o_custkey AS list, o_orderkey AS pos, 'in/' || (o_orderkey % 40) AS input, o_orderstatus <> 'F' AS open FROM orders),
f AS (SELECT list, pos, input, CASE WHEN NOT open THEN 'done' WHEN row_number() OVER (PARTITION BY list, open ORDER BY pos) = 1 AND list % 3 = 0 THEN 'running'
        WHEN row_number() OVER (PARTITION BY list, open ORDER BY pos) = 1 AND list % 3 = 1 THEN 'needs_model' ELSE 'queued' END AS state FROM o)
"""


@query(f"WITH {LISTED} SELECT list, count(*) FILTER (state <> 'done') AS pending FROM f GROUP BY list")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.pending(_listed(spark, sf_dir), "list")


@query(f"""WITH {LISTED} SELECT list, pos, state, (row_number() OVER (PARTITION BY list ORDER BY CASE state WHEN 'running' THEN 1 WHEN 'needs_model' THEN 2 ELSE 3 END, pos) - 1)::INTEGER AS place FROM f WHERE state <> 'done'""")
def unfinished_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.unfinished(_listed(spark, sf_dir)).select("list", "pos", "state", "place")


@query(f"""WITH {LISTED}, h AS (SELECT list, bool_or(state IN ('running', 'needs_model')) AS held, min(pos) FILTER (state = 'queued') AS next FROM f GROUP BY list)
SELECT f.list, pos, CASE WHEN state = 'queued' AND pos = next AND NOT held THEN 'running' ELSE state END AS state FROM f JOIN h ON h.list = f.list""")
def queue_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.advanced(_listed(spark, sf_dir)).select("list", "pos", "state")


ASKED = "k AS (SELECT l_suppkey AS list, l_orderkey AS n, min('in/' || (l_orderkey % 60)) AS input FROM lineitem GROUP BY ALL)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("list"), F.col("l_orderkey").alias("n"), F.concat(F.lit("in/"), (F.col("l_orderkey") % 60).cast("string")).alias("input")).distinct()


@query(f"WITH {LISTED}, {ASKED} SELECT list, input, min(n) AS n FROM k WHERE NOT EXISTS (FROM f WHERE f.list = k.list AND f.input = k.input) GROUP BY list, input")
def newly_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.newly_asked(_asked(spark, sf_dir), _listed(spark, sf_dir), "n", "list")


@query(f"""WITH {LISTED}, {ASKED}, g AS (SELECT list, input, min(n) AS n FROM k WHERE NOT EXISTS (FROM f WHERE f.list = k.list AND f.input = k.input) GROUP BY list, input),
w AS (SELECT DISTINCT list FROM f WHERE state = 'needs_model')
SELECT list, input, n, CASE WHEN list % 2 = 0 AND list NOT IN (FROM w) AND n = min(n) OVER (PARTITION BY list) THEN 'needs_model' ELSE 'queued' END AS state FROM g""")
def restored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of odd lists are there."""
    asked = _asked(spark, sf_dir)
    return worklist.restored(asked, _listed(spark, sf_dir), asked.select("list", (F.col("list") % 2 != 0).alias("ready")).distinct(), "n").select("list", "input", "n", "state")


@query("SELECT p_partkey, p_name AS name, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS pos FROM part QUALIFY contains(lower(p_name), lower(trim(' ' || (SELECT upper(left(p_name, 3)) FROM part WHERE p_partkey = 1) || ' ')))")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain the first three letters of the first one; each keeps its place in the whole list."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    counted = numbered(rows, "p_partkey").withColumnRenamed("number", "pos")
    needle = rows.where("p_partkey = 1").select(F.concat(F.lit(" "), F.upper(F.substring("name", 1, 3)), F.lit(" ")).alias("needle"))
    return worklist.matching(counted.join(F.broadcast(needle)), "needle").drop("needle")


@query("SELECT o_orderkey AS job, o_orderstatus AS state FROM orders ORDER BY o_orderkey DESC")
def jobs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.newest_first(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("state")))


@query("""WITH i AS (SELECT c_name AS input, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 3 = 1), o AS (SELECT s_name AS output, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier WHERE s_suppkey % 2 = 0)
SELECT pos, input, output FROM i JOIN o USING (pos)""")
def zipped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer beside every other supplier, by their places in both lists."""
    left = table(spark, sf_dir, "customer").where("c_custkey % 3 = 1").select("c_custkey", F.col("c_name").alias("input"))
    right = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_name").alias("output"))
    placed = (numbered(rows, key).withColumnRenamed("number", "pos").drop(key) for rows, key in ((left, "c_custkey"), (right, "s_suppkey")))
    return worklist.zipped(*placed).select("pos", "input", "output")


_METHODS, _PATHS = ("GET", "POST", "DELETE", "PUT"), ("/health", "/models", "/jobs", "/jobs/{}", "/jobs/{}/x", "/jobs/x{}", "/other")


@query(f"""WITH r AS (SELECT o_orderkey AS k, ({list(_METHODS)})[o_orderkey % 4 + 1] AS m, replace(({list(_PATHS)})[o_orderkey % 7 + 1], '{{}}', o_orderkey::VARCHAR) AS p FROM orders)
SELECT k AS o_orderkey, CASE WHEN regexp_full_match(p, '/jobs/[0-9]+') THEN k END AS job, CASE WHEN m = 'PUT' THEN 'unsupported' WHEN m = 'GET' AND p = '/health' THEN 'health' WHEN m = 'GET' AND p = '/models' THEN 'models' WHEN m = 'GET' AND p = '/jobs' THEN 'list'
  WHEN m = 'POST' AND p = '/jobs' THEN 'submit' WHEN m = 'GET' AND regexp_full_match(p, '/jobs/[0-9]+') THEN 'view' WHEN m = 'DELETE' AND regexp_full_match(p, '/jobs/[0-9]+') THEN 'cancel' ELSE 'unknown' END AS route FROM r""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(_METHODS, 4).alias("m"), F.replace(pick(_PATHS, 7), F.lit("{}"), key.cast("string")).alias("p"))
    return rows.select("o_orderkey", worklist.job_id("p").alias("job"), worklist.route("m", "p").alias("route"))


@query("""WITH c AS (SELECT user_id AS job, min(event_id) AS asked FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id AS job, event_id AS at FROM events LEFT JOIN c ON c.job = user_id WHERE event_type = 'click' AND (asked IS NULL OR event_id < asked)""")
def cancelled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as chunks, errors as requests to cancel."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), "event_type")
    return worklist.cancelled_after(rows.where("event_type = 'click'").drop("event_type"), rows.where("event_type = 'error'").drop("event_type"))


@query("""WITH d AS (SELECT user_id AS job, event_id AS seq, left(event_type, 2) AS text, event_type IN ('click', 'view') AS stable, max(event_id) OVER (PARTITION BY user_id) AS last FROM events)
SELECT job, coalesce(string_agg(text, '' ORDER BY seq), '') AS text FROM d WHERE stable OR seq = last GROUP BY job""")
def settled_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.settled_deltas(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 2).alias("text"), F.col("event_type").isin("click", "view").alias("stable")))


# -- records ---------------------------------------------------------------


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.concat(F.lit("out/"), (F.col("o_orderkey") % 500).cast("string")).alias("output"), F.col("o_orderkey").alias("at"))


@query("""WITH r AS (SELECT o_custkey AS source, 'out/' || (o_orderkey % 500) AS output, o_orderkey AS k, o_orderstatus <> 'F' AS new FROM orders)
SELECT source, arg_max(output, (new, k)) AS output FROM r GROUP BY source""")
def owners_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't fulfilled yet is recorded after the rest."""
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), (F.col("o_orderstatus") != "F").alias("new"))
    rows = _owned(spark, sf_dir).join(new, "at")
    return store.upserted(rows.where("not new").drop("new"), rows.where("new").drop("new"), "source", "at").select("source", "output")


@query("""WITH r AS (SELECT o_custkey AS source, 'out/' || (o_orderkey % 500) AS output FROM orders) SELECT 'out/' || p_partkey AS output, min(source) AS source FROM part LEFT JOIN r ON r.output = 'out/' || p_partkey GROUP BY ALL""")
def source_of_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.source_of(_owned(spark, sf_dir), table(spark, sf_dir, "part").select(F.concat(F.lit("out/"), F.col("p_partkey").cast("string")).alias("output")))


@query("SELECT o_custkey AS source, 'out/' || (o_orderkey % 500) AS output, o_orderkey AS at FROM orders WHERE o_orderkey % 500 IN (SELECT s_suppkey FROM supplier)")
def existing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("out/"), F.col("s_suppkey").cast("string")).alias("path"))
    return store.existing(_owned(spark, sf_dir), files)


@query("SELECT o_custkey AS source, 'out/' || (o_orderkey % 500) AS output, o_orderkey AS at, s_name AS segments FROM orders JOIN supplier ON s_suppkey = o_orderkey % 500 WHERE s_suppkey % 4 <> 0")
def readable_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth output can't be read."""
    parsed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("out/"), F.col("s_suppkey").cast("string")).alias("output"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("segments"))
    return store.readable(_owned(spark, sf_dir), parsed).select("source", "output", "at", "segments")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4, 5)")
def history_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.forget(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [1, 2, 3, 4, 5])[0]


# -- catalogue -------------------------------------------------------------


@query(f"""WITH {MODELS}, c AS (SELECT f.id, f.size, d.real IS NOT NULL AND (f.size IS NULL OR f.size = d.real) AS complete FROM f LEFT JOIN d ON d.id = f.id AND d.local = f.local)
SELECT id, CASE WHEN count(*) FILTER (NOT complete AND size IS NULL) = 0 THEN coalesce(sum(size) FILTER (NOT complete), 0) END::BIGINT AS missing_bytes FROM c GROUP BY id""")
def missing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalogues._files(spark, sf_dir)
    return catalogue.missing_bytes(files, catalogues._disk(files))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey IN (SELECT p_partkey FROM part)")
def loadable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.loadable(catalogues._models(spark, sf_dir).select("id"), table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id")))


@query("SELECT l_orderkey::VARCHAR AS id, list_sort(list(l_linenumber || '-' || l_partkey)) AS files FROM lineitem GROUP BY ALL")
def sorted_model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.listed(catalogues._files(spark, sf_dir))


@query("""SELECT l_orderkey, coalesce(sum(l_quantity)::BIGINT, 0) AS bytes, count(*) AS files FROM lineitem GROUP BY l_orderkey""")
def folder_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.usage(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("size")), "l_orderkey")


@query("""SELECT coalesce(sum(l_quantity)::BIGINT, 0) AS bytes, count(*) AS files FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 5 <> 0""")
def cleanup_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of downloads; some of them can't be removed."""
    name = F.when(F.col("l_partkey") % 3 == 0, "x.PART").otherwise("x.onnx")
    return catalogue.freed(table(spark, sf_dir, "lineitem").select(name.alias("name"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_suppkey") % 5 != 0).alias("removed")))


@query(f"""WITH {MODELS}, w AS (SELECT id, local, '' AS folder, there AND id::BIGINT % 2 = 0 AS there FROM f UNION ALL SELECT id, local, id, there FROM f),
g AS (SELECT id, folder, local, bool_or(there) AS there FROM w GROUP BY ALL), a2 AS (SELECT id, folder, bool_and(there) AS whole FROM g GROUP BY ALL), h AS (SELECT id, min(folder) AS folder FROM a2 WHERE whole GROUP BY id),
s AS (SELECT id, string_agg(local, '、' ORDER BY local) AS missing FROM g WHERE folder = '' AND NOT there GROUP BY id)
SELECT m.id, h.folder, CASE WHEN h.folder IS NULL THEN s.missing END AS missing FROM m LEFT JOIN h ON h.id = m.id LEFT JOIN s ON s.id = m.id""")
def model_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of even models are in the common folder too."""
    from scriba.sources import files as sources

    parts = catalogues._files(spark, sf_dir).groupBy("id", "local").agg(F.bool_or(F.col("l_suppkey") % 10 != 0).alias("there"))
    there = parts.where("there")
    # names hold their model's id, as the common folder holds one model's files only
    rows = parts.select("id", F.concat_ws("/", "id", "local").alias("local"))
    disk = there.select(F.col("id").alias("folder"), F.concat_ws("/", "id", "local").alias("local")).unionByName(there.where(F.col("id").cast("long") % 2 == 0).select(F.lit("").alias("folder"), F.concat_ws("/", "id", "local").alias("local")))
    out = sources.model_folder(catalogues._models(spark, sf_dir), rows, disk)
    return out.select("id", "folder", F.regexp_replace("missing", "(^|、)[0-9]+/", "$1").alias("missing"))


# -- scalars ---------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_partkey % 7 <> 0 THEN greatest(0, least(1, l_suppkey / (l_partkey % 7 * 20)::DOUBLE)) END, 5)::DOUBLE AS fraction, (400 * (1 << (l_linenumber - 1)::INTEGER))::BIGINT AS wait_ms,
  CASE WHEN l_partkey % 7 <> 0 THEN floor(100.0::DOUBLE * l_suppkey / (l_partkey % 7 * 20) + 0.5)::BIGINT END AS percent, (floor(l_orderkey * 77777 / 1000000 + 0.5)::BIGINT)::VARCHAR AS mb FROM lineitem""")
def transfer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("l_partkey") % 7 * 20
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numbers.progress_fraction("l_suppkey", total).cast("double"), 5).alias("fraction"), numbers.backoff_ms(F.col("l_linenumber") - 1).alias("wait_ms"),
        numbers.percent("l_suppkey", total).alias("percent"), numbers.megabytes(F.col("l_orderkey") * 77_777).alias("mb"),
    )


_PLACES = ("/in/a/b", "/in/a", "/in/ab/c", "/other", "/in//a/./x")


@query(f"""WITH p AS (SELECT c_custkey AS k, ({list(_PLACES)})[c_custkey % 5 + 1] AS p, CASE c_custkey % 6 WHEN 0 THEN 'ab12' WHEN 1 THEN 'a-b' WHEN 2 THEN '' WHEN 3 THEN '..' WHEN 4 THEN 'a/b' ELSE 'é' END AS name FROM customer)
SELECT k AS c_custkey, list_filter(string_split(p, '/'), lambda x: x <> '')[1:2] = ['in', 'a'] AS inside, regexp_full_match(name, '[A-Za-z0-9]*') AS safe_key, length(name) > 0 AND NOT contains(name, '/') AND name <> '..' AS safe_id,
  CASE WHEN k % 3 = 0 THEN 'set' WHEN k % 2 = 0 THEN 'home' ELSE 'tmp' END AS folder, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'configured' ELSE 'misconfigured' END WHEN k % 3 = 0 THEN 'bundled' WHEN k % 2 = 0 THEN 'path' ELSE 'missing' END AS tool FROM p""")
def safe_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("ab12", "a-b", "", "..", "a/b", "é"))), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, _PLACES)), (k % 5 + 1).cast("int")).alias("p"), name.alias("name"))
    return rows.select(
        "c_custkey", paths.is_inside("p", F.lit("/in/a")).alias("inside"), paths.safe_key("name").alias("safe_key"), paths.safe_id("name").alias("safe_id"),
        paths.first_directory(F.when(k % 3 == 0, "set"), F.when(k % 2 == 0, "home").otherwise(""), F.lit("tmp")).alias("folder"), paths.tool_place(F.when(k % 4 == 0, "x"), k % 8 == 0, k % 3 == 0, k % 2 == 0).alias("tool"),
    )


_LANGUAGES = ("Auto", "Chinese", "English", "Cantonese", "Japanese", "Korean", "Klingon")


@query(f"""WITH t AS (SELECT s_suppkey AS k, ({list(_LANGUAGES)})[s_suppkey % 7 + 1] AS language, CASE s_suppkey % 3 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN s_name ELSE '' END AS t, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 100) / 100 END AS kept FROM supplier)
SELECT k AS s_suppkey, CASE language WHEN 'Auto' THEN 'auto' WHEN 'Chinese' THEN 'zh' WHEN 'English' THEN 'en' WHEN 'Cantonese' THEN 'yue' WHEN 'Japanese' THEN 'ja' WHEN 'Korean' THEN 'ko' END AS code, CASE WHEN k % 3 = 1 THEN t END AS said,
  CASE WHEN kept IS NULL THEN 'no sound to judge' ELSE (k % 100) || '% kept' END || CASE WHEN k % 5 = 0 THEN ', detector lost it and the file was re-read' ELSE '' END AS coverage,
  CASE k % 4 WHEN 0 THEN '无法读取这个文件：' WHEN 1 THEN '模型不可用：' WHEN 2 THEN '下载失败：' ELSE '' END || 'm' || k AS message FROM t""")
def user_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, " \t").when(k % 3 == 1, F.col("s_name")).otherwise("")
    kind = F.element_at(F.array(*map(F.lit, ("decode", "model", "network", "sink"))), (k % 4 + 1).cast("int"))
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.language_code(language).alias("code"), text.blank_to_null(said).alias("said"), text.describe_coverage(F.when(k % 4 != 0, k % 100 / 100), k % 5 == 0).alias("coverage"),
        text.message_for(kind, F.concat(F.lit("m"), k.cast("string"))).alias("message"),
    )


@query(r"""SELECT doc_id, replace(text, chr(10), '') AS scored, CASE WHEN doc_id % 2 = 0 THEN trim(split_part(text, chr(10), 1)) ELSE '' END AS complaint FROM documents""")
def decoder_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without line ends; and what a decoder complains of between its banners."""
    line = F.split("text", "\n")[0]
    log = F.concat(F.lit("Input #0, wav\n  Duration: 00:00:01\n"), F.when(F.col("doc_id") % 2 == 0, line).otherwise(""), F.lit("\n  Stream #0:0\nPress [q] to stop"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_newlines("text").alias("scored"), F.trim(text.complaint(log)).alias("complaint"))


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey * 1000 + l_partkey) * 1000001 // 1000000000 AS secs, ((l_orderkey * 1000 + l_partkey) * 1000001 % 1000000000)::INTEGER AS nanos, (l_orderkey * 1000 + l_partkey) * 1000001 AS again,
  CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey // greatest(l_linenumber % 3, 1) * 1000000000 // (CASE WHEN l_linenumber = 3 THEN 1 ELSE 8000 * l_linenumber END) END::BIGINT AS chunk FROM lineitem""")
def exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nanos = (F.col("l_orderkey") * 1000 + F.col("l_partkey")) * 1_000_001
    rows = table(spark, sf_dir, "lineitem").withColumn("span", times.span_of(nanos))
    rate = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_linenumber") * 8000)
    return rows.select("l_orderkey", "l_linenumber", "span.secs", "span.nanos", times.nanos_of("span").alias("again"), times.chunk_nanos("l_partkey", rate, F.col("l_linenumber") % 3).alias("chunk"))


@query("SELECT vec_id, 0.02 + (vec_id % 99) / 101 AS threshold FROM embeddings")
def checked_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", signal.checked_threshold(F.lit(0.02) + F.col("vec_id") % 99 / 101).alias("threshold"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'words' END AS text FROM embeddings")
def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic engine; every third span is silent."""
    samples = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return engines.recognise(table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("samples")), "fixed").select("vec_id", "text")


@query("SELECT 'fixed' AS id, 'Fixed words' AS display_name, false AS streaming, false AS hotwords, true AS ignored")
def engine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What engines can do, before any is loaded; a vocabulary that one doesn't take is ignored with a warning."""
    rows = [(e.id, e.display_name, e.streaming, e.supports_hotwords, engines.accepted_hotwords(e.id, "words")[1] is not None) for e in engines.engines()]
    return spark.createDataFrame(rows, "id string, display_name string, streaming boolean, hotwords boolean, ignored boolean")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey * 2 END AS x FROM orders""")
def dispatched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines.route("twice", lambda: lambda df: df.withColumn("x", F.col("x") * 2))
    engines.route("negative", lambda: lambda df: df.withColumn("x", -F.col("x")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "negative").otherwise("twice").alias("kind"), F.col("o_custkey").alias("x"))
    return engines.dispatched(rows, ["twice", "negative"]).select("o_orderkey", "x")


@query(f"WITH {scoring.EDITED} SELECT mark, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((mark), ()) ORDER BY instr(',.?!', coalesce(mark, '~'))")
def marks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punctuation.in_report_order(punctuation.mark_sums(scoring._same_text_cells(spark, sf_dir)), marks=scoring.ASCII_MARKS)


@query()
def settings_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all that decides a run's result; bits of floating-point numbers have no SQL."""
    k = F.col("s_suppkey")
    settings: dict[str, Column] = {
        "engine": F.col("s_name"), "itn": k % 2 == 0, "threads": k % 8, "max_output_tokens": F.when(k % 3 == 0, k), "hotwords": F.when(k % 5 == 0, "words"), "threshold": (k % 100 / 100).cast("float"),
        "min_silence": F.lit(0.25).cast("float"), "min_speech": F.lit(0.25).cast("float"), "floor": F.lit(0.7), "min_energetic": F.lit(1.0), "decoder": F.when(k % 7 != 0, "build 1"),
    }
    files = F.array(F.struct(F.lit("m.onnx").alias("name"), digests.file_label(F.lit("m.onnx"), k, F.lit(None)).alias("label")), F.struct(F.lit("vad_model").alias("name"), F.lit("missing").alias("label")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", digests.fingerprint(digests.settings_parts(settings, files)).alias("digest"))


# -- signals ---------------------------------------------------------------


@query("""WITH c AS (SELECT label AS file_id, vec_id AS seq, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS start FROM embeddings),
x AS (SELECT file_id, start + unnest(range(0, 64)) AS at, unnest(embedding)::DOUBLE AS v FROM c), s AS (SELECT file_id, seq, start FROM c WHERE seq % 2 = 0)
SELECT s.seq AS vec_id, count(v) AS n, round(coalesce(sum(v), 0), 5) AS total FROM s LEFT JOIN x ON x.file_id = s.file_id AND x.at >= s.start - 200 AND x.at < s.start GROUP BY s.seq""")
def context_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 samples before every other chunk, which reach over several chunks."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"), F.lit(64).alias("n"))
    chunks = signal.chunk_starts(chunks)
    spans = chunks.where("seq % 2 = 0").select("file_id", F.col("seq").alias("span"), "start", (F.col("start") + 64).alias("seen"))
    out = signal.with_context(spans, chunks.select("file_id", "start", "samples"), 200)
    context = F.coalesce("context", F.array().cast("array<float>"))
    return out.select(F.col("span").alias("vec_id"), F.size(context).cast("long").alias("n"), F.round(F.aggregate(context, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH c AS (SELECT conv_id AS file_id, (turn + 1) * 100 AS "end" FROM conversations), s AS (SELECT conv_id AS file_id, turn * 60 + 30 AS "end", CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS text FROM conversations),
k AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY "end") - 1)::INTEGER AS seg_id FROM s WHERE length(text) > 0)
SELECT file_id, "end" AS at, 1 AS ordinal, 'progress' AS kind, NULL::INTEGER AS seg_id FROM c UNION ALL
SELECT k.file_id, coalesce(min(c."end") FILTER (c."end" >= k."end"), max(c."end")) AS at, 0, 'segment', seg_id FROM k JOIN c ON c.file_id = k.file_id GROUP BY k.file_id, k.seg_id""")
def sweep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100, and a span that ends every 60; every fourth has no text."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "file_id")
    chunks = rows.select("file_id", ((F.col("turn") + 1) * 100).alias("end"))
    return signal.swept(rows.select("file_id", (F.col("turn") * 60 + 30).alias("end"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")).alias("text")), chunks)


@query("SELECT o_orderkey AS job, o_orderstatus AS state, o_orderstatus = 'F' AS settled FROM orders")
def settled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("kind"))
    state = F.when(F.col("kind") == "F", "done").otherwise("running")
    return rows.withColumn("real", state).select("job", F.col("kind").alias("state"), jobs.is_settled("real").alias("settled"))


# -- reports and views -----------------------------------------------------


@query(f"""WITH {scoring.PAIRS}, d AS (SELECT dataset, count(*) AS files, CASE WHEN sum(reference_len) = 0 THEN 0 ELSE sum(errors) / sum(reference_len) END AS cer, sum(reference_len) / sum(segments) AS per, sum(segments) AS seconds, avg(coverage) AS coverage, count(*) FILTER (recovered) AS recovered FROM s GROUP BY dataset)
SELECT dataset, concat_ws(' ', rpad(dataset, 20, ' '), lpad(files::VARCHAR, 6, ' '), lpad(printf('%.2f%%', round(cer * 100, 2)), 8, ' '), lpad('0.0%', 8, ' '), lpad('—', 9, ' '), lpad(printf('%.1f', round(per, 1)), 8, ' '), lpad(printf('%ds', seconds::BIGINT), 7, ' '),
  lpad(coalesce(printf('%.1f%%', round(coverage * 100, 1)), '—'), 7, ' '), lpad(recovered::VARCHAR, 5, ' ')) AS line FROM d""")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation isn't scored here; segments stand for seconds."""
    rows = scoring.scored(spark, sf_dir)
    all_ = scores.roll_up(rows, "dataset").join(scores.coverage_roll_up(rows, "dataset"), "dataset").join(scores.mean_segment_chars(rows, "dataset"), "dataset")
    return scores.summary_lines(all_.withColumns({"f1": F.lit(None).cast("double"), "seconds": F.col("segments").cast("double")}))


@query(f"""WITH {scoring.PAIRS}, d AS (SELECT dataset, count(*) AS files, sum(reference_len) AS chars, sum(errors) AS errors, CASE WHEN sum(reference_len) = 0 THEN 0 ELSE sum(errors) / sum(reference_len) END AS cer, count(*) FILTER (errors = 0) AS exact, sum(segments) AS segments,
    avg(coverage) AS mean, min(coverage) AS low, count(coverage) AS judged, count(*) FILTER (recovered) AS recovered, list_sort(list(rate)) AS rates FROM s GROUP BY dataset),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY errors DESC, reference_len DESC, pos) AS k FROM s), q AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p)
SELECT dataset, 0::INTEGER AS ordinal, 'utterances' AS fact, files::VARCHAR AS value FROM d UNION ALL SELECT dataset, 1, 'reference chars', chars::VARCHAR FROM d UNION ALL SELECT dataset, 2, 'errors', errors::VARCHAR FROM d
UNION ALL SELECT dataset, 3, 'CER', printf('%.2f%%', round(cer * 100, 2)) FROM d UNION ALL SELECT dataset, 4, 'segments', segments::VARCHAR || printf(' (%.1f chars each)', round(chars / segments, 1)) FROM d
UNION ALL SELECT dataset, 5, 'coverage', printf('%.1f%% mean, %.1f%% lowest of %d', round(mean * 100, 1), round(low * 100, 1), judged) FROM d WHERE judged > 0 UNION ALL SELECT dataset, 6, 'recovered', recovered::VARCHAR FROM d
UNION ALL SELECT dataset, 7, 'exact matches', printf('%d (%.1f%%)', exact, round(100.0::DOUBLE * exact / files, 1)) FROM d
UNION ALL SELECT dataset, (100 + round(p * 100))::INTEGER, printf('p%.0f', p * 100), printf('%.1f%%', round(100 * rates[floor((len(rates) - 1) * p)::BIGINT + 1], 1)) FROM d, q
UNION ALL SELECT dataset, (1000 + k)::INTEGER, utt_id, printf('%d errors / %d chars', errors, reference_len) FROM o WHERE k <= 20""")
def detail_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.detail_rows(scoring.scored(spark, sf_dir), "dataset", "pos")


@query(f"""WITH {scoring.EDITED}, g AS (SELECT lang, mark, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((lang, mark), (lang))),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM g), x AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM q)
SELECT lang, (500 + CASE WHEN mark IS NULL THEN 4 ELSE instr(',.?!', mark) - 1 END)::INTEGER AS ordinal, coalesce('mark ' || mark, 'marks overall') AS fact,
  printf('%6.1f%% %6.1f%% %6.1f%% %6d %6d %6d', round(p * 100, 1), round(r * 100, 1), round(f1 * 100, 1), tp, fp, fn) AS value FROM x""")
def detail_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account's lines of marks, of texts whose commas were heard as full stops."""
    sums = punctuation.with_prf(punctuation.mark_sums(scoring._same_text_cells(spark, sf_dir), "lang"))
    return scores.mark_rows(sums, "lang", scoring.ASCII_MARKS)


@query("""WITH b AS (SELECT o_custkey AS batch, count(*) AS inputs, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '-' WHEN 2 THEN 'out/all.SRT' WHEN 3 THEN 'out/v1.2' WHEN 4 THEN '.txt' ELSE 'taken' END AS output, o_custkey % 12 = 5 AS is_file FROM orders GROUP BY o_custkey),
e AS (SELECT *, inputs = 1 AND output IS NOT NULL AS one, is_file OR o_ext IN ('srt', 'txt', 'text') AS file FROM (SELECT *, lower(regexp_extract(regexp_extract(output, '[^/]*$'), '^.+[.]([^.]*)$', 1)) AS o_ext FROM b)),
f AS (SELECT *, CASE WHEN one THEN NULL WHEN output = '-' THEN printf('%s-o -%s writes one transcript to stdout and cannot hold %d', chr(39), chr(39), inputs) WHEN file THEN printf('%s-o %s%s names a file, but there are %d inputs; name a directory instead', chr(39), output, chr(39), inputs) END AS error FROM e)
SELECT batch, CASE WHEN one THEN output END AS path, CASE WHEN NOT one AND error IS NULL THEN coalesce(output, 'transcripts') END AS folder, error FROM f""")
def outputs_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are the inputs of a batch, which may name where they go."""
    k = F.col("o_custkey")
    named = F.when(k % 6 == 1, "-").when(k % 6 == 2, "out/all.SRT").when(k % 6 == 3, "out/v1.2").when(k % 6 == 4, ".txt").when(k % 6 == 5, "taken")
    batches = table(spark, sf_dir, "orders").groupBy(k).agg(F.count(F.lit(1)).alias("inputs"))
    planned = store.planned_outputs(batches.withColumns({"output": named, "output_is_file": k % 12 == 5}), "transcripts", TRANSCRIPT_EXTENSIONS)
    return planned.select(k.alias("batch"), "path", "folder", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN trim(o_orderpriority) END AS applied, CASE WHEN o_orderkey % 4 = 3 THEN 'Fixed words takes no vocabulary; it was ignored' END AS warning FROM orders""")
def vocabularies_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of two engines, of which one takes a vocabulary; every fourth has a blank one."""
    worded = engines.Engine("worded", "Words with a vocabulary", engines.fixed("words"), supports_hotwords=True)
    k = F.col("o_orderkey") % 4
    words = F.when(k == 2, "  ").otherwise(F.trim("o_orderpriority"))
    applied, warning = engines.vocabulary_of(F.when(k < 2, "worded").otherwise("fixed"), words, worded)
    return table(spark, sf_dir, "orders").select("o_orderkey", applied.alias("applied"), warning.alias("warning"))


@query(f"""WITH {LISTED} SELECT list, pos, regexp_extract(input, '[^/]*$') AS name, 'e' AS engine, CASE state WHEN 'running' THEN 'working' WHEN 'needs_model' THEN 'needsModel' ELSE state END AS state, state = 'done' AND pos % 3 <> 0 AS has_result FROM f""")
def entry_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.entry_views(_listed(spark, sf_dir).withColumns({"engine": F.lit("e"), "output": F.when(F.col("pos") % 3 != 0, "o")}))


@query(f"""WITH {LISTED} SELECT list, pos, CASE state WHEN 'running' THEN 'working' WHEN 'needs_model' THEN 'needsModel' ELSE state END AS state, regexp_extract(input, '[^/]*$') AS file, CASE WHEN state = 'running' THEN pos * 10 END AS elapsed_ms,
  CASE WHEN state = 'running' THEN 0.5 END::DOUBLE AS fraction, CASE WHEN state = 'done' AND pos % 3 <> 0 THEN 'o' END AS exported, NULL::VARCHAR AS recovery FROM f""")
def screen_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir).withColumns({"position_ms": F.col("pos") * 10, "fraction": F.lit(0.5), "output": F.when(F.col("pos") % 3 != 0, "o"), "kind": F.lit("io")})
    return worklist.screen_views(rows)


@query("""WITH m AS (SELECT l_orderkey AS id, CASE WHEN bool_and(l_linestatus = 'O') THEN sum(l_quantity)::BIGINT END AS total FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'fetching' ELSE 'ready' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS file, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS received_bytes, NULL::BIGINT AS total_bytes, CASE WHEN o_orderkey % 2 = 0 THEN total END AS model_total_bytes
FROM orders LEFT JOIN m ON m.id = o_orderkey""")
def download_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = catalogue.sizes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long")).alias("size")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "fetching").otherwise("ready").alias("state"), F.col("o_orderpriority").alias("file"), F.col("o_custkey").alias("received"), F.lit(None).cast("long").alias("total"))
    return worklist.download_views(rows, sizes)


@query("""WITH t AS (SELECT conv_id AS file_id, sum(length(text) * 80)::BIGINT AS total FROM conversations GROUP BY conv_id), b AS (SELECT file_id, total, unnest(range(0, (total - 1) // 20000 + 1)) AS block FROM t WHERE total > 0)
SELECT file_id, block * 20000 AS start, least(20000, total - block * 20000) AS n FROM b""")
def segmented_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by a segmenter that takes chunks one after the other."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), (F.length("text") * 80).cast("long").alias("n"), F.lit(1.0).alias("score"))
    return segmenters.segmented(signal.chunk_starts(rows), lambda: segmenters.Blocks(20_000))


@query("""WITH c AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value >= 20 AS speech FROM events),
g AS (SELECT *, k - row_number() OVER (PARTITION BY file_id, speech ORDER BY k) AS run FROM c), r AS (SELECT file_id, min(k) * 10 AS start, count(*) * 10 AS n FROM g WHERE speech GROUP BY file_id, run)
SELECT file_id, start::BIGINT AS start, n::BIGINT AS n FROM r WHERE n >= 20""")
def segmented_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two events and more with enough value; one without ends a run."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), ((F.row_number().over(order) - 1) * 10).cast("long").alias("start"), F.lit(10).cast("long").alias("n"), F.col("value").alias("score"))
    return segmenters.segmented(rows, lambda: segmenters.Gaps(20.0, 10, 20, 1 << 40))
