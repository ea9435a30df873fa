"""Catalogue and report queries: orders stand for models, their lines for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriba.operators import catalogue
from scriba.plans.registry import query, table


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model needs the one before it and, sometimes, one that isn't listed."""
    key = F.col("o_orderkey")
    requires = F.when(key % 3 == 0, F.array((key - 1).cast("string"), F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(key.cast("string").alias("id"), requires.alias("requires"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("local"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long")).alias("size"), "l_suppkey", "l_quantity")


def _disk(files: DataFrame) -> DataFrame:
    """Most files are there; some have another size."""
    real = (F.col("l_quantity") + F.when(F.col("l_suppkey") % 13 == 0, 1).otherwise(0)).cast("long")
    return files.where("l_suppkey % 10 <> 0").groupBy("id", "local").agg(F.max(real).alias("size"))


MODELS = """
m AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN [(o_orderkey - 1)::VARCHAR, 'gone'] ELSE [] END AS requires FROM orders),
r AS (SELECT e.id, e.needed, e.ordinal FROM (SELECT id, unnest(requires) AS needed, generate_subscripts(requires, 1) - 1 AS ordinal FROM m) e JOIN m ON m.id = e.needed),
f AS (SELECT l_orderkey::VARCHAR AS id, l_linenumber || '-' || l_partkey AS local, CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT END AS size, l_suppkey % 10 <> 0 AS there, l_quantity::BIGINT + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS real FROM lineitem),
d AS (SELECT id, local, max(real) AS real FROM f WHERE there GROUP BY ALL),
a AS (SELECT m.id, coalesce(bool_and(d.real IS NOT NULL AND (f.size IS NULL OR f.size = d.real)), false) AS present FROM m LEFT JOIN f ON f.id = m.id LEFT JOIN d ON d.id = f.id AND d.local = f.local GROUP BY m.id),
n AS (SELECT r.id, bool_and(a.present) AS needs FROM r JOIN a ON a.id = r.needed GROUP BY r.id)
"""


@query(f"WITH {MODELS} SELECT id, needed, ordinal::INTEGER AS ordinal FROM r")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.requirements(_models(spark, sf_dir))


@query(f"WITH {MODELS} SELECT a.id, present, present AND coalesce(needs, true) AS runnable FROM a LEFT JOIN n ON n.id = a.id")
def all_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalogue.presence(_models(spark, sf_dir), files, _disk(files))


@query(f"""WITH {MODELS}, w AS (SELECT id, id AS fetch, 0 AS ordinal FROM m UNION ALL SELECT id, needed, ordinal + 1 FROM r)
SELECT w.id, w.fetch, w.ordinal::INTEGER AS ordinal FROM w JOIN a ON a.id = w.fetch WHERE NOT a.present""")
def to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalogue.to_fetch(_models(spark, sf_dir), files, _disk(files))


@query(f"WITH {MODELS} SELECT id, coalesce(sum(size), 0)::BIGINT AS known_bytes, CASE WHEN count(*) = count(size) THEN sum(size) END::BIGINT AS total_bytes FROM f GROUP BY id")
def model_bytes_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.sizes(_files(spark, sf_dir))


@query("""WITH m AS (SELECT o_custkey::VARCHAR AS id, o_orderkey FROM orders)
SELECT id, 'listed twice' AS problem, id AS detail FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT id, 'no files', NULL FROM m WHERE id::BIGINT % 10 = 0
UNION ALL SELECT DISTINCT id, 'no mirrors', NULL FROM m WHERE id::BIGINT % 7 = 0
UNION ALL SELECT id, 'requires itself', id FROM m WHERE o_orderkey % 50 = 0
UNION ALL SELECT id, 'requires what isn''t listed', 'gone' FROM m WHERE o_orderkey % 60 = 0""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ident = F.col("o_custkey").cast("string")
    requires = F.concat(F.when(key % 50 == 0, F.array(ident)).otherwise(F.array().cast("array<string>")), F.when(key % 60 == 0, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>")))
    models = table(spark, sf_dir, "orders").select(ident.alias("id"), requires.alias("requires"))
    ids = models.select("id").distinct()
    return catalogue.violations(models, ids.where("cast(id as bigint) % 10 <> 0").withColumn("local", F.lit("model.onnx")), ids.where("cast(id as bigint) % 7 <> 0"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer stand for the results of a batch; what isn't fulfilled failed."""
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").alias("ok"), F.when(F.col("o_orderstatus") == "O", "io").when(F.col("o_orderstatus") == "P", "engine").alias("kind"))


BATCH = "b AS (SELECT o_custkey, o_orderkey AS pos, o_orderstatus = 'F' AS ok, CASE o_orderstatus WHEN 'O' THEN 'io' WHEN 'P' THEN 'engine' END AS kind FROM orders)"


@query(f"WITH {BATCH} SELECT o_custkey, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok) = 0 AS ok, coalesce(arg_min(kind, pos) FILTER (NOT ok), CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'internal' END) AS first_failure FROM b GROUP BY o_custkey")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.report(_batch(spark, sf_dir), "o_custkey")


@query(f"WITH {BATCH}, f AS (SELECT *, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY o_custkey) AS first FROM b) SELECT o_custkey, pos, ok, kind FROM f WHERE pos <= coalesce(first, pos)")
def fail_fast_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.until_first_failure(_batch(spark, sf_dir), "o_custkey").select("o_custkey", "pos", "ok", "kind")


@query(f"WITH {BATCH}, i AS (SELECT row_number() OVER (ORDER BY -o_orderkey) - 1 AS place, o_orderkey AS pos FROM orders WHERE o_orderkey % 4 <> 0) SELECT b.pos, coalesce(i.place, 9223372036854775807)::BIGINT AS place FROM b LEFT JOIN i ON i.pos = b.pos")
def input_order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _batch(spark, sf_dir).select("pos")
    return catalogue.in_input_order(results, _numbered(results.where("pos % 4 <> 0")), "pos", "place").select("pos", "place")


def _numbered(rows: DataFrame) -> DataFrame:
    """A list of inputs in descending order of their keys, numbered: rows before each range, then those in it."""
    dealt = rows.repartitionByRange(8, F.desc("pos")).withColumn("part", F.spark_partition_id())
    before = dealt.groupBy("part").count()
    before = before.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("pos"))) - 1
    return dealt.withColumn("n", inner).join(before, "part").select("pos", (F.col("before") + F.col("n")).alias("place"))


@query("""WITH w AS (SELECT s_nationkey AS pool, ['unloaded', 'standby', 'loading', 'busy', 'lost'][s_suppkey % 5 + 1] AS state FROM supplier)
SELECT pool, CASE WHEN bool_or(state = 'busy') THEN 'busy' WHEN bool_or(state = 'loading') THEN 'loading' WHEN bool_or(state = 'standby') THEN 'standby' ELSE 'unloaded' END AS status FROM w GROUP BY pool""")
def pool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("unloaded", "standby", "loading", "busy", "lost")
    workers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.element_at(F.array(*map(F.lit, states)), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("state"))
    return catalogue.pool_status(workers, "pool")


@query("""SELECT (SELECT sum(s_nationkey)::BIGINT FROM supplier) AS loads, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS resident, (SELECT count(*) FROM supplier) AS workers, (SELECT count(*) * 639014694 FROM supplier) AS implied_peak_bytes,
  count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS retained FROM orders""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("loads"), F.when(F.col("s_suppkey") % 3 == 0, "unloaded").otherwise("standby").alias("state"))
    jobs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("state"))
    return catalogue.health(workers, jobs, 639_014_694)


@query("""WITH l AS (SELECT l_suppkey, l_partkey, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, sum(q) AS received FROM l GROUP BY l_suppkey""")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("file"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("seq"), F.col("l_quantity").alias("received"))
    return catalogue.latest_progress(states, "l_suppkey")


@query("""WITH p AS (SELECT doc_id, '/data/' || lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END || '/' || source AS path FROM documents)
SELECT doc_id, CASE WHEN path LIKE '/data/en/%' THEN '/data/en' WHEN path LIKE '/data/de/src1' THEN '/data/de/src1' WHEN path LIKE '/data/%' THEN '/data' END AS mount FROM p""")
def longest_mount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), "lang", F.when(F.col("doc_id") % 2 == 0, "").otherwise("x"), F.lit("/"), "source").alias("path"))
    mounts = spark.createDataFrame([("/data",), ("/data/en",), ("/data/de/src1",)], "mount string")
    return catalogue.longest_prefix(rows, mounts).select("doc_id", "mount")


@query("""SELECT o_orderkey, '{"orderKey":' || o_orderkey || ',"ok":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',"errorKind":' || CASE o_orderstatus WHEN 'O' THEN '"io"' WHEN 'P' THEN '"engine"' ELSE 'null' END || '}' AS document FROM orders""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batch(spark, sf_dir).select(F.col("pos").alias("order_key"), "ok", F.col("kind").alias("error_kind"))
    out = catalogue.to_document(rows, "order_key", "ok", "error_kind")
    return out.select(F.get_json_object("document", "$.orderKey").cast("long").alias("o_orderkey"), "document")
