"""Scoring queries: consecutive turns of conversations stand for references and hypotheses.

The SQL engine that checks the results counts bytes in its edit distance, so its SQL
first turns each other character of the normalised texts into an ASCII one that they
don't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.functions.text import clean_markers, collapse_ws, normalize
from scriba.operators import punctuation, scoring
from scriba.plans.registry import query, table

ASCII_MARKS = ",.?!"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, utt_id, dataset, reference, hypothesis, segments, coverage, recovered``."""
    turns = table(spark, sf_dir, "conversations")
    # edit distances cost far more than their input's bytes tell, so the join keeps this number of partitions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hyp = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")).repartition(parts, "conv_id", "turn")
    both = turns.withColumnRenamed("text", "reference").repartition(parts, "conv_id", "turn").join(hyp, ["conv_id", "turn"])
    kept = F.least(F.length("hypothesis") / F.length("reference"), F.lit(1.0))
    out = both.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utt_id"), F.col("role").alias("dataset"),
        "reference", "hypothesis", F.size(F.split("hypothesis", r"\.")).cast("long").alias("segments"), F.when(F.length("reference") >= 40, kept).alias("coverage"),
    )
    return out.withColumn("recovered", F.coalesce(F.col("coverage") < 0.7, F.lit(False)))


PAIRS = r"""
p AS (
  SELECT a.conv_id * 1000 + a.turn AS pos, a.conv_id || '-' || a.turn AS utt_id, a.role AS dataset, a.text AS reference, b.text AS hypothesis,
         len(string_split(b.text, '.'))::BIGINT AS segments, CASE WHEN length(a.text) >= 40 THEN least(length(b.text) / length(a.text), 1.0) END AS coverage
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
n AS (SELECT *, coalesce(coverage < 0.7, false) AS recovered, lower(regexp_replace(reference, '[^\p{L}\p{N}]', '', 'g')) AS r, lower(regexp_replace(hypothesis, '[^\p{L}\p{N}]', '', 'g')) AS h FROM p),
k AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS chars FROM (SELECT DISTINCT unnest(string_split(r || h, '')) AS c FROM n) WHERE unicode(c) > 127),
y AS (SELECT n.* REPLACE (translate(r, chars, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~') AS r, translate(h, chars, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~') AS h) FROM n, k),
s AS (SELECT *, levenshtein(r, h)::BIGINT AS errors, length(r)::BIGINT AS reference_len, CASE WHEN length(r) = 0 THEN 0 ELSE levenshtein(r, h) / length(r) END AS rate FROM y)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(pairs(spark, sf_dir))


@query(f"""WITH {PAIRS} SELECT dataset, count(*) AS files, sum(errors)::BIGINT AS errors, sum(reference_len)::BIGINT AS chars, count(*) FILTER (errors = 0) AS exact,
  round(CASE WHEN sum(reference_len) = 0 THEN 0 ELSE sum(errors) / sum(reference_len) END, 9) AS cer, round(100.0 * count(*) FILTER (errors = 0) / count(*), 9)::DOUBLE AS exact_pct FROM s GROUP BY dataset""")
def cer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.roll_up(scored(spark, sf_dir), "dataset").withColumns({c: F.round(c, 9) for c in ("cer", "exact_pct")})


@query(f"WITH {PAIRS} SELECT utt_id, errors, reference_len, round(rate, 9) AS rate, errors = 0 AS exact FROM s")
def cer_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("utt_id", "errors", "reference_len", F.round("rate", 9).alias("rate"), (F.col("errors") == 0).alias("exact"))


@query(f"""WITH {PAIRS}, l AS (SELECT dataset, list_sort(list(rate)) AS r FROM s GROUP BY dataset), q AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p)
SELECT dataset, p, round(r[floor((len(r) - 1) * p)::BIGINT + 1], 9) AS value FROM l, q""")
def cer_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.percentiles(scored(spark, sf_dir).withColumn("value", F.col("rate")), "dataset", "value").withColumn("value", F.round("value", 9))


@query(f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY errors DESC, reference_len DESC, pos) AS k FROM s)
SELECT dataset, utt_id, errors, reference_len, k::INTEGER AS rank FROM o WHERE k <= 20""")
def cer_worst20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.worst(scored(spark, sf_dir), "dataset", "pos").select("dataset", "utt_id", "errors", "reference_len", "rank")


@query(f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) AS k FROM s)
SELECT dataset, count(*) AS files, sum(errors)::BIGINT AS errors FROM o WHERE k <= 25 GROUP BY dataset""")
def cer_limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.roll_up(scoring.scored(scoring.first_rows(pairs(spark, sf_dir), "dataset", "pos", 25)), "dataset").select("dataset", "files", "errors")


@query(f"""WITH {PAIRS} SELECT dataset, round(CASE WHEN sum(segments) = 0 THEN 0 ELSE sum(reference_len) / sum(segments) END, 9) AS chars_per_segment, sum(segments)::BIGINT AS segments FROM s GROUP BY dataset""")
def mean_segment_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mean_segment_chars(scored(spark, sf_dir), "dataset").withColumn("chars_per_segment", F.round("chars_per_segment", 9))


@query(f"""WITH {PAIRS} SELECT dataset, round(avg(coverage), 9) AS mean_coverage, round(min(coverage), 9) AS min_coverage, count(*) FILTER (recovered) AS recovered, count(coverage) AS judged FROM s GROUP BY dataset""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.coverage_roll_up(pairs(spark, sf_dir), "dataset").withColumns({c: F.round(c, 9) for c in ("mean_coverage", "min_coverage")})


@query("""WITH o AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, coalesce(bool_or(regexp_matches(text, '[,.?!]')), false) AS punctuated FROM o WHERE k <= 200 GROUP BY source""")
def dataset_punctuated_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.punctuated(table(spark, sf_dir, "documents"), "source", "doc_id", ASCII_MARKS, "text")


@query(f"""WITH {PAIRS} SELECT utt_id, concat_ws(chr(9), utt_id, errors::VARCHAR, reference, hypothesis, CASE WHEN coverage IS NULL THEN '-' ELSE printf('%.4f', coverage) END, CASE WHEN recovered THEN '1' ELSE '0' END) AS line FROM s""")
def scored_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dump_lines(scored(spark, sf_dir))


@query(f"""WITH {PAIRS}, b AS (SELECT *, CASE WHEN coverage IS NULL THEN NULL WHEN coverage < 0.3 THEN 0.3 WHEN coverage < 0.5 THEN 0.5 WHEN coverage < 0.7 THEN 0.7 WHEN coverage < 0.9 THEN 0.9 WHEN coverage < 0.99 THEN 0.99 ELSE 1 END::DOUBLE AS bucket FROM s)
SELECT bucket, count(*) AS files, round(CASE WHEN sum(reference_len) = 0 THEN 0 ELSE sum(errors) / sum(reference_len) END, 9) AS cer FROM b GROUP BY bucket""")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("bucket", scoring.coverage_bucket())
    return scoring.roll_up(rows, "bucket").select("bucket", "files", F.round("cer", 9).alias("cer"))


@query(f"""WITH {PAIRS}, t AS (SELECT *, levenshtein(r, left(r, length(r) // 2))::BIGINT AS e2 FROM s), f AS (SELECT unnest([0.0, 0.7, 0.8, 0.9, 0.97])::DOUBLE AS floor),
x AS (SELECT *, coalesce(coverage < floor, false) AS fires FROM t, f)
SELECT floor, count(*) FILTER (fires) AS fired, count(*) FILTER (fires AND e2 < errors) AS better, count(*) FILTER (fires AND e2 = errors) AS same, count(*) FILTER (fires AND e2 > errors) AS worse,
  sum(CASE WHEN fires THEN e2 - errors ELSE 0 END)::BIGINT AS net_errors, sum(CASE WHEN fires THEN e2 ELSE errors END)::BIGINT AS errors FROM x GROUP BY floor""")
def guard_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading is the first half of the reference."""
    rows = scored(spark, sf_dir).withColumn("r", normalize("reference"))
    rows = rows.select("coverage", F.col("errors").alias("errors_first"), F.levenshtein("r", F.expr("left(r, length(r) div 2)")).cast("long").alias("errors_second"))
    return scoring.guard_sweep(rows, (0.0, 0.7, 0.8, 0.9, 0.97))


# -- punctuation -----------------------------------------------------------


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and the same with commas made full stops, and no question marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("reference"))
    return docs.withColumn("hypothesis", F.translate("reference", ",?", "."))


EDITED = r"""
d AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{N}]([^\p{L}\p{N}]*)', 1) AS a, regexp_extract_all(translate(text, ',?', '.'), '[\p{L}\p{N}]([^\p{L}\p{N}]*)', 1) AS b FROM documents),
u AS (SELECT doc_id, lang, unnest(a) AS a, unnest(b) AS b FROM d),
m AS (SELECT doc_id, lang, nullif(left(regexp_replace(a, '[^,.?!]', '', 'g'), 1), '') AS a, nullif(left(regexp_replace(b, '[^,.?!]', '', 'g'), 1), '') AS b FROM u),
c AS (SELECT lang, a AS mark, CASE WHEN a = b THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END AS fn FROM m WHERE a IS NOT NULL
      UNION ALL SELECT lang, b, 0, 1, 0 FROM m WHERE b IS NOT NULL AND a IS DISTINCT FROM b)
"""


def _same_text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edited(spark, sf_dir)
    return rows.select("lang", F.explode(punctuation.same_text_cells("reference", "hypothesis", ASCII_MARKS)).alias("x")).select("lang", "x.*")


@query(f"WITH {EDITED} SELECT lang, mark, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((lang, mark), (lang))")
def punct_same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punctuation.mark_sums(_same_text_cells(spark, sf_dir), "lang")


@query(f"""WITH {EDITED}, g AS (SELECT mark, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((mark), ())),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM g)
SELECT mark, tp, fp, fn, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM q""")
def prf_by_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return punctuation.with_prf(punctuation.mark_sums(_same_text_cells(spark, sf_dir))).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query()
def punct_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of differing texts, over an alignment of their characters."""
    rows = pairs(spark, sf_dir).withColumn("cells", punctuation.cells_of("reference", "hypothesis", ASCII_MARKS))
    cells = rows.select("dataset", F.explode("cells").alias("x")).select("dataset", "x.*")
    return punctuation.with_prf(punctuation.mark_sums(cells, "dataset"))


# -- text ------------------------------------------------------------------


@query(r"SELECT conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS normal FROM conversations")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize("text").alias("normal"))


@query(r"""WITH m AS (SELECT conv_id, turn, '<|zh|><|NEUTRAL|> ' || text || CASE WHEN conv_id % 3 = 0 THEN ' <|tail ' || text ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<\|.*?\|>', '', 'g'), '(?s)<\|.*$', ''), '^\s+|\s+$', '', 'g') AS clean FROM m""", name="clean_markers")
def clean_markers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" <|tail "), "text")).otherwise("")
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("<|zh|><|NEUTRAL|> "), "text", tail))
    return rows.select("conv_id", "turn", clean_markers("t").alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS escaped FROM documents")
def escape_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", collapse_ws("text").alias("escaped"))
