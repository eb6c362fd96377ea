"""The evaluation run: labels, fields, calibration, timing and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import evaluation as E
from ..operators import review as R
from ..sources.tables import entity, table, with_entities
from .registry import query

#: Labels by a rule over the texts against the labels table: sets of labels a document.
PAIRS = """
SELECT d.doc_id, CASE WHEN l.toxic = 1 AND l.quality = 1 THEN array('ICSR', 'MI') WHEN l.toxic = 1 THEN array('ICSR') WHEN l.quality = 1 THEN array('PQC') ELSE array('NOT_RELEVANT') END AS expected,
  CASE WHEN length(d.text) > 5000 THEN array('ICSR', 'MI') WHEN d.text LIKE '%***%' THEN array('NOT_RELEVANT') WHEN d.lang = 'fr' THEN array('MI') ELSE array('PQC') END AS predicted
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
PAIRS_SQL = "WITH p AS (" + PAIRS.format(documents="documents", labels="labels").replace("array(", "list_value(") + ")"
COUNTED_SQL = (
    PAIRS_SQL
    + """, c AS (SELECT family, count(*) FILTER (list_contains(expected, family) AND list_contains(predicted, family)) AS tp,
   count(*) FILTER (NOT list_contains(expected, family) AND list_contains(predicted, family)) AS fp, count(*) FILTER (list_contains(expected, family) AND NOT list_contains(predicted, family)) AS fn
  FROM p, (VALUES ('ICSR'), ('PQC'), ('MI'), ('NOT_RELEVANT')) AS f(family) GROUP BY 1)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAIRS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


@query(
    "A21 A22",
    COUNTED_SQL
    + """SELECT family, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""",
)
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scores(E.confusion(pairs(spark, sf_dir)))


@query(
    "A22 U04",
    COUNTED_SQL
    + """, x AS (SELECT round(count(*) FILTER (list_sort(list_distinct(expected)) = list_sort(list_distinct(predicted))) / nullif(count(*), 0), 4) AS exact_set FROM p)
SELECT round(coalesce(2 * sum(tp)::DOUBLE / nullif(sum(2 * tp + fp + fn)::DOUBLE, 0), 0), 4) AS micro_f1,
 round(avg(CASE WHEN tp + fn > 0 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4)::DECIMAL(18,4) END)::DOUBLE, 4) AS macro_f1, any_value(x.exact_set) AS exact_set FROM c, x""",
)
def category_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    exact = p.agg(E.ratio(F.count_if(E.same_set(F.col("expected"), F.col("predicted"))), F.count("*")).alias("exact_set"))
    return E.averages(E.confusion(p)).join(F.broadcast(exact))


GOLDEN = """
SELECT l_orderkey AS message_id, CASE l_linenumber WHEN 1 THEN 'patient.age.raw' WHEN 2 THEN 'product.batch' WHEN 3 THEN 'reporter.name' WHEN 4 THEN 'severity.criteria' ELSE 'reaction.term' END AS path,
  concat(CAST(CAST(max(l_quantity) AS INT) AS STRING), ' years') AS expected FROM {lineitem} WHERE l_linenumber <= 5 GROUP BY 1, 2"""
GOT = """
SELECT l_orderkey AS message_id, CASE l_linenumber WHEN 1 THEN 'patient.age' WHEN 2 THEN 'product[0].batch' WHEN 3 THEN 'reporter.name' WHEN 4 THEN 'reaction[0].seriousness' WHEN 5 THEN 'reaction.other' ELSE 'extra' END AS path,
  max(CASE WHEN l_suppkey % 5 = 0 THEN 'NOT_STATED' ELSE 'STATED' END) AS status, concat('about ', CAST(CAST(max(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE l_quantity + 1 END) AS INT) AS STRING), ' yrs.') AS value,
  max(CAST(1 - l_discount * 4 AS DECIMAL(5,4))) AS confidence FROM {lineitem} GROUP BY 1, 2"""
SCORE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(X, ''))), '\b(years?|yrs?|y\.?o\.?|months?|weeks?|days?|kg|lb|mg|ml)\b\.?', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def score_sql(column: str) -> str:
    return SCORE_SQL.replace("X", column)


STOPS_SQL = "['', " + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"
MATCH_SQL = "(CASE WHEN a = '' AND b = '' THEN true WHEN a = '' OR b = '' THEN false ELSE contains(' ' || a || ' ', ' ' || b || ' ') OR contains(' ' || b || ' ', ' ' || a || ' ') END)"
LOOSE_SQL = f"""({MATCH_SQL} OR coalesce(len(list_intersect(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains({STOPS_SQL}, w)), list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains({STOPS_SQL}, w))))
  / nullif(least(len(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains({STOPS_SQL}, w))), len(list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains({STOPS_SQL}, w)))), 0) >= 0.67, false))"""
RESOLVED = r"regexp_replace(regexp_replace(CASE path WHEN 'severity.criteria' THEN 'reaction[0].seriousness' WHEN 'severity.is_serious' THEN 'reaction[0].seriousness' WHEN 'defect.summary' THEN 'defect.description' WHEN 'product.batch' THEN 'product[0].batch' ELSE path END, '\.frequency_raw$', '.frequency'), '\.(raw|iso|precision)$', '')"
OUTCOME_SQL = f"""WITH g AS (SELECT message_id, {RESOLVED} AS path, expected FROM ({GOLDEN.format(lineitem="lineitem")})), f AS ({GOT.format(lineitem="lineitem")}),
j AS (SELECT coalesce(g.message_id, f.message_id) AS message_id, coalesce(g.path, f.path) AS path, expected, status, value, confidence, {score_sql("expected")} AS a, {score_sql("value")} AS b
  FROM g FULL JOIN f ON g.message_id = f.message_id AND g.path = f.path),
o AS (SELECT *, CASE WHEN expected IS NULL THEN CASE WHEN status = 'NOT_STATED' THEN 'abstained_correctly' ELSE 'false_confident' END WHEN status IS NULL THEN 'missing_field' WHEN status = 'NOT_STATED' THEN 'wrong'
  WHEN {MATCH_SQL} THEN 'correct' WHEN {LOOSE_SQL} THEN 'correct_normalised' ELSE 'wrong' END AS outcome FROM j)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return E.field_outcomes(spark.sql(GOLDEN, lineitem=lineitem), spark.sql(GOT, lineitem=lineitem).drop("confidence"))


@query("A23 J11 J12 X10 X11 U04", OUTCOME_SQL + "SELECT path, outcome, count(*) AS n FROM o GROUP BY 1, 2")
def field_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("path", "outcome").agg(F.count("*").alias("n"))


@query("O09", OUTCOME_SQL + "SELECT message_id, path, expected, value FROM o WHERE outcome = 'wrong' AND status <> 'NOT_STATED' ORDER BY message_id, path LIMIT 12")
def field_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    got = spark.sql(GOT, lineitem=lineitem).drop("confidence")
    found = E.field_outcomes(spark.sql(GOLDEN, lineitem=lineitem), got).where(F.col("outcome") == "wrong")
    asserted = got.where(F.col("status") != "NOT_STATED").select("message_id", "path")
    return found.join(asserted, ["message_id", "path"], "left_semi").orderBy("message_id", "path").limit(12).select("message_id", "path", "expected", "value")


CURVE_SQL = (
    OUTCOME_SQL
    + f""", k AS (SELECT least(9, floor(confidence * 10))::INT AS band, count(*) AS n, count(*) FILTER ({LOOSE_SQL}) AS correct FROM j WHERE expected IS NOT NULL AND status <> 'NOT_STATED' GROUP BY 1),
c AS (SELECT band, n, round(correct / n, 4) AS accuracy, round((band + 0.5) / 10, 2)::DOUBLE AS band_mid FROM k) """
)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    golden = spark.sql(GOLDEN, lineitem=lineitem).withColumn("path", E.resolved_path(F.col("path")))
    facts = spark.sql(GOT, lineitem=lineitem).where(F.col("status") != "NOT_STATED").join(golden, ["message_id", "path"])
    return E.calibration(facts.select("confidence", V.match_loosely(F.col("expected"), F.col("value")).alias("hit")))


@query("A25", CURVE_SQL + "SELECT * FROM c")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir)


@query("A26", CURVE_SQL + "SELECT round((sum((abs(band_mid - accuracy) * n)::DECIMAL(24,8)) / sum(n))::DOUBLE, 4) AS expected_calibration_error, sum(n)::BIGINT AS n FROM c")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.expected_error(curve(spark, sf_dir))


@query(
    "A24",
    """WITH e AS (SELECT o_orderkey % 2 = 0 AS patient, o_custkey % 3 = 0 AS reporter, o_orderstatus = 'F' AS product, o_custkey % 2 = 0 AS patient_got, o_custkey % 3 = 0 AS reporter_got, o_orderpriority < '3' AS product_got FROM orders),
u AS (SELECT 'patient' AS element, patient = patient_got AS ok FROM e UNION ALL SELECT 'reporter', reporter = reporter_got FROM e UNION ALL SELECT 'product', product = product_got FROM e)
SELECT element, count(*) AS n, round(count(*) FILTER (ok) / count(*), 4) AS agreement FROM u GROUP BY 1""",
)
def element_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    agreed = o.select(
        ((F.col("o_orderkey") % 2 == 0) == (F.col("o_custkey") % 2 == 0)).alias("patient"),
        ((F.col("o_custkey") % 3 == 0) == (F.col("o_custkey") % 3 == 0)).alias("reporter"),
        ((F.col("o_orderstatus") == "F") == (F.col("o_orderpriority") < "3")).alias("product"),
    )
    long = agreed.unpivot([], ["patient", "reporter", "product"], "element", "ok")
    return long.groupBy("element").agg(F.count("*").alias("n"), E.ratio(F.count_if("ok"), F.count("*")).alias("agreement"))


@query(
    "A13",
    with_entities("processing_metric")
    + "SELECT stage, count(*) AS n, CAST(trunc(avg(duration_ms)) AS INT) AS mean_ms, CAST(trunc(median(duration_ms)) AS INT) AS median_ms, max(duration_ms) AS max_ms FROM processing_metric GROUP BY 1",
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stage_timings(entity(spark, sf_dir, "processing_metric"))


COST = "count(*) AS calls, CAST(sum(cost_usd) AS DECIMAL(22,8)) AS cost_usd, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, count(*) FILTER (repaired = 'Y') AS repaired"


@query("A14 A15 A37 A39 L12", with_entities("ai_call_log") + f"SELECT purpose, {COST} FROM ai_call_log GROUP BY 1 ORDER BY cost_usd DESC")
def cost_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cost_by(entity(spark, sf_dir, "ai_call_log"), "purpose").orderBy(F.desc("cost_usd"))


@query(
    "A12 A16 J05",
    with_entities("ai_call_log", "inbox_message") + f"SELECT 'all' AS scope, {COST} FROM ai_call_log UNION ALL SELECT 'live', {COST} FROM ai_call_log WHERE message_id IN (SELECT message_id FROM inbox_message WHERE status = 'REVIEWED')",
)
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = entity(spark, sf_dir, "ai_call_log")
    live = calls.join(entity(spark, sf_dir, "inbox_message").where(F.col("status") == "REVIEWED"), "message_id", "left_semi")
    return E.cost_by(calls.withColumn("scope", F.lit("all")), "scope").unionByName(E.cost_by(live.withColumn("scope", F.lit("live")), "scope"))


@query(
    "X42",
    with_entities("ai_call_log")
    + """SELECT call_id, CAST(greatest(prompt_tokens - cached_tokens - write_tokens, 0)::DECIMAL(18,0) * 1.00::DECIMAL(4,2) + cached_tokens::DECIMAL(18,0) * 0.10::DECIMAL(4,2)
  + write_tokens::DECIMAL(18,0) * 1.25::DECIMAL(4,2) + completion_tokens::DECIMAL(18,0) * 5.00::DECIMAL(4,2) AS DOUBLE) / 1000000 AS estimated_usd FROM ai_call_log""",
)
def call_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, "ai_call_log").select("call_id", E.cost_estimate().alias("estimated_usd"))


TIME_SQL = (
    with_entities("processing_metric", "document", "inbox_message")
    + """, own AS (SELECT subject_id, sum(duration_ms)::BIGINT AS ms FROM processing_metric GROUP BY 1),
of_docs AS (SELECT d.message_id, sum(ms)::BIGINT AS ms FROM document d JOIN own ON own.subject_id = d.document_id % 1000 GROUP BY 1),
t AS (SELECT m.message_id, coalesce(own.ms, 0) AS own_ms, coalesce(of_docs.ms, 0) AS documents_ms, coalesce(own.ms, 0) + coalesce(of_docs.ms, 0) AS total_ms
  FROM inbox_message m LEFT JOIN own ON own.subject_id = m.message_id LEFT JOIN of_docs ON of_docs.message_id = m.message_id) """
)


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, documents, messages = (entity(spark, sf_dir, n) for n in ("processing_metric", "document", "inbox_message"))
    named = documents.withColumn("subject_id", F.col("document_id") % 1000)  # the events know a thousand subjects
    return E.message_time(metrics, named, messages)


@query("A17 O08", TIME_SQL + "SELECT * FROM t WHERE total_ms > 0 ORDER BY total_ms DESC, message_id")
def slowest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = times(spark, sf_dir).where(F.col("total_ms") > 0).orderBy(F.desc("total_ms"), "message_id")
    return found.select("message_id", "own_ms", "documents_ms", "total_ms")


@query("A17 A18", TIME_SQL + "SELECT count(*) AS n, CAST(trunc(avg(total_ms)) AS BIGINT) AS mean_ms, CAST(trunc(median(total_ms)) AS BIGINT) AS median_ms, min(total_ms) AS min_ms, max(total_ms) AS max_ms FROM t WHERE total_ms > 0")
def message_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("total_ms")
    return times(spark, sf_dir).where(t > 0).agg(
        F.count("*").alias("n"), F.avg(t).cast("long").alias("mean_ms"), F.median(t).cast("long").alias("median_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms")
    )


@query(
    "A19 A20 A11",
    with_entities("field_evidence", "extracted_field")
    + """SELECT f.status, count(*) AS total, count(*) FILTER (verified = 'Y') AS verified, count(*) FILTER (verify_method = 'EXACT') AS exact, count(*) FILTER (verify_method = 'FUZZY') AS fuzzy,
 count(*) FILTER (verified <> 'Y') AS unverified, round(count(*) FILTER (verified = 'Y') / count(*), 4) AS rate, count(DISTINCT f.field_id) FILTER (verified = 'Y') AS facts
FROM field_evidence v JOIN extracted_field f USING (field_id) WHERE f.status <> 'NOT_STATED' AND f.superseded_by IS NULL GROUP BY 1""",
)
def verification_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.live(entity(spark, sf_dir, "extracted_field")).where(F.col("status") != "NOT_STATED").select("field_id", "status")
    ok = F.col("verified") == "Y"
    return (
        entity(spark, sf_dir, "field_evidence")
        .join(facts, "field_id")
        .groupBy("status")
        .agg(
            F.count("*").alias("total"),
            F.count_if(ok).alias("verified"),
            F.count_if(F.col("verify_method") == "EXACT").alias("exact"),
            F.count_if(F.col("verify_method") == "FUZZY").alias("fuzzy"),
            F.count_if(~ok).alias("unverified"),
            E.ratio(F.count_if(ok), F.count("*")).alias("rate"),
            F.count_distinct(F.when(ok, F.col("field_id"))).alias("facts"),
        )
    )


@query(
    "A27",
    """WITH m AS (SELECT o_orderkey, o_orderstatus, ['E' || (o_orderkey % 12 + 1), 'E' || (o_custkey % 30 + 1)] AS edges FROM orders), x AS (SELECT o_orderkey, o_orderstatus, unnest(edges) AS edge FROM m)
SELECT edge, CAST(substr(edge, 2) AS INT) AS number, count(DISTINCT o_orderkey) AS messages, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS processed FROM x GROUP BY 1, 2""",
)
def edge_case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(F.concat(F.lit("E"), (F.col("o_orderkey") % 12 + 1).cast("string")), F.concat(F.lit("E"), (F.col("o_custkey") % 30 + 1).cast("string")))
    each = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array_distinct(edges)).alias("edge"))
    found = each.groupBy("edge").agg(F.count("*").alias("messages"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))
    return found.withColumn("number", F.substring("edge", 2, 9).cast("int")).orderBy("number")
