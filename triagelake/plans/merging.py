"""Merging and flattening of extracted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten as X
from ..operators import merging as M
from ..sources.tables import entity, table, with_entities
from .evaluation import LOOSE_SQL, MATCH_SQL, score_sql
from .registry import query

MERGE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(value_text, ''))), '\s*(years?|yrs?|y\.?o\.?|months?|weeks?|days?|kg|kgs|lb|lbs|mg|ml)\b\.?', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sourced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = entity(spark, sf_dir, "field_evidence").groupBy("field_id").agg(F.max("verified").alias("verified"))
    return entity(spark, sf_dir, "extracted_field").join(proved, "field_id")


FACTS_SQL = (
    with_entities("extracted_field", "field_evidence")
    + f""", f AS (SELECT e.case_id, e.field_path, e.field_group, e.field_id, e.value_text, e.confidence, v.verified, e.status, {MERGE_SQL} AS folded FROM extracted_field e JOIN (SELECT field_id, max(verified) AS verified FROM field_evidence GROUP BY 1) v USING (field_id)),
o AS (SELECT *, status <> 'NOT_STATED' AS asserts, row_number() OVER w AS place FROM f WINDOW w AS (PARTITION BY case_id, field_path ORDER BY field_id, value_text, confidence, verified, status)),
d AS (SELECT *, asserts AND row_number() OVER (PARTITION BY case_id, field_path, asserts, folded ORDER BY place) = 1 AS is_new FROM o),
g AS (SELECT case_id, field_path, any_value(field_group) AS field_group, count(*) FILTER (asserts)::INT AS asserting, count(*) FILTER (is_new)::INT AS distinct_values, string_agg(value_text, ' | ' ORDER BY place) FILTER (is_new) AS values,
   max(least(confidence, 0.5)) FILTER (is_new) AS cap FROM d GROUP BY 1, 2),
b AS (SELECT case_id, field_path, value_text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field_path ORDER BY verified = 'Y' DESC, confidence DESC, place) AS nth FROM o WHERE asserts) WHERE nth = 1),
r AS (SELECT g.*, CASE WHEN asserting = 0 THEN 'ABSTAINED' WHEN asserting = 1 THEN 'SINGLE' WHEN distinct_values > 1 AND field_group <> 'NARRATIVE' THEN 'CONFLICT' ELSE 'MERGED' END AS outcome FROM g)"""
)


@query(
    "R09 R10 X08 X09 U02",
    FACTS_SQL
    + """
SELECT r.case_id, r.field_path, outcome, asserting, distinct_values, CASE WHEN outcome = 'CONFLICT' THEN values ELSE b.value_text END AS kept, CASE WHEN outcome = 'CONFLICT' THEN cap ELSE b.confidence END::DECIMAL(9,4) AS confidence
FROM r LEFT JOIN b ON b.case_id = r.case_id AND b.field_path = r.field_path""",
)
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged(sourced_facts(spark, sf_dir), ["case_id", "field_path"], ["field_id"])


@query(
    "R09 R10",
    FACTS_SQL
    + """, c AS (SELECT d.*, outcome FROM d JOIN r ON r.case_id = d.case_id AND r.field_path = d.field_path),
s AS (SELECT * FROM c WHERE outcome = 'CONFLICT' AND is_new
 UNION ALL SELECT * FROM c WHERE outcome IN ('SINGLE', 'MERGED') AND asserts QUALIFY row_number() OVER (PARTITION BY case_id, field_path ORDER BY verified = 'Y' DESC, confidence DESC, place) = 1
 UNION ALL SELECT * FROM c WHERE outcome = 'ABSTAINED' AND place = 1)
SELECT case_id, field_path, field_id, value_text, CASE WHEN outcome = 'CONFLICT' THEN 'CONFLICT' ELSE status END AS status,
 CASE WHEN outcome = 'CONFLICT' THEN least(confidence, 0.5) ELSE confidence END::DECIMAL(9,4) AS confidence,
 CASE WHEN outcome <> 'CONFLICT' THEN '' WHEN confidence > 0.5 THEN 'sources disagree, capped at 0.50' ELSE 'sources disagree' END AS adjust_reason FROM s""",
)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged_rows(sourced_facts(spark, sf_dir), ["case_id", "field_path"], ["field_id"])


REACTIONS = """SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'N' THEN 'NOT_STATED' ELSE 'STATED' END AS status, l_tax, l_linenumber FROM {lineitem}"""


@query(
    "A40",
    f"WITH x AS ({REACTIONS.format(lineitem='lineitem')}), c AS (SELECT *, CASE WHEN l_tax > 0.06 THEN ['DEATH', 'HOSPITALISATION'] WHEN l_tax > 0.03 THEN ['DISABILITY'] ELSE [] END AS criteria FROM x)"
    " SELECT case_id, bool_or(status = 'STATED' AND len(criteria) > 0) AS is_serious, array_to_string(list_sort(flatten(list(criteria))), ',') AS criteria FROM c GROUP BY 1",
)
def case_seriousness(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("l_tax") > 0.06, F.array(F.lit("DEATH"), F.lit("HOSPITALISATION"))).when(F.col("l_tax") > 0.03, F.array(F.lit("DISABILITY"))).otherwise(F.array().cast("array<string>"))
    reactions = spark.sql(REACTIONS, lineitem=table(spark, sf_dir, "lineitem")).withColumn("criteria", listed)
    return X.seriousness(reactions, "case_id").select("case_id", "is_serious", F.array_join(F.sort_array("criteria"), ",").alias("criteria"))


VALUES = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Dr Jane Example' WHEN 2 THEN 'acute renal failure grade 2' WHEN 3 THEN '58 years' ELSE 'female' END AS expected,
 CASE l_suppkey % 7 WHEN 0 THEN 'Jane Example' WHEN 1 THEN 'grade 2 acute renal failure' WHEN 2 THEN '58 y.o.' WHEN 3 THEN 'male' WHEN 4 THEN 'FEMALE!' WHEN 5 THEN NULL ELSE 'renal trouble' END AS value FROM {lineitem}"""


@query(
    "X10 X11 U04",
    "WITH v AS (" + VALUES.format(lineitem="lineitem") + f"), n AS (SELECT *, {score_sql('expected')} AS a, {score_sql('value')} AS b FROM v) SELECT expected, value, {MATCH_SQL} AS strict, {LOOSE_SQL} AS loose, count(*) AS n FROM n GROUP BY 1, 2, 3, 4",
)
def value_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import values as V

    rows = spark.sql(VALUES, lineitem=table(spark, sf_dir, "lineitem"))
    judged = rows.select("expected", "value", V.match(F.col("expected"), F.col("value")).alias("strict"), V.match_loosely(F.col("expected"), F.col("value")).alias("loose"))
    return judged.groupBy("expected", "value", "strict", "loose").agg(F.count("*").alias("n"))


@query(
    "R06 R08 L03 L04 L05 A40 A41",
    """WITH c AS (SELECT o_orderkey AS case_id, o_custkey % 90 AS age, CASE WHEN o_custkey % 3 = 0 THEN 'UNKNOWN' ELSE 'FEMALE' END AS sex, o_orderkey % 3 AS n, o_orderdate AS onset, o_totalprice > 250000 AS serious FROM orders),
r AS (SELECT case_id, 'patient.age' AS field_path, 'PATIENT' AS field_group, CAST(age AS VARCHAR) AS value_text, 'STATED' AS status FROM c
 UNION ALL SELECT case_id, 'patient.sex', 'PATIENT', CASE WHEN sex = 'UNKNOWN' THEN '' ELSE sex END, CASE WHEN sex = 'UNKNOWN' THEN 'NOT_STATED' ELSE 'STATED' END FROM c
 UNION ALL SELECT case_id, 'reaction.onset_date', 'REACTION', CAST(CAST(onset AS DATE) AS VARCHAR), 'STATED' FROM c
 UNION ALL SELECT case_id, 'severity.is_serious', 'SEVERITY', CASE WHEN serious THEN 'true' ELSE 'false' END, 'STATED' FROM c
 UNION ALL SELECT case_id, 'product[' || i || '].name', 'PRODUCT', 'drug ' || (case_id + i), 'STATED' FROM (SELECT case_id, unnest(range(0, n)) AS i FROM c))
SELECT * FROM r""",
)
def flattened_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.flatten(X.cases(table(spark, sf_dir, "orders")))
