"""Labels, attention, the completion barrier and the derived state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review as R
from ..operators import rules as L
from ..sources.tables import entity, table, with_entities
from .registry import query

#: Classifier answers over orders: which elements are present, and how sure of each.
UNITS = """
SELECT o_orderkey AS message_id, o_orderkey % 2 = 0 OR o_orderkey % 5 = 1 AS has_identifiable_patient, o_custkey % 3 <> 0 AS has_identifiable_reporter,
  o_orderstatus <> 'P' AS has_suspect_product, o_totalprice < 300000 AS has_adverse_event,
  CAST(0.5 + (o_orderkey % 50) / 100.0 AS DECIMAL(5,4)) AS has_identifiable_patient_conf, CAST(0.4 + (o_custkey % 60) / 100.0 AS DECIMAL(5,4)) AS has_identifiable_reporter_conf,
  CAST(0.3 + (o_orderkey % 70) / 100.0 AS DECIMAL(5,4)) AS has_suspect_product_conf, CAST(0.6 + (o_custkey % 40) / 100.0 AS DECIMAL(5,4)) AS has_adverse_event_conf,
  o_custkey % 4 = 0 AS pqc_applies, o_orderkey % 3 = 0 AS has_physical_defect, o_custkey % 5 = 0 AS mi_applies, o_orderkey % 2 = 1 AS has_genuine_question
FROM {orders}"""


@query(
    "R01 R02 R03 R05 J16 A41 L02",
    "WITH u AS ("
    + UNITS.format(orders="orders")
    + """), n AS (SELECT *, has_identifiable_patient::INT + has_identifiable_reporter::INT + has_suspect_product::INT + has_adverse_event::INT AS elements_present,
  concat_ws(', ', CASE WHEN NOT has_identifiable_patient THEN 'identifiable patient' END, CASE WHEN NOT has_identifiable_reporter THEN 'identifiable reporter' END,
    CASE WHEN NOT has_suspect_product THEN 'suspect product' END, CASE WHEN NOT has_adverse_event THEN 'adverse event' END) AS missing FROM u),
l AS (SELECT *, CASE WHEN elements_present = 4 THEN 'ICSR' WHEN elements_present >= 2 AND has_adverse_event THEN 'ICSR_INCOMPLETE' END AS label FROM n)
SELECT message_id, elements_present, missing, label,
  CAST(CASE label WHEN 'ICSR' THEN least(has_identifiable_patient_conf, has_identifiable_reporter_conf, has_suspect_product_conf, has_adverse_event_conf)
    WHEN 'ICSR_INCOMPLETE' THEN CAST(round((CASE WHEN has_identifiable_patient THEN has_identifiable_patient_conf ELSE 0 END + CASE WHEN has_identifiable_reporter THEN has_identifiable_reporter_conf ELSE 0 END
      + CASE WHEN has_suspect_product THEN has_suspect_product_conf ELSE 0 END + has_adverse_event_conf)::DECIMAL(18,4) * (12 / elements_present)::INT / 12.0::DECIMAL(4,1), 4) AS DECIMAL(9,4)) END AS DECIMAL(9,4)) AS label_confidence,
  CASE label WHEN 'ICSR' THEN 'All four minimum criteria are present.' WHEN 'ICSR_INCOMPLETE' THEN elements_present || ' of 4 minimum criteria present; missing ' || missing || '.' END AS reason,
  coalesce(nullif(concat_ws(',', label, CASE WHEN pqc_applies AND has_physical_defect THEN 'PQC' END, CASE WHEN mi_applies AND has_genuine_question THEN 'MI' END), ''), 'NOT_RELEVANT') AS labels
FROM l""",
)
def icsr_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.sql(UNITS, orders=table(spark, sf_dir, "orders"))
    labels = L.gated_labels(F.col("label"), F.col("pqc_applies"), F.col("has_physical_defect"), F.col("mi_applies"), F.col("has_genuine_question"))
    return L.icsr_rule(units).select("message_id", "elements_present", "missing", "label", "label_confidence", "reason", F.array_join(labels, ",").alias("labels"))


@query(
    "A32 R04 U01 W04",
    with_entities("classification")
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY message_id, category ORDER BY confidence DESC, unit_pos, decided_by, tie) AS nth FROM classification),
k AS (SELECT *, count(*) FILTER (category <> 'NOT_RELEVANT') OVER (PARTITION BY message_id) AS relevant FROM b WHERE nth = 1)
SELECT message_id, category, confidence, unit_pos, row_number() OVER (PARTITION BY message_id ORDER BY confidence DESC, category)::INT AS place
FROM k WHERE category <> 'NOT_RELEVANT' OR relevant = 0""",
)
def message_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.message_labels(entity(spark, sf_dir, "classification"), tie=("unit_pos", "decided_by", "tie"))
    return found.select("message_id", "category", "confidence", "unit_pos", "place")


ATTENTION = ("inbox_message", "case_record", "extracted_field", "field_evidence", "classification", "document")


@query(
    "A31 R11",
    with_entities(*ATTENTION)
    + """, d AS (SELECT message_id, count(*) FILTER (parse_status = 'PARSE_FAILED') AS failed, count(*) FILTER (truncated = 'Y') AS truncated FROM document GROUP BY 1),
e AS (SELECT r.message_id, count(*) AS unverified FROM field_evidence v JOIN extracted_field f USING (field_id) JOIN case_record r ON r.case_id = f.case_id WHERE v.verified = 'N' AND f.superseded_by IS NULL GROUP BY 1),
f AS (SELECT r.message_id, count(*) FILTER (f.status = 'CONFLICT') AS conflicts, count(*) FILTER (f.status IN ('STATED','UNCERTAIN') AND f.confidence < 0.4) AS low
  FROM extracted_field f JOIN case_record r ON r.case_id = f.case_id WHERE f.superseded_by IS NULL GROUP BY 1),
c AS (SELECT message_id, count(*) FILTER (category = 'ICSR_INCOMPLETE') AS incomplete FROM classification WHERE superseded_by IS NULL GROUP BY 1)
SELECT m.message_id, nullif(concat_ws('; ', CASE WHEN failed > 0 THEN failed || ' document(s) could not be parsed' END,
  CASE WHEN unverified > 0 THEN unverified || ' citation(s) could not be verified against the source' END, CASE WHEN conflicts > 0 THEN conflicts || ' field(s) where sources disagree' END,
  CASE WHEN truncated > 0 THEN truncated || ' document(s) exceeded the page cap and were truncated' END, CASE WHEN incomplete > 0 THEN 'ICSR is missing one or more minimum criteria' END,
  CASE WHEN low > 0 THEN low || ' field(s) below 0.40 confidence' END), '') AS attention_reason
FROM inbox_message m LEFT JOIN d USING (message_id) LEFT JOIN e USING (message_id) LEFT JOIN f USING (message_id) LEFT JOIN c USING (message_id)""",
)
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {n: entity(spark, sf_dir, n) for n in ATTENTION}
    weak = F.count_if(F.col("status").isin("STATED", "UNCERTAIN") & (F.col("confidence") < 0.4)).alias("low_confidence")
    facts = R.live(e["extracted_field"]).join(e["case_record"].select("case_id", "message_id"), "case_id")
    facts = facts.groupBy("message_id").agg(F.count_if(F.col("status") == "CONFLICT").alias("conflict_count"), weak)
    labels = R.live(e["classification"]).groupBy("message_id").agg(F.count_if(F.col("category") == "ICSR_INCOMPLETE").alias("incomplete_labels"))
    parts = (R.document_rollup(e["document"]), R.evidence_rollup(e["field_evidence"], e["extracted_field"], e["case_record"]), facts, labels)
    out = e["inbox_message"].select("message_id")
    for part in parts:
        out = out.join(part, "message_id", "left")
    return out.select("message_id", L.attention_reason().alias("attention_reason"))


STATE = ("inbox_message", "document", "job", "classification", "case_record", "review_decision")


@query(
    "A28 R13 R14 J07 A29",
    with_entities("inbox_message", "document", "job")
    + """, b AS (SELECT message_id, count(*) AS documents, count(*) FILTER (parse_status NOT IN ('PARSED','PARSE_FAILED')) AS outstanding FROM document GROUP BY 1)
SELECT m.message_id, b.documents, b.outstanding FROM inbox_message m JOIN b USING (message_id)
WHERE outstanding = 0 AND m.message_id NOT IN (SELECT subject_id FROM job WHERE job_type = 'CLASSIFY_MESSAGE' AND state IN ('PENDING','RUNNING','DONE'))""",
)
def barrier_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.next_step(entity(spark, sf_dir, "inbox_message"), L.barrier(entity(spark, sf_dir, "document")), entity(spark, sf_dir, "job"))
    return found.select("message_id", "documents", "outstanding")


@query(
    "R12",
    with_entities("inbox_message", "document", "classification", "case_record", "review_decision")
    + """, b AS (SELECT message_id, count(*) AS documents, count(*) FILTER (parse_status NOT IN ('PARSED','PARSE_FAILED')) = 0 AS done FROM document GROUP BY 1),
l AS (SELECT message_id, bool_or(category <> 'NOT_RELEVANT') AS relevant FROM classification WHERE superseded_by IS NULL GROUP BY 1),
x AS (SELECT message_id, arg_max(decision, decision_id) AS decision FROM review_decision GROUP BY 1)
SELECT m.message_id, CASE WHEN x.decision = 'REJECT' THEN 'REJECTED' WHEN x.decision IS NOT NULL THEN 'REVIEWED' WHEN m.needs_attention = 'Y' AND coalesce(b.done, false) THEN 'READY_FOR_REVIEW'
  WHEN coalesce(l.relevant, false) AND coalesce(b.done, false) THEN 'EXTRACTING' WHEN l.relevant IS NOT NULL AND coalesce(b.done, false) THEN 'CLASSIFIED' WHEN b.done THEN 'PARSED'
  WHEN b.documents > 0 THEN 'PARSING' ELSE 'RECEIVED' END AS derived_status
FROM inbox_message m LEFT JOIN b USING (message_id) LEFT JOIN l USING (message_id) LEFT JOIN x USING (message_id)""",
)
def message_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = R.live(entity(spark, sf_dir, "classification")).groupBy("message_id").agg(F.bool_or(F.col("category") != "NOT_RELEVANT").alias("relevant"))
    decided = entity(spark, sf_dir, "review_decision").groupBy("message_id").agg(F.max_by("decision", "decision_id").alias("last_decision"))
    rows = entity(spark, sf_dir, "inbox_message").join(L.barrier(entity(spark, sf_dir, "document")), "message_id", "left").join(labels, "message_id", "left").join(decided, "message_id", "left")
    done = F.coalesce("all_terminal", F.lit(False))
    rows = rows.withColumns(
        {
            "finalised": (F.col("needs_attention") == "Y") & done,
            "extracted": F.coalesce("relevant", F.lit(False)) & done,
            "labelled": F.col("relevant").isNotNull() & done,
            "all_terminal": done,
        }
    )
    return rows.select("message_id", L.derived_status().alias("derived_status"))


@query(
    "J21 R15 J15 P24 P25",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN trim(text) IN ('', 'null') THEN NULL ELSE text END AS text FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '[This attachment could not be read: parse_failed]' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS unit,
  substr(arg_min(text, turn), 1, 40) AS head FROM t WHERE text IS NOT NULL GROUP BY conv_id""",
)
def unit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a unit in order, blank ones dropped, joined by blank lines. Turns stand for pages."""
    blank = F.trim("text").isin("", "null")
    pages = table(spark, sf_dir, "conversations").where(~blank)
    status = F.when(F.col("role") == "system", "PARSE_FAILED").otherwise("PARSED")
    pages = pages.withColumn("shown", L.unit_text(F.col("role"), status, F.col("text")))
    units = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "shown"))).alias("pages"), F.min_by("text", "turn").alias("first"))
    return units.select("conv_id", F.array_join(F.transform("pages", lambda p: p["shown"]), "\n\n").alias("unit"), F.substring("first", 1, 40).alias("head"))


@query(
    "R23 R22",
    "WITH u AS ("
    + UNITS.format(orders="orders")
    + """), n AS (SELECT *, has_identifiable_patient::INT + has_identifiable_reporter::INT + has_suspect_product::INT + has_adverse_event::INT AS k FROM u),
l AS (SELECT CASE WHEN k = 4 THEN 'ICSR' WHEN k >= 2 THEN 'ICSR_INCOMPLETE' END AS golden, CASE WHEN k = 4 THEN 'ICSR' WHEN k >= 2 AND has_adverse_event THEN 'ICSR_INCOMPLETE' END AS decided FROM n)
SELECT golden, decided, count(*) AS n FROM l GROUP BY 1, 2""",
)
def golden_against_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden labels' rule beside the deciding one, which also asks for an adverse event."""
    ruled = L.icsr_rule(spark.sql(UNITS, orders=table(spark, sf_dir, "orders")))
    n = F.col("elements_present")
    golden = F.when(n == 4, "ICSR").when(n >= 2, "ICSR_INCOMPLETE")
    return ruled.groupBy(golden.alias("golden"), F.col("label").alias("decided")).agg(F.count("*").alias("n"))
