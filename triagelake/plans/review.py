"""The review queue, its filters and pages, the counters above it, and the reads behind a message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import review as R
from ..sources.tables import entity, with_entities
from .registry import query

QUEUE = ("inbox_message", "case_record", "extracted_field", "field_evidence", "classification", "document", "review_decision", "job")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {n: entity(spark, sf_dir, n) for n in QUEUE}
    return R.review_queue(
        e["inbox_message"], e["classification"], e["document"], e["case_record"], e["extracted_field"], e["field_evidence"], e["review_decision"], e["job"]
    )


QUEUE_SQL = (
    with_entities(*QUEUE)
    + """, queue AS (
SELECT m.*,
  (SELECT string_agg(category, ',' ORDER BY category) FROM classification c WHERE c.message_id = m.message_id AND superseded_by IS NULL) AS categories,
  (SELECT max(confidence) FROM classification c WHERE c.message_id = m.message_id AND superseded_by IS NULL) AS max_label_confidence,
  (SELECT count(*) FROM document d WHERE d.message_id = m.message_id) AS document_count,
  (SELECT count(*) FROM document d WHERE d.message_id = m.message_id AND parse_status = 'PARSE_FAILED') AS failed_documents,
  (SELECT count(*) FROM document d WHERE d.message_id = m.message_id AND truncated = 'Y') AS truncated_documents,
  (SELECT count(*) FROM case_record r WHERE r.message_id = m.message_id) AS case_count,
  (SELECT min(f.confidence) FROM extracted_field f JOIN case_record r ON r.case_id = f.case_id WHERE r.message_id = m.message_id
     AND f.superseded_by IS NULL AND f.field_group <> 'NARRATIVE' AND f.status IN ('STATED','UNCERTAIN','CONFLICT')) AS min_field_confidence,
  (SELECT count(*) FROM extracted_field f JOIN case_record r ON r.case_id = f.case_id WHERE r.message_id = m.message_id
     AND f.superseded_by IS NULL AND f.status = 'CONFLICT') AS conflict_count,
  (SELECT count(*) FROM field_evidence v JOIN extracted_field f ON f.field_id = v.field_id JOIN case_record r ON r.case_id = f.case_id
     WHERE r.message_id = m.message_id AND f.superseded_by IS NULL AND v.verified = 'N') AS unverified_evidence,
  (SELECT max(decided_at) FROM review_decision x WHERE x.message_id = m.message_id) AS last_reviewed_at,
  (SELECT count(*) FROM job j WHERE j.subject_id = m.message_id AND j.state = 'DEAD') AS dead_jobs
FROM inbox_message m)
"""
)
WORST = "ORDER BY needs_attention DESC NULLS FIRST, coalesce(min_field_confidence, 2), received_at NULLS LAST, message_id"


@query(
    "S08 P01 P02 P03 J01 J08 A05 A07 O01 X53",
    with_entities("inbox_message", "case_record", "extracted_field")
    + """SELECT m.message_id, received_at, subject, status, needs_attention, min_field_confidence, coalesce(conflict_count, 0) AS conflict_count
FROM inbox_message m LEFT JOIN (
  SELECT r.message_id, min(CASE WHEN f.status IN ('STATED','UNCERTAIN','CONFLICT') AND f.field_group <> 'NARRATIVE' THEN f.confidence END) AS min_field_confidence,
         count(*) FILTER (f.status = 'CONFLICT') AS conflict_count
  FROM extracted_field f JOIN case_record r ON r.case_id = f.case_id WHERE superseded_by IS NULL GROUP BY r.message_id) x ON x.message_id = m.message_id
ORDER BY needs_attention DESC NULLS FIRST, coalesce(min_field_confidence, 2), received_at NULLS LAST, m.message_id LIMIT 500""",
)
def review_queue_worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = entity(spark, sf_dir, "inbox_message")
    rollup = R.field_rollup(entity(spark, sf_dir, "extracted_field"), entity(spark, sf_dir, "case_record"))
    found = messages.join(rollup, "message_id", "left").fillna(0, subset=["conflict_count"])
    found = found.orderBy(*R.worst_first(found)).limit(500)
    return found.select("message_id", "received_at", "subject", "status", "needs_attention", "min_field_confidence", "conflict_count")


@query("A01 A02 A03 A04 A05 A06 A07 A08 A09 J02 J08 P01", QUEUE_SQL + "SELECT * FROM queue")
def review_queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir)


@query(
    "P04 P05 P06 P07 O01 O02",
    QUEUE_SQL
    + f""", hits AS (SELECT * FROM queue WHERE status = 'REVIEWED' AND categories LIKE '%ICSR%'
   AND (needs_attention = 'Y' OR unverified_evidence > 0 OR conflict_count > 0) AND (lower(subject) LIKE '%building%' OR lower(sender_email) LIKE '%building%'))
SELECT message_id, subject, categories, min_field_confidence, (SELECT count(*) FROM hits) AS total FROM hits {WORST} LIMIT 50 OFFSET 50""",
)
def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.queue_filter(queue(spark, sf_dir), status="REVIEWED", category="ICSR", flagged=True, search="BUILDING")
    return R.queue_page(hits, page=1, size=50).select("message_id", "subject", "categories", "min_field_confidence", "total")


@query(
    "P18 P19 P20 P23 P26 A43 X36 X37 X55",
    QUEUE_SQL
    + """SELECT message_id, status IN ('READY_FOR_REVIEW','REVIEWED','REJECTED','NEEDS_ATTENTION') AS decidable,
  CASE WHEN min_field_confidence IS NULL THEN 'none' WHEN min_field_confidence >= 0.7 THEN 'high' WHEN min_field_confidence >= 0.4 THEN 'mid' ELSE 'low' END AS band,
  concat_ws(', ', CASE WHEN unverified_evidence > 0 THEN unverified_evidence || ' unverified' END, CASE WHEN conflict_count > 0 THEN conflict_count || ' conflict' END,
    CASE WHEN failed_documents > 0 THEN failed_documents || ' unreadable' END, CASE WHEN truncated_documents > 0 THEN 'truncated' END, CASE WHEN dead_jobs > 0 THEN 'dead job' END) AS flags,
  CASE status WHEN 'REVIEWED' THEN 'ok' WHEN 'REJECTED' THEN 'muted' WHEN 'NEEDS_ATTENTION' THEN 'bad' WHEN 'READY_FOR_REVIEW' THEN 'info' ELSE 'busy' END AS tone,
  upper(substr(status, 1, 1)) || lower(replace(substr(status, 2), '_', ' ')) AS label,
  CASE WHEN max_label_confidence IS NOT NULL THEN CAST(CAST(round(least(greatest(max_label_confidence, 0), 1) * 100, 0) AS INT) AS VARCHAR) || '%' END AS percent
FROM queue""",
)
def queue_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = F.least(F.greatest("max_label_confidence", F.lit(0)), F.lit(1))
    return queue(spark, sf_dir).select(
        "message_id",
        F.col("status").isin(*R.DECIDABLE).alias("decidable"),
        R.confidence_band(F.col("min_field_confidence")).alias("band"),
        F.array_join(R.attention_flags(), ", ").alias("flags"),
        R.status_tone(F.col("status")).alias("tone"),
        R.humanise(F.col("status")).alias("label"),
        F.when(F.col("max_label_confidence").isNotNull(), R.percent(clamped)).alias("percent"),
    )


@query(
    "O03",
    QUEUE_SQL
    + """SELECT message_id, status, row_number() OVER (PARTITION BY status ORDER BY coalesce(min_field_confidence, 2), message_id)::INT AS by_confidence,
  row_number() OVER (PARTITION BY status ORDER BY received_at DESC NULLS LAST, message_id)::INT AS by_received,
  row_number() OVER (PARTITION BY status ORDER BY lower(sender_name) NULLS LAST, message_id)::INT AS by_sender FROM queue""",
)
def queue_client_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.client_sorts(queue(spark, sf_dir))


@query(
    "A10 A11 A12 J04 J05 J06 A42 X55",
    with_entities("inbox_message", "case_record", "extracted_field", "field_evidence", "document", "job", "ai_call_log")
    + """, e AS (SELECT count(*) AS n, count(*) FILTER (v.verified = 'Y') AS ok FROM field_evidence v JOIN extracted_field f ON f.field_id = v.field_id
  WHERE f.status IN ('STATED','UNCERTAIN','CONFLICT') AND f.superseded_by IS NULL),
c AS (SELECT count(*) AS n, sum(cost_usd) AS cost, sum(prompt_tokens) AS prompt, sum(cached_tokens) AS cached FROM ai_call_log a JOIN job j ON j.job_id = a.job_id
  WHERE j.subject_id IN (SELECT message_id FROM inbox_message) OR j.subject_id IN (SELECT document_id FROM document))
SELECT (SELECT count(*) FROM inbox_message) AS messages, (SELECT count(*) FROM inbox_message WHERE status = 'REVIEWED') AS reviewed,
  (SELECT count(*) FROM inbox_message WHERE status = 'READY_FOR_REVIEW') AS ready, (SELECT count(*) FROM inbox_message WHERE needs_attention = 'Y') AS attention,
  (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM document WHERE parse_status = 'PARSED') AS parsed,
  (SELECT count(*) FROM document WHERE parse_status = 'PARSE_FAILED') AS failed, (SELECT count(*) FROM case_record) AS cases,
  (SELECT count(*) FROM job WHERE state = 'DEAD') AS dead_jobs, (SELECT count(*) FROM job WHERE state = 'PENDING') AS pending_jobs,
  round(coalesce(e.ok / nullif(e.n, 0), 0), 3) AS verification_rate, c.n AS calls, CAST(c.cost AS DECIMAL(22,8)) AS cost_usd, round(c.cached / nullif(c.prompt, 0), 3) AS cache_hit_rate
FROM e, c""",
)
def overview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, documents = entity(spark, sf_dir, "inbox_message"), entity(spark, sf_dir, "document")
    jobs, calls = entity(spark, sf_dir, "job"), entity(spark, sf_dir, "ai_call_log")
    fields, evidence = entity(spark, sf_dir, "extracted_field"), entity(spark, sf_dir, "field_evidence")

    def when(column: str, value: str, name: str):
        return F.count_if(F.col(column) == value).alias(name)

    facts = R.live(R.asserting(fields)).select("field_id")
    proved = evidence.join(facts, "field_id").agg(F.count("*").alias("n"), F.count_if(F.col("verified") == "Y").alias("ok"))
    rate = F.round(F.coalesce(F.try_divide("ok", "n"), F.lit(0.0)), 3).alias("verification_rate")
    of_message = jobs.join(messages, jobs["subject_id"] == messages["message_id"], "left_semi").select("job_id")
    of_document = jobs.join(documents, jobs["subject_id"] == documents["document_id"], "left_semi").select("job_id")
    spent = (
        calls.join(of_message.union(of_document).distinct(), "job_id")
        .agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.sum("prompt_tokens").alias("prompt"), F.sum("cached_tokens").alias("cached"))
        .select("calls", F.col("cost_usd").cast("decimal(22,8)").alias("cost_usd"), F.round(F.try_divide("cached", "prompt"), 3).alias("cache_hit_rate"))
    )
    parts = (
        messages.agg(F.count("*").alias("messages"), when("status", "REVIEWED", "reviewed"), when("status", "READY_FOR_REVIEW", "ready"), when("needs_attention", "Y", "attention")),
        documents.agg(F.count("*").alias("documents"), when("parse_status", "PARSED", "parsed"), when("parse_status", "PARSE_FAILED", "failed")),
        entity(spark, sf_dir, "case_record").agg(F.count("*").alias("cases")),
        jobs.agg(when("state", "DEAD", "dead_jobs"), when("state", "PENDING", "pending_jobs")),
        proved.select(rate),
        spent,
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # single rows
    return out


@query(
    "O05 P22 J10",
    with_entities("extracted_field")
    + """SELECT field_id, case_id, field_path, CASE WHEN field_group = 'NARRATIVE' THEN 'summarised, not quoted' WHEN regexp_matches(field_path, '\\.(role|route)$') THEN 'implied by context'
   ELSE 'no quote was given' END AS no_citation,
 row_number() OVER (PARTITION BY case_id ORDER BY CASE field_group WHEN 'PATIENT' THEN 1 WHEN 'REPORTER' THEN 2 WHEN 'PRODUCT' THEN 3 WHEN 'REACTION' THEN 4 WHEN 'SEVERITY' THEN 5 ELSE 6 END,
   field_index, field_path, field_id)::INT AS place
FROM extracted_field WHERE superseded_by IS NULL""",
)
def field_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(R.group_rank(F.col("field_group")), "field_index", "field_path", "field_id")
    fields = R.live(entity(spark, sf_dir, "extracted_field"))
    return fields.select("field_id", "case_id", "field_path", R.no_citation_reason().alias("no_citation"), F.row_number().over(order).alias("place"))


@query(
    "J10 J03 J09 P08 S16 S19 P21",
    with_entities("inbox_message", "case_record", "extracted_field", "field_evidence", "document")
    + """, v AS (SELECT field_id, count(*) AS total, count(*) FILTER (verified = 'Y') AS ok FROM field_evidence GROUP BY field_id),
f AS (SELECT r.message_id, string_agg(f.field_path || '=' || f.value_text || '(' || coalesce(v.ok, 0) || '/' || coalesce(v.total, 0) || ')', ';' ORDER BY f.field_path, f.field_id, f.value_text) AS facts
  FROM extracted_field f JOIN case_record r ON r.case_id = f.case_id LEFT JOIN v ON v.field_id = f.field_id WHERE f.superseded_by IS NULL GROUP BY r.message_id),
d AS (SELECT message_id, string_agg(kind || ':' || parse_status, ';' ORDER BY document_id, kind, parse_status) AS documents FROM document GROUP BY message_id)
SELECT m.message_id AS "messageId", m.sender_name AS "senderName", lpad(CAST(m.message_id AS VARCHAR), 8, '0') || '_' || substr(regexp_replace(m.subject, '[^A-Za-z0-9]+', '_', 'g'), 1, 70) || '.json' AS "fileName",
  f.facts, d.documents FROM inbox_message m LEFT JOIN f ON f.message_id = m.message_id LEFT JOIN d ON d.message_id = m.message_id""",
)
def message_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested detail of every message, flattened to text so that engines can be compared."""
    counted = entity(spark, sf_dir, "field_evidence").groupBy("field_id").agg(F.count("*").alias("total"), F.count_if(F.col("verified") == "Y").alias("ok"))
    facts = R.live(entity(spark, sf_dir, "extracted_field")).join(entity(spark, sf_dir, "case_record").select("case_id", "message_id"), "case_id").join(counted, "field_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    line = F.concat("field_path", F.lit("="), "value_text", F.lit("("), count(F.col("ok")), F.lit("/"), count(F.col("total")), F.lit(")"))
    facts = facts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("field_path", "field_id", "value_text", line.alias("line")))).alias("x"))
    documents = entity(spark, sf_dir, "document").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "kind", "parse_status"))).alias("y"))
    file = F.concat(F.lpad(F.col("message_id").cast("string"), 8, "0"), F.lit("_"), F.substring(F.regexp_replace("subject", "[^A-Za-z0-9]+", "_"), 1, 70), F.lit(".json"))
    joined = entity(spark, sf_dir, "inbox_message").join(facts, "message_id", "left").join(documents, "message_id", "left")
    return joined.select(
        F.col("message_id").alias("messageId"),
        F.col("sender_name").alias("senderName"),
        file.alias("fileName"),
        F.array_join(F.transform("x", lambda r: r["line"]), ";").alias("facts"),
        F.array_join(F.transform("y", lambda r: F.concat(r["kind"], F.lit(":"), r["parse_status"])), ";").alias("documents"),
    )


@query(
    "O06 S23 P23 X36",
    with_entities("audit_event")
    + """SELECT audit_id, entity_id, actor_type, CASE action WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'ok' ELSE 'muted' END AS tone,
 row_number() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC, audit_id DESC)::INT AS place FROM audit_event""",
)
def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("occurred_at"), F.desc("audit_id")))
    tone = F.when(F.col("action") == "error", "bad").when(F.col("action") == "purchase", "ok").otherwise("muted")
    return entity(spark, sf_dir, "audit_event").select("audit_id", "entity_id", "actor_type", tone.alias("tone"), place.alias("place"))


@query(
    "S20 S21 X52",
    with_entities("ai_call_log") + "SELECT call_id, purpose, response, CAST(json_extract(response, '$.k') AS BIGINT) AS k FROM ai_call_log WHERE call_id = 77",
)
def llm_call_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entity(spark, sf_dir, "ai_call_log").where(F.col("call_id") == 77)
    return found.select("call_id", "purpose", "response", F.get_json_object("response", "$.k").cast("long").alias("k"))


@query(
    "X36",
    """SELECT c_custkey AS id, upper(list_aggregate(list_transform(list_filter(string_split(regexp_replace(n, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: w <> '')[1:2], lambda w: w[1]), 'string_agg', '')) AS initials,
 CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 360) AS INT) AS hue
FROM (SELECT c_custkey, lower(c_mktsegment) || ' ' || c_name AS n FROM customer)""",
)
def sender_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    name = F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), R.initials(name).alias("initials"), R.hue(name).alias("hue"))


@query(
    "X49 X57 X48 J14",
    with_entities("field_evidence")
    + """, b AS (SELECT field_id, verified, CASE WHEN match_score >= 90 THEN page_no END AS page_no,
   CASE WHEN match_score >= 94 THEN CAST(page_no * 10 AS DOUBLE) END AS x0, CAST(page_no * 10 + 55 AS DOUBLE) AS x1 FROM field_evidence)
SELECT field_id, CASE WHEN verified = 'Y' AND x0 IS NOT NULL THEN 'box' WHEN verified = 'Y' AND page_no IS NOT NULL THEN 'located but unpositioned' WHEN page_no IS NOT NULL THEN 'page' ELSE 'first page' END AS target,
  round(x0 / 595 * 100, 2) AS left_percent, CASE WHEN x0 IS NOT NULL THEN round((x1 - x0) / 595 * 100, 2) END AS width_percent FROM b""",
)
def evidence_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entity(spark, sf_dir, "field_evidence")
    start = (F.col("page_no") * 10).cast("double")
    e = e.select(
        "field_id", "verified", F.when(F.col("match_score") >= 90, F.col("page_no")).alias("page_no"),
        F.when(F.col("match_score") >= 94, F.array(start, F.lit(0.0), start + 55, F.lit(9.0))).alias("bbox"),
    )
    x0, x1 = F.col("bbox")[0], F.col("bbox")[2]
    return e.select("field_id", R.evidence_target().alias("target"), F.round(x0 / 595 * 100, 2).alias("left_percent"), F.round((x1 - x0) / 595 * 100, 2).alias("width_percent"))
