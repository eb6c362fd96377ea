"""Readers: the driver's Parquet tables, and the engine's entities as views over them.

The entity views are written in the common subset of Spark SQL and DuckDB, so that both engines read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entity -> (base tables, SQL over their names in braces).
ENTITIES: dict[str, tuple[tuple[str, ...], str]] = {
    "inbox_message": (
        ("orders", "customer"),
        """
SELECT o.o_orderkey AS message_id, o.o_orderdate AS received_at, c.c_name AS sender_name,
       concat(lower(replace(c.c_name, '#', '.')), '@example.org') AS sender_email,
       concat('Order ', CAST(o.o_orderkey AS STRING), ' ', o.o_orderpriority, ' for ', c.c_mktsegment) AS subject,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 = 0 THEN 'REJECTED' WHEN o.o_orderstatus = 'F' THEN 'REVIEWED'
            WHEN o.o_orderstatus = 'O' THEN 'READY_FOR_REVIEW' WHEN o.o_orderkey % 3 = 0 THEN 'NEEDS_ATTENTION' ELSE 'CLASSIFYING' END AS status,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS needs_attention
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    ),
    "case_record": (
        ("orders",),
        """
SELECT o_orderkey AS case_id, o_orderkey AS message_id, CAST(o_orderkey % 3 AS INT) AS case_index,
       CASE o_orderstatus WHEN 'F' THEN 'ICSR' WHEN 'O' THEN 'PQC' ELSE 'MI' END AS case_type FROM {orders}""",
    ),
    "extracted_field": (
        ("lineitem",),
        """
SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS field_id, l_orderkey AS case_id,
       CASE l_linenumber WHEN 1 THEN 'patient.age' WHEN 2 THEN 'patient.sex' WHEN 3 THEN 'reporter.name' WHEN 4 THEN 'product[0].name'
            WHEN 5 THEN 'reaction[0].term' WHEN 6 THEN 'severity.criteria' ELSE 'narrative.text' END AS field_path,
       CASE WHEN l_linenumber <= 2 THEN 'PATIENT' WHEN l_linenumber = 3 THEN 'REPORTER' WHEN l_linenumber = 4 THEN 'PRODUCT'
            WHEN l_linenumber = 5 THEN 'REACTION' WHEN l_linenumber = 6 THEN 'SEVERITY' ELSE 'NARRATIVE' END AS field_group,
       CAST(l_suppkey % 4 AS INT) AS field_index,
       CASE WHEN l_quantity <= 5 THEN 'NOT_STATED' WHEN l_returnflag = 'N' THEN 'STATED' WHEN l_returnflag = 'A' THEN 'UNCERTAIN' ELSE 'CONFLICT' END AS status,
       concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE l_suppkey % 3 WHEN 0 THEN ' years' WHEN 1 THEN ' Y.O.' ELSE '' END) AS value_text,
       CAST(1 - l_discount * 5 AS DECIMAL(9,4)) AS confidence,
       CASE WHEN l_linestatus = 'F' AND l_linenumber > 4 THEN l_orderkey ELSE NULL END AS superseded_by
FROM {lineitem}""",
    ),
    "field_evidence": (
        ("lineitem",),
        """
SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS field_id, CAST(l_linenumber AS INT) AS page_no,
       CASE WHEN l_tax >= 0.07 THEN 'N' ELSE 'Y' END AS verified,
       CASE WHEN l_tax < 0.05 THEN 'EXACT' WHEN l_tax < 0.07 THEN 'FUZZY' ELSE 'FAILED' END AS verify_method,
       CAST(100 - l_tax * 200 AS DECIMAL(6,2)) AS match_score
FROM {lineitem}""",
    ),
    "classification": (
        ("lineitem", "part"),
        """
SELECT l.l_orderkey AS message_id, CAST(l.l_linenumber AS INT) AS unit_pos,
       CASE p.p_type WHEN 'ECONOMY' THEN 'ICSR' WHEN 'LARGE' THEN 'ICSR_INCOMPLETE' WHEN 'MEDIUM' THEN 'PQC' WHEN 'PROMO' THEN 'MI' ELSE 'NOT_RELEVANT' END AS category,
       CAST(1 - l.l_discount * 4 AS DECIMAL(5,4)) AS confidence,
       CASE WHEN l.l_tax >= 0.06 THEN 'LLM' ELSE 'RULE' END AS decided_by,
       l.l_partkey AS tie,
       CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber > 5 THEN l.l_orderkey ELSE NULL END AS superseded_by
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    ),
    "document": (
        ("lineitem",),
        """
SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS document_id, l_orderkey AS message_id,
       CASE WHEN l_linenumber = 1 THEN 'EMAIL_BODY' ELSE 'ATTACHMENT' END AS kind,
       CASE WHEN l_shipdate < DATE '1995-06-01' THEN 'PARSE_FAILED' WHEN l_shipdate > DATE '2001-06-01' THEN 'PARSING' ELSE 'PARSED' END AS parse_status,
       CASE WHEN l_quantity > 48 THEN 'Y' ELSE 'N' END AS truncated, CAST(l_quantity AS INT) AS page_count
FROM {lineitem}""",
    ),
    "review_decision": (
        ("events", "orders"),
        """
SELECT e.event_id AS decision_id, o.o_orderkey AS message_id, e.ts AS decided_at, e.user_id AS reviewer_id,
       CASE e.event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'signup' THEN 'OVERRIDE' ELSE 'REJECT' END AS decision
FROM {events} e JOIN {orders} o ON e.event_id * 3 = o.o_orderkey WHERE e.event_type IN ('purchase', 'signup', 'error')""",
    ),
    "job": (
        ("events",),
        """
SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'PARSE_DOCUMENT' WHEN 'view' THEN 'CLASSIFY_MESSAGE' WHEN 'purchase' THEN 'EXTRACT_CASE' ELSE 'FINALISE_MESSAGE' END AS job_type,
       CASE WHEN value < 5 THEN 'DEAD' WHEN value < 15 THEN 'PENDING' WHEN value < 25 THEN 'RUNNING' ELSE 'DONE' END AS state,
       user_id AS subject_id, CAST(event_id % 9 AS INT) AS priority, CAST(event_id % 4 AS INT) AS attempts, ts AS available_at,
       CASE WHEN value >= 15 AND value < 25 AND event_id % 5 <> 0 THEN ts ELSE NULL END AS locked_at
FROM {events}""",
    ),
    "processing_metric": (
        ("events",),
        "SELECT event_id AS metric_id, event_type AS stage, user_id AS subject_id, CAST(floor(value * 100) AS BIGINT) AS duration_ms, ts AS recorded_at FROM {events}",
    ),
    "ai_call_log": (
        ("events",),
        """
SELECT event_id AS call_id, event_type AS purpose, event_id + 7 AS job_id, user_id AS message_id,
       CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value * 6) AS BIGINT) AS cached_tokens, CAST(floor(value) AS BIGINT) AS write_tokens, CAST(floor(value * 2) AS BIGINT) AS completion_tokens,
       CASE WHEN value > 100 THEN 'Y' ELSE 'N' END AS repaired, CAST(value / 1000 AS DECIMAL(12,8)) AS cost_usd, CAST(floor(value * 31) AS BIGINT) AS latency_ms, ts AS called_at, props AS response
FROM {events}""",
    ),
    "audit_event": (
        ("events",),
        """
SELECT event_id AS audit_id, ts AS occurred_at, CASE WHEN user_id % 3 = 0 THEN 'SYSTEM' WHEN user_id % 3 = 1 THEN 'USER' ELSE 'AI' END AS actor_type,
       event_type AS action, user_id AS entity_id FROM {events}""",
    ),
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bases, text = ENTITIES[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in bases})


def with_entities(*names: str) -> str:
    """A WITH clause that defines the entities over the base tables."""
    parts = [f"{n} AS ({ENTITIES[n][1].format(**{t: t for t in ENTITIES[n][0]})})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
