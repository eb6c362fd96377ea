"""The work queue's queries, and reviewer decisions on append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import jobs as J
from ..sources.tables import entity, table, with_entities
from .registry import query

#: Events over users as jobs: the driver's event types stand for the log's kinds.
LOG = """SELECT user_id AS job_id, event_id AS seq, ts AS at, CASE event_type WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'CLAIM' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'REAP' END AS kind,
 concat('error ', CAST(event_id AS STRING)) AS error FROM {events}"""
NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "Q02 O04 P09 J20 R18",
    with_entities("job")
    + f"""SELECT job_id, priority, place, CAST((place - 1) % 4 AS INT) AS worker FROM (
SELECT job_id, priority, row_number() OVER (ORDER BY priority, job_id)::INT AS place FROM job WHERE state = 'PENDING' AND available_at <= TIMESTAMP '{NOW}') WHERE place <= 100""",
)
def job_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.assign(entity(spark, sf_dir, "job"), now(), workers=4, each=25).select("job_id", "priority", "place", "worker")


@query(
    "P10 P11 Q05 A29 X40",
    with_entities("job")
    + f"""SELECT job_type, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'RUNNING' AND locked_at IS NOT NULL AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 600 SECOND) AS stale FROM job GROUP BY 1""",
)
def job_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = entity(spark, sf_dir, "job")
    counts = [J.pending(jobs).select("job_type", F.lit(1).alias("p"), F.lit(0).alias("s")), J.stale(jobs, now()).select("job_type", F.lit(0), F.lit(1))]
    types = jobs.select("job_type", F.lit(0), F.lit(0))
    return counts[0].union(counts[1]).union(types).groupBy("job_type").agg(F.sum("p").cast("long").alias("pending"), F.sum("s").cast("long").alias("stale"))


@query(
    "W06 X41 Q04 A40",
    with_entities("job")
    + """SELECT job_id, CASE WHEN attempts >= 3 THEN 'DEAD' ELSE 'PENDING' END AS state, CASE WHEN attempts < 3 THEN available_at + to_seconds(CAST(pow(2, attempts) AS BIGINT)) END AS available_at
FROM job WHERE state = 'RUNNING'""",
)
def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_attempt(entity(spark, sf_dir, "job").where(F.col("state") == "RUNNING"))


FOLD_SQL = (
    "WITH RECURSIVE log AS ("
    + LOG.format(events="events")
    + """), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM log),
s AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, 'PENDING' AS state, 0 AS attempts, 0 AS completed FROM (SELECT DISTINCT job_id FROM log)
  UNION ALL
  SELECT s.job_id, o.n,
    CASE WHEN o.kind = 'CLAIM' AND s.state = 'PENDING' THEN 'RUNNING' WHEN o.kind = 'COMPLETE' AND s.state = 'RUNNING' THEN 'DONE'
         WHEN o.kind = 'FAIL' AND s.state = 'RUNNING' THEN CASE WHEN s.attempts >= 3 THEN 'DEAD' ELSE 'PENDING' END WHEN o.kind = 'REAP' AND s.state = 'RUNNING' THEN 'PENDING' ELSE s.state END,
    s.attempts + CASE WHEN o.kind = 'CLAIM' AND s.state = 'PENDING' THEN 1 ELSE 0 END, s.completed + CASE WHEN o.kind = 'COMPLETE' AND s.state = 'RUNNING' THEN 1 ELSE 0 END
  FROM s JOIN o ON o.job_id = s.job_id AND o.n = s.n + 1)
SELECT job_id, state, attempts, completed FROM s WHERE n = (SELECT max(n) FROM o WHERE o.job_id = s.job_id)"""
)


@query("Q01 Q02 Q03 Q04 Q05 Q06 W06 A38", FOLD_SQL)
def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of every job, folded from its whole log."""
    return J.fold(spark.sql(LOG, events=table(spark, sf_dir, "events"))).select("job_id", "state", "attempts", "completed")


@query(
    "W05 J19 A30 X50 X51 P01 Q07",
    """WITH c AS (SELECT l_orderkey AS message_id, p_type AS category, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT event_id AS decision_id, user_id AS message_id, CASE event_type WHEN 'signup' THEN 'OVERRIDE' WHEN 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS decision,
        CASE WHEN event_id % 2 = 0 THEN ['PQC', 'MI'] ELSE ['ICSR'] END AS categories FROM events WHERE event_type <> 'click'),
o AS (SELECT * FROM d WHERE decision = 'OVERRIDE'),
n AS (SELECT message_id, decision_id, 10000000000000 + decision_id * 10 + i - 1 AS id, categories[i] AS category FROM (SELECT *, unnest(range(1, len(categories) + 1)) AS i FROM o)),
h AS (SELECT message_id, 0 AS at, id, category FROM c UNION ALL SELECT message_id, decision_id + 1, id, category FROM n),
f AS (SELECT h.*, (SELECT min(n.id) FROM n WHERE n.message_id = h.message_id AND n.decision_id + 1 > h.at) AS superseded_by FROM h),
v AS (SELECT message_id, to_json(list(category ORDER BY category, id)) AS live, count(*) AS n_live FROM f WHERE superseded_by IS NULL GROUP BY 1),
s AS (SELECT message_id, arg_max(decision, decision_id) AS last, count(*) AS n_decisions FROM d GROUP BY 1)
SELECT v.message_id, CAST(v.live AS VARCHAR) AS live, v.n_live, CASE s.last WHEN 'REJECT' THEN 'REJECTED' ELSE 'REVIEWED' END AS status, n_decisions,
  (SELECT count(*) FROM f WHERE f.message_id = v.message_id AND superseded_by IS NOT NULL) AS n_superseded
FROM v JOIN s USING (message_id)""",
)
def override_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after every reviewer decision, on append-only tables."""
    labels = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    field_id = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    labels = labels.select(F.col("l_orderkey").alias("message_id"), F.col("p_type").alias("category"), field_id.alias("id"))
    kind = F.when(F.col("event_type") == "signup", "OVERRIDE").when(F.col("event_type") == "error", "REJECT").otherwise("ACCEPT")
    payload = F.when(F.col("event_id") % 2 == 0, F.lit('["PQC","MI"]')).otherwise(F.lit('["ICSR"]'))
    decisions = table(spark, sf_dir, "events").where(F.col("event_type") != "click")
    decisions = decisions.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("message_id"), kind.alias("decision"), payload.alias("categories"))
    history = H.with_overrides(labels, decisions)
    return H.current_labels(history).join(H.decided_status(decisions), "message_id").select("message_id", "live", "n_live", "status", "n_decisions", "n_superseded")


@query(
    "S23 X50 A30 X32",
    """SELECT event_id AS decision_id, CAST(to_json({'decision': CASE event_type WHEN 'error' THEN 'REJECT' ELSE 'ACCEPT' END, 'notes': CASE WHEN value > 50 THEN event_type END, 'reviewer': user_id}) AS VARCHAR) AS after
FROM events WHERE event_type IN ('error', 'purchase')""",
)
def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("event_type") == "error", "REJECT").otherwise("ACCEPT")
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    after = H.audit_json(F.struct(decision.alias("decision"), F.when(F.col("value") > 50, F.col("event_type")).alias("notes"), F.col("user_id").alias("reviewer")))
    return events.select(F.col("event_id").alias("decision_id"), after.alias("after"))
