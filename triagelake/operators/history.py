"""Append-only history: overrides add rows and say which they supersede; nothing is updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of reviewers' labels begin here, above all others.
REVIEWER_IDS = 10_000_000_000_000


def with_overrides(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """(message_id, id, category) and decisions with a JSON list of categories to the whole history.

    An override's labels come after all that was there; they supersede what is live, pointing at its first label.
    One window per message finds that label: the least id of the next override's rows.
    """
    overrides = decisions.where(F.col("decision") == "OVERRIDE").select("message_id", "decision_id", F.posexplode(F.from_json("categories", "array<string>")).alias("nth", "category"))
    new = overrides.select("message_id", (F.col("decision_id") + 1).alias("at"), (F.lit(REVIEWER_IDS) + F.col("decision_id") * 10 + F.col("nth")).alias("id"), "category")
    old = labels.select("message_id", F.lit(0).cast("long").alias("at"), "id", "category")
    later = Window.partitionBy("message_id").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    return old.union(new).withColumn("superseded_by", F.min("id").over(later))


def current_labels(history: DataFrame) -> DataFrame:
    live = F.col("superseded_by").isNull()
    sorted_live = F.array_sort(F.collect_list(F.when(live, F.struct("category", "id"))))
    found = history.groupBy("message_id").agg(sorted_live.alias("x"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_superseded"))
    return found.select("message_id", F.to_json(F.transform("x", lambda r: r["category"])).alias("live"), "n_live", "n_superseded")


def decided_status(decisions: DataFrame) -> DataFrame:
    found = decisions.groupBy("message_id").agg(F.max_by("decision", "decision_id").alias("last"), F.count("*").alias("n_decisions"))
    return found.select("message_id", "n_decisions", F.when(F.col("last") == "REJECT", "REJECTED").otherwise("REVIEWED").alias("status"))


def chain_ends(rows: DataFrame, spark) -> DataFrame:
    """Follows superseded_by to the live row at the end of each chain, by a recursive query."""
    return spark.sql(
        """WITH RECURSIVE chain AS (
             SELECT id AS start, id, superseded_by FROM {rows}
             UNION ALL SELECT c.start, r.id, r.superseded_by FROM chain c JOIN {rows} r ON r.id = c.superseded_by)
           SELECT start, id AS final FROM chain WHERE superseded_by IS NULL""",
        rows=rows,
    )


def audit_json(after: Column) -> Column:
    """A JSON object that keeps its nulls."""
    return F.to_json(after, {"ignoreNullFields": "false"})
