"""Merging facts of several sources, and declaring where they disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import values as V

#: Groups in which a difference matters.
CONFLICT_GROUPS = ("PATIENT", "REPORTER", "PRODUCT", "REACTION", "SEVERITY")
ASSERTING = ("STATED", "UNCERTAIN", "CONFLICT")


def judged(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Facts (field_group, status, value_text, confidence, verified) by key: what is stated, its distinct values, the outcome.

    ABSTAINED: nothing is asserted. SINGLE: one fact asserts something. MERGED: all agree, or the group's differences
    don't matter. CONFLICT: some value agrees with none before it. Agreement is not transitive, so values are taken in the
    given order and folded.
    """
    candidate = F.struct(*order, "value_text", "confidence", "verified", "status", V.merge_value(F.col("value_text")).alias("folded"))
    grouped = facts.groupBy(*key).agg(F.first("field_group").alias("field_group"), F.array_sort(F.collect_list(candidate)).alias("all"))
    stated = F.filter("all", lambda c: c["status"].isin(*ASSERTING) & (F.coalesce(c["value_text"], F.lit("")) != ""))
    grouped = grouped.withColumn("stated", stated)
    empty = F.slice("stated", 1, 0)
    distinct = F.aggregate("stated", empty, lambda seen, c: F.when(F.exists(seen, lambda s: V.agree(s["folded"], c["folded"])), seen).otherwise(F.array_append(seen, c)))
    grouped = grouped.withColumn("distinct", distinct)
    relevant = F.coalesce(F.col("field_group").isin(*CONFLICT_GROUPS), F.lit(False))
    outcome = F.when(F.size("stated") == 0, "ABSTAINED").when(F.size("stated") == 1, "SINGLE").when((F.size("distinct") > 1) & relevant, "CONFLICT").otherwise("MERGED")
    return grouped.withColumn("outcome", outcome)


def _best() -> Column:
    """The best proved of what is stated, then the surest, then the first."""
    ranked = F.transform("stated", lambda c, i: F.struct((c["verified"] == "Y").alias("ok"), c["confidence"].alias("confidence"), (-i).alias("place"), c.alias("fact")))
    return F.array_max(ranked)["fact"]


def merged(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: its outcome, the values kept and the highest confidence, capped where values are in conflict."""
    cap = F.lit(SETTINGS.conflict_confidence_cap).cast("decimal(9,4)")
    conflict = F.col("outcome") == "CONFLICT"
    kept = F.when(conflict, F.transform("distinct", lambda c: c["value_text"])).when(F.size("stated") > 0, F.array(_best()["value_text"]))
    sure = F.when(conflict, F.array_max(F.transform("distinct", lambda c: F.least(c["confidence"], cap)))).when(F.size("stated") > 0, _best()["confidence"])
    return judged(facts, key, order).select(
        *key, "outcome", F.size("stated").alias("asserting"), F.size("distinct").alias("distinct_values"), F.array_join(kept, " | ").alias("kept"), sure.cast("decimal(9,4)").alias("confidence")
    )


def merged_rows(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that stay: one a key, but one for every value in conflict, each with its own capped confidence and reason."""
    conflict, cap = F.col("outcome") == "CONFLICT", F.lit(SETTINGS.conflict_confidence_cap).cast("decimal(9,4)")
    stay = F.when(conflict, F.col("distinct")).when(F.size("stated") > 0, F.array(_best())).otherwise(F.slice("all", 1, 1))
    each = judged(facts, key, order).select(*key, "outcome", F.explode(stay).alias("c"))
    over = F.col("c.confidence") > cap
    reason = F.when(conflict, F.when(over, F.lit(f"sources disagree, capped at {SETTINGS.conflict_confidence_cap}")).otherwise("sources disagree")).otherwise("")
    return each.select(
        *key, *[F.col(f"c.{c}").alias(c) for c in order], "c.value_text", F.when(conflict, "CONFLICT").otherwise(F.col("c.status")).alias("status"),
        F.when(conflict & over, cap).otherwise(F.col("c.confidence")).cast("decimal(9,4)").alias("confidence"), reason.alias("adjust_reason"),
    )
