"""Auditable labelling rules and the message's state, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The four minimum criteria of a report, and how each is named when it is missing.
ELEMENTS = {
    "has_identifiable_patient": "identifiable patient",
    "has_identifiable_reporter": "identifiable reporter",
    "has_suspect_product": "suspect product",
    "has_adverse_event": "adverse event",
}
TERMINAL = ("PARSED", "PARSE_FAILED")


def element_checks() -> Column:
    """The four checks (columns ``<element>`` and ``<element>_conf``) as an array of structs, in their fixed order."""
    return F.array(
        *[F.struct(F.lit(k).alias("code"), F.lit(n).alias("name"), F.col(k).alias("present"), F.col(f"{k}_conf").alias("confidence")) for k, n in ELEMENTS.items()]
    )


def icsr_rule(units: DataFrame) -> DataFrame:
    """Adds elements_present, missing, label, confidence and reason by the minimum-criteria rule.

    Four of four make a valid case, as sure as its weakest element; two or three with the adverse event an incomplete one.
    """
    with_checks = units.withColumn("checks", element_checks())
    present = F.filter("checks", lambda c: c["present"])
    missing = F.filter("checks", lambda c: ~c["present"])
    out = with_checks.withColumn("elements_present", F.size(present)).withColumn("missing", F.array_join(F.transform(missing, lambda c: c["name"]), ", "))
    n = F.col("elements_present")
    incomplete = (n >= 2) & (n < 4) & F.col("has_adverse_event")
    total = F.aggregate(present, F.lit(0).cast("decimal(18,8)"), lambda a, c: (a + c["confidence"]).cast("decimal(18,8)"))
    return (
        out.withColumn("label", F.when(n == 4, "ICSR").when(incomplete, "ICSR_INCOMPLETE"))
        .withColumn(
            "label_confidence",
            F.when(n == 4, F.array_min(F.transform("checks", lambda c: c["confidence"])).cast("decimal(9,4)")).when(incomplete, F.round(total / n, 4).cast("decimal(9,4)")),
        )
        .withColumn(
            "reason",
            F.when(n == 4, "All four minimum criteria are present.").when(incomplete, F.concat(n.cast("string"), F.lit(" of 4 minimum criteria present; missing "), F.col("missing"), F.lit("."))),
        )
        .drop("checks")
    )


def gated_labels(icsr: Column, pqc: Column, defect: Column, mi: Column, question: Column) -> Column:
    """All labels of a unit. A label that the model applies needs its checklist boolean; NOT_RELEVANT stands alone."""
    labels = F.filter(F.array(icsr, F.when(pqc & defect, "PQC"), F.when(mi & question, "MI")), lambda x: x.isNotNull())
    return F.when(F.size(labels) == 0, F.array(F.lit("NOT_RELEVANT"))).otherwise(labels)


def message_labels(labels: DataFrame, tie: tuple[str, ...] = ("unit_pos",)) -> DataFrame:
    """Per message and category the surest label (the first unit's on ties); NOT_RELEVANT only where nothing else is."""
    best = Window.partitionBy("message_id", "category").orderBy(F.desc("confidence"), *tie)
    kept = labels.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    whole = Window.partitionBy("message_id")
    relevant = F.count_if(F.col("category") != "NOT_RELEVANT").over(whole)
    kept = kept.withColumn("relevant", relevant).where((F.col("category") != "NOT_RELEVANT") | (F.col("relevant") == 0)).drop("relevant")
    place = F.row_number().over(whole.orderBy(F.desc("confidence"), "category"))
    return kept.withColumn("place", place)


def attention_reason() -> Column:
    """The ordered reasons why a message needs a look, null if there is none; one pass over counts."""

    def part(count: str, text: str, counted: bool = True) -> Column:
        words = F.concat(F.col(count).cast("string"), F.lit(text)) if counted else F.lit(text)
        return F.when(F.col(count) > 0, words)

    joined = F.concat_ws(
        "; ",
        part("failed_documents", " document(s) could not be parsed"),
        part("unverified_evidence", " citation(s) could not be verified against the source"),
        part("conflict_count", " field(s) where sources disagree"),
        part("truncated_documents", " document(s) exceeded the page cap and were truncated"),
        part("incomplete_labels", "ICSR is missing one or more minimum criteria", counted=False),
        part("low_confidence", " field(s) below 0.40 confidence"),
    )
    return F.when(joined != "", joined)


def barrier(documents: DataFrame) -> DataFrame:
    """Per message: documents, those not yet final, and whether all are."""
    open_ = F.count_if(~F.col("parse_status").isin(*TERMINAL))
    return documents.groupBy("message_id").agg(F.count("*").alias("documents"), open_.alias("outstanding"), (open_ == 0).alias("all_terminal"))


def next_step(messages: DataFrame, barriers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages to classify now: every document is final, and no live or finished classify job exists."""
    active = jobs.where((F.col("job_type") == "CLASSIFY_MESSAGE") & F.col("state").isin("PENDING", "RUNNING", "DONE")).select(F.col("subject_id").alias("message_id"))
    return messages.join(barriers.where("all_terminal"), "message_id").join(active, "message_id", "left_anti")


def derived_status() -> Column:
    """The message's status from its milestones; no column is ever updated."""
    return (
        F.when(F.col("last_decision") == "REJECT", "REJECTED")
        .when(F.col("last_decision").isNotNull(), "REVIEWED")
        .when(F.col("finalised"), "READY_FOR_REVIEW")
        .when(F.col("extracted"), "EXTRACTING")
        .when(F.col("labelled"), "CLASSIFIED")
        .when(F.col("all_terminal"), "PARSED")
        .when(F.col("documents") > 0, "PARSING")
        .otherwise("RECEIVED")
    )


def unit_text(kind: Column, status: Column, text: Column) -> Column:
    """What a unit shows the classifier; an unreadable document declares itself."""
    return F.when(status == "PARSED", text).otherwise(F.concat(F.lit("[This attachment could not be read: "), F.lower(status), F.lit("]")))
