"""The reviewer's queue and its read queries, as pre-aggregated join trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSERTING = ("STATED", "UNCERTAIN", "CONFLICT")
DECIDABLE = ("READY_FOR_REVIEW", "REVIEWED", "REJECTED", "NEEDS_ATTENTION")
#: Order in which a case's groups are shown; others come last.
GROUP_ORDER = ("PATIENT", "REPORTER", "PRODUCT", "REACTION", "SEVERITY", "NARRATIVE")


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_by").isNull())


def asserting(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("status").isin(*ASSERTING))


def not_narrative() -> Column:
    """False or null for the narrative; a null group is dropped as well."""
    return F.col("field_group") != "NARRATIVE"


def field_rollup(fields: DataFrame, cases: DataFrame) -> DataFrame:
    """Per message: least confidence of live asserting facts outside the narrative, and live conflicts."""
    usable = F.col("status").isin(*ASSERTING) & not_narrative()
    return (
        live(fields)
        .join(cases.select("case_id", "message_id"), "case_id")
        .groupBy("message_id")
        .agg(F.min(F.when(usable, F.col("confidence"))).alias("min_field_confidence"), F.count_if(F.col("status") == "CONFLICT").alias("conflict_count"))
    )


def evidence_rollup(evidence: DataFrame, fields: DataFrame, cases: DataFrame) -> DataFrame:
    """Per message: evidence rows of live facts that could not be verified."""
    bad = evidence.where(F.col("verified") == "N").select("field_id")
    return (
        bad.join(live(fields).select("field_id", "case_id"), "field_id")
        .join(cases.select("case_id", "message_id"), "case_id")
        .groupBy("message_id")
        .agg(F.count("*").alias("unverified_evidence"))
    )


def label_rollup(classification: DataFrame) -> DataFrame:
    """Per message: its live labels in order, repeated as often as they occur, and the highest confidence."""
    return (
        live(classification)
        .groupBy("message_id")
        .agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"), F.max("confidence").alias("max_label_confidence"))
    )


def document_rollup(documents: DataFrame) -> DataFrame:
    return documents.groupBy("message_id").agg(
        F.count("*").alias("document_count"),
        F.count_if(F.col("parse_status") == "PARSE_FAILED").alias("failed_documents"),
        F.count_if(F.col("truncated") == "Y").alias("truncated_documents"),
    )


COUNTS = ("document_count", "failed_documents", "truncated_documents", "case_count", "unverified_evidence", "conflict_count", "dead_jobs")


def review_queue(messages, classification, documents, cases, fields, evidence, decisions, jobs) -> DataFrame:
    """The queue view: one row a message, each subquery pre-aggregated by message once and joined."""
    parts = (
        label_rollup(classification),
        document_rollup(documents),
        cases.groupBy("message_id").agg(F.count("*").alias("case_count")),
        field_rollup(fields, cases),
        evidence_rollup(evidence, fields, cases),
        decisions.groupBy("message_id").agg(F.max("decided_at").alias("last_reviewed_at")),
        jobs.where(F.col("state") == "DEAD").groupBy(F.col("subject_id").alias("message_id")).agg(F.count("*").alias("dead_jobs")),
    )
    queue = messages
    for part in parts:
        queue = queue.join(part, "message_id", "left")
    return queue.fillna(0, subset=list(COUNTS))


def worst_first(queue: DataFrame) -> list[Column]:
    """Attention first, then the least sure, then the oldest; the id settles ties."""
    return [
        F.col("needs_attention").desc_nulls_first(),
        F.coalesce("min_field_confidence", F.lit(2)).asc(),
        F.col("received_at").asc_nulls_last(),
        F.col("message_id").asc(),
    ]


def queue_filter(queue: DataFrame, status: str | None = None, category: str | None = None, flagged: bool = False, search: str | None = None) -> DataFrame:
    """The queue's optional filters. A category matches as a substring of the label list; a search is a LIKE pattern."""
    if status:
        queue = queue.where(F.col("status") == status)
    if category:
        queue = queue.where(F.col("categories").contains(category))
    if flagged:
        queue = queue.where((F.col("needs_attention") == "Y") | (F.col("unverified_evidence") > 0) | (F.col("conflict_count") > 0))
    if search:
        pattern = f"%{search.lower()}%"
        queue = queue.where(F.lower("subject").like(pattern) | F.lower("sender_email").like(pattern))
    return queue


def queue_page(queue: DataFrame, page: int, size: int) -> DataFrame:
    """One page in worst-first order, with the total of all pages on each row."""
    total = queue.agg(F.count("*").alias("total"))
    return queue.orderBy(*worst_first(queue)).offset(page * size).limit(size).join(F.broadcast(total))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence >= 0.7, "high").when(confidence >= 0.4, "mid").otherwise("low")


def attention_flags() -> Column:
    """What is wrong with a message, in a fixed order."""

    def count(column: str, what: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(f" {what}")))

    flags = F.array(
        count("unverified_evidence", "unverified"),
        count("conflict_count", "conflict"),
        count("failed_documents", "unreadable"),
        F.when(F.col("truncated_documents") > 0, F.lit("truncated")),
        F.when(F.col("dead_jobs") > 0, F.lit("dead job")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def status_tone(status: Column) -> Column:
    return (
        F.when(status.isin("REVIEWED"), "ok").when(status.isin("REJECTED"), "muted").when(status.isin("NEEDS_ATTENTION"), "bad").when(status == "READY_FOR_REVIEW", "info").otherwise("busy")
    )


def initials(name: Column) -> Column:
    """The first letters of the first two words, in capitals."""
    words = F.slice(F.filter(F.split(F.regexp_replace(name, "[^A-Za-z ]", " "), " "), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def hue(name: Column) -> Column:
    """A stable colour: a rolling hash of the name's characters, modulo 360."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda h, c: (h * 31 + c) % 360)


def humanise(code: Column) -> Column:
    """NOT_RELEVANT to "Not relevant"."""
    words = F.lower(F.replace(code, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def percent(value: Column) -> Column:
    return F.concat(F.round(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def group_rank(group: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.coalesce(group, F.lit("")))
    return F.when(place == 0, len(GROUP_ORDER) + 1).otherwise(place).cast("int")


def client_sorts(queue: DataFrame) -> DataFrame:
    """Ranks by the three orders that a reviewer can choose."""
    by = {
        "by_confidence": [F.coalesce("min_field_confidence", F.lit(2)).asc(), F.col("message_id").asc()],
        "by_received": [F.col("received_at").desc_nulls_last(), F.col("message_id").asc()],
        "by_sender": [F.lower("sender_name").asc_nulls_last(), F.col("message_id").asc()],
    }
    bucket = F.col("status")
    return queue.select("message_id", "status", *[F.row_number().over(Window.partitionBy(bucket).orderBy(*o)).alias(n) for n, o in by.items()])


def evidence_target() -> Column:
    """Where a click on a citation leads: its box, its page without a box, or the first page."""
    return (
        F.when((F.col("verified") == "Y") & F.col("bbox").isNotNull(), "box")
        .when((F.col("verified") == "Y") & F.col("page_no").isNotNull(), "located but unpositioned")
        .when(F.col("page_no").isNotNull(), "page")
        .otherwise("first page")
    )


def no_citation_reason() -> Column:
    return (
        F.when(F.col("field_group") == "NARRATIVE", "summarised, not quoted")
        .when(F.col("field_path").rlike(r"\.(role|route)$"), "implied by context")
        .otherwise("no quote was given")
    )
