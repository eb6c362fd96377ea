"""Scoring against golden labels: confusion, field outcomes, calibration, timing and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

FAMILIES = ("ICSR", "PQC", "MI", "NOT_RELEVANT")
#: Golden paths whose names differ from the extracted ones.
PATH_ALIASES = {
    "severity.criteria": "reaction[0].seriousness",
    "severity.is_serious": "reaction[0].seriousness",
    "defect.summary": "defect.description",
    "product.batch": "product[0].batch",
}


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected array, predicted array) to true positives, false positives and misses per family, in one pass."""
    each = pairs.select(F.explode(F.array(*map(F.lit, FAMILIES))).alias("family"), "expected", "predicted")
    want, got = F.array_contains("expected", F.col("family")), F.array_contains("predicted", F.col("family"))
    counted = each.groupBy("family").agg(F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"))
    return counted.withColumn("support", F.col("tp") + F.col("fn"))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def scores(counted: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select("family", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def averages(counted: DataFrame) -> DataFrame:
    """Micro and macro F1; the macro average leaves out families without support."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    macro = F.avg(F.when(F.col("support") > 0, f1.cast("decimal(18,4)")))
    return counted.agg(ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.round(macro.cast("double"), 4).alias("macro_f1"))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def resolved_path(path: Column) -> Column:
    """The extracted path that a golden key means: by alias, or with its component cut off."""
    named = path
    for golden, extracted in PATH_ALIASES.items():
        named = F.when(path == golden, extracted).otherwise(named)
    return F.regexp_replace(F.regexp_replace(named, r"\.frequency_raw$", ".frequency"), r"\.(raw|iso|precision)$", "")


def field_outcomes(golden: DataFrame, fields: DataFrame) -> DataFrame:
    """Golden facts (message_id, path, expected) against extracted (message_id, path, status, value): an outcome each.

    A stated fact is correct, wrong or missing; a fact that the golden doesn't state was abstained from, or asserted.
    """
    wanted = golden.select("message_id", resolved_path(F.col("path")).alias("path"), "expected")
    both = wanted.join(fields, ["message_id", "path"], "full")
    hit = V.match(F.col("expected"), F.col("value"))
    abstained = F.col("status") == "NOT_STATED"
    outcome = (
        F.when(F.col("expected").isNull(), F.when(abstained, F.lit("abstained_correctly")).otherwise("false_confident"))
        .when(F.col("status").isNull(), "missing_field")
        .when(abstained, "wrong")
        .when(hit, "correct")
        .when(V.match_loosely(F.col("expected"), F.col("value")), "correct_normalised")
        .otherwise("wrong")
    )
    return both.select("message_id", "path", "expected", "value", outcome.alias("outcome"))


def calibration(facts: DataFrame) -> DataFrame:
    """(confidence, hit) to accuracy by decile of confidence; each band stands at its middle."""
    band = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    counted = facts.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"))
    return counted.select("band", "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"), F.round((F.col("band") + 0.5) / 10, 2).cast("double").alias("band_mid"))


def expected_error(curve: DataFrame) -> DataFrame:
    """The gap between confidence and accuracy, weighted by the facts in each band."""
    gap = (F.abs(F.col("band_mid") - F.col("accuracy")) * F.col("n")).cast("decimal(24,8)")
    return curve.agg(F.round((F.sum(gap) / F.sum("n")).cast("double"), 4).alias("expected_calibration_error"), F.sum("n").alias("n"))


def stage_timings(metrics: DataFrame) -> DataFrame:
    took = F.col("duration_ms")
    return metrics.groupBy("stage").agg(
        F.count("*").alias("n"), F.avg(took).cast("int").alias("mean_ms"), F.median(took).cast("int").alias("median_ms"), F.max(took).alias("max_ms")
    )


def cost_by(calls: DataFrame, key: str) -> DataFrame:
    total = F.sum
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        total("cost_usd").cast("decimal(22,8)").alias("cost_usd"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("cached_tokens").alias("cached_tokens"),
        F.count_if(F.col("repaired") == "Y").alias("repaired"),
    )


def message_time(metrics: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    """Per message: its own stages and those of its documents (message_id, subject_id: what metrics name the document by)."""
    own = metrics.groupBy("subject_id").agg(F.sum("duration_ms").alias("ms"))
    of_docs = documents.select("message_id", "subject_id").join(own, "subject_id").groupBy("message_id").agg(F.sum("ms").alias("documents_ms"))
    joined = messages.join(own.withColumnsRenamed({"subject_id": "message_id", "ms": "own_ms"}), "message_id", "left").join(of_docs, "message_id", "left").fillna(0, subset=["own_ms", "documents_ms"])
    return joined.withColumn("total_ms", F.col("own_ms") + F.col("documents_ms"))


def cost_estimate() -> Column:
    """Dollars of a call by its token counters; fresh tokens are never below zero. Prices are dollars per million tokens."""
    fresh = F.greatest(F.col("prompt_tokens") - F.col("cached_tokens") - F.col("write_tokens"), F.lit(0))
    parts = ((fresh, "1.00"), (F.col("cached_tokens"), "0.10"), (F.col("write_tokens"), "1.25"), (F.col("completion_tokens"), "5.00"))
    total = F.lit(0).cast("decimal(24,2)")
    for tokens, price in parts:
        total = total + tokens.cast("decimal(18,0)") * F.lit(price).cast("decimal(4,2)")
    return total.cast("double") / 1_000_000
