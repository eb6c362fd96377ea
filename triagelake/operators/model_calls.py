"""Model calls as a replay table: inputs meet recorded replies by key; nothing is ever guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def render(template: str, **values: Column) -> Column:
    """A prompt with ``{{name}}`` replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def call_key(purpose: Column, version: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", purpose, version, prompt), 256)


def latest_version(labels: DataFrame) -> DataFrame:
    """(prompt, label like v<N>) to the highest version of each."""
    return labels.groupBy("prompt").agg(F.max(F.regexp_extract("label", r"^v(\d+)$", 1).cast("int")).alias("version"))


def replay(inputs: DataFrame, calls: DataFrame, schema: str) -> DataFrame:
    """Inputs (with call_key) joined with recorded replies (call_key, reply), parsed by the schema.

    outcome: OK, MISSING_REPLAY without a recording, SCHEMA_FAILED where the reply is no object of the schema. A key
    recorded more than once replays its last call.
    """
    last = calls.groupBy("call_key").agg(F.max_by("reply", "call_id").alias("reply"))
    joined = inputs.join(last, "call_key", "left").withColumn("parsed", F.from_json(T.reply_json(F.col("reply")), schema))
    bad = F.col("parsed").isNull() | (T.reply_json(F.col("reply")) == "{}")
    outcome = F.when(F.col("reply").isNull(), "MISSING_REPLAY").when(bad, "SCHEMA_FAILED").otherwise("OK")
    return joined.withColumn("outcome", outcome)


def source_unit(reason: Column) -> Column:
    """The unit named by the last "(from <unit>)" of a reason, or null."""
    return F.nullif(F.regexp_extract(reason, r"^.*\(from ([^()]+)\)", 1), F.lit(""))


def reassembled(blocks: Column, translated: Column) -> Column:
    """Blocks in order, each translated where a translation came back; a missing one falls back to its source."""
    return F.array_join(F.transform(blocks, lambda b, i: F.coalesce(F.element_at(translated, i.cast("int")), b)), "\n")


def legibility(text: Column, said: Column) -> Column:
    """A blank page hides nothing; else what the model said, clamped."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(1.0)).otherwise(F.least(F.greatest(said, F.lit(0.0)), F.lit(1.0)))


def uncertain_segments(segments: Column) -> Column:
    return F.size(F.filter(segments, lambda s: s["uncertain"]))
