"""Stored content: addresses by hash, the parse cache, the page cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most pages of a document that are read.
MOST_PAGES = 60


def blob_path(sha: Column) -> Column:
    """Two levels of folders by the first digits of the hash."""
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def render_path(sha: Column, page: Column, dpi: int) -> Column:
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), sha, F.lit("/p"), page.cast("string"), F.lit(f"@{dpi}.png"))


def stored(contents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, path, already): each content is stored once; later keys of it find it there."""
    sha = F.sha2(F.col(content), 256)
    seen = Window.partitionBy("sha256").orderBy(key)
    return contents.select(key, sha.alias("sha256")).withColumn("already", F.row_number().over(seen) > 1).withColumn("path", blob_path(F.col("sha256")))


def with_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (sha256) with parse results of a cache (sha256, payload, cost_usd, parse_status); a hit costs nothing.

    Only parsed results are ever served; the misses are what is left to parse.
    """
    good = cache.where(F.col("parse_status") == "PARSED").groupBy("sha256").agg(F.max("payload").alias("payload"))
    hit = F.col("payload").isNotNull()
    return files.join(good, "sha256", "left").withColumn("from_cache", hit).withColumn("cost_usd", F.when(hit, F.lit(0).cast("decimal(12,8)"))).withColumn("llm_calls", F.when(hit, 0))


def page_cap(documents: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Adds pages_read and truncated."""
    return documents.withColumn("pages_read", F.least(F.col("page_count"), F.lit(most))).withColumn("truncated", F.when(F.col("page_count") > most, "Y").otherwise("N"))


def overridden_fields(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """A reviewer's value for a field: a new row that is sure, remembers what the old one was, and supersedes it."""
    changed = fields.join(overrides, "field_id")
    reason = F.substring(F.concat(F.lit("Reviewer override. "), F.coalesce("adjust_reason", F.lit(""))), 1, 500)
    return changed.select(
        (-F.col("field_id") - 1).alias("field_id"), F.col("field_id").alias("supersedes"), "field_path", F.col("new_value").alias("value_text"),
        F.lit(1).cast("decimal(9,4)").alias("confidence"), F.col("confidence").alias("confidence_pre_adjust"), F.rtrim(reason).alias("adjust_reason"),
    )
