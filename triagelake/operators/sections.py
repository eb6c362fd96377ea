"""Sections of a document from its blocks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A heading without typographic support has to be this short.
SHORT = 40


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, block) to doc_id, section, kind, heading, char_start, char_end, excluded.

    A block that is a known heading opens a section, which runs on over page breaks until the next; what stands before
    the first heading is the title section. A heading counts even as the first block of its page.
    """
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.length(F.trim(F.regexp_replace(F.trim("block"), r"[:.]+$", ""))) <= SHORT, T.heading_kind(F.col("block")))
    placed = blocks.withColumn("kind", kind)
    placed = placed.withColumn("char_end", F.sum(F.length("block") + 1).over(order) - 1).withColumn("section", F.count("kind").over(order))
    return (
        placed.groupBy("doc_id", "section")
        .agg(
            F.coalesce(F.max("kind"), F.lit("TITLE")).alias("kind"),
            F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.trim("block"))), F.lit("(document start)")).alias("heading"),
            F.min(F.col("char_end") - F.length("block")).cast("int").alias("char_start"),
            F.max("char_end").cast("int").alias("char_end"),
        )
        .withColumn("section", F.col("section").cast("int"))
        .withColumn("excluded", T.excluded(F.col("kind")))
    )


def extractable(found: DataFrame) -> DataFrame:
    """Per document the character ranges that extraction may read."""
    ranges = F.array_sort(F.collect_list(F.struct("char_start", "char_end")))
    return found.where(~F.col("excluded")).groupBy("doc_id").agg(ranges.alias("ranges"))
