"""The mailbox as a file stream: each file is a message, the checkpoint is what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as T
from ..operators import ingest as I

FILES = "path string, modificationTime timestamp, length long, content binary"


def mailbox(spark: SparkSession, folder: str, batch: int = SETTINGS.poll_batch) -> DataFrame:
    """Messages of a landing folder, at most ``batch`` files a poll."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", batch).load(folder)


def ingested(files: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Flattened mails, each dedupe key once within the horizon; state older than that is dropped."""
    arrived = files.select(F.concat_ws("|", "path", F.col("modificationTime").cast("string")).alias("path"), "content")
    mail = I.flatten_mail(arrived)
    mail = mail.withColumn("arrived_at", F.element_at(F.split("path", r"\|"), -1).cast("timestamp")).withColumn("path", F.element_at(F.split("path", r"\|"), 1))
    keyed = mail.withColumn("dedupe_key", T.dedupe_key(F.col("message_id"), F.col("sender"), F.col("subject"), F.col("sent"), F.col("body")))
    return keyed.withWatermark("arrived_at", horizon).dropDuplicatesWithinWatermark(["dedupe_key"])


def poll(stream: DataFrame, target: str, checkpoint: str, once: bool = False):
    """Appends to Parquet, every ten seconds, or once over all that is there."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SETTINGS.poll_seconds} seconds")).start()


def counts(messages: DataFrame) -> DataFrame:
    """(total, unread) of a mailbox table with a boolean ``seen``."""
    return messages.agg(F.count("*").alias("total"), F.count_if(~F.col("seen")).alias("unread"))
