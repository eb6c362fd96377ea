"""Ingestion queries: mails built from conversations, flattened back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blobs as B
from ..operators import ingest as I
from ..sources.tables import entity, table, with_entities
from ..streaming import mail as M
from .registry import query


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MIME message for each turn: text and an attachment whose bytes depend on the turn."""
    head = F.concat(
        F.lit("From: a@example.org\r\nSubject: turn "), F.col("turn").cast("string"), F.lit("\r\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
        F.lit("@example.org>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"BB\"\r\n\r\n--BB\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
    )
    k = F.col("turn") % 4
    content = F.when(k == 0, F.lit("%PDF-1.4 x %%EOF")).when(k == 1, F.lit("GIF89a....")).when(k == 2, F.lit("")).otherwise(F.lit("PK\x03\x04zip"))
    name = F.when(k == 3, "a.DOCX").otherwise("a.bin")
    attached = F.concat(F.lit("\r\n--BB\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\""), name, F.lit("\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(content.cast("binary")), F.lit("\r\n--BB--\r\n"))
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.concat(head, F.base64(F.encode("text", "UTF-8")), attached).cast("binary").alias("content")
    )


@query(
    "R17 S01 S02 S06 S13 X17",
    """SELECT conv_id || '-' || turn AS path, '<' || conv_id || '-' || turn || '@example.org>' AS message_id, 'turn ' || turn AS subject, sha256(text) AS body_sha256, 1::INT AS attachments FROM conversations""",
)
def mime_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = I.flatten_mail(mails(spark, sf_dir))
    return mail.select("path", "message_id", "subject", F.sha2("body", 256).alias("body_sha256"), F.size("attachments").alias("attachments"))


@query(
    "R18 P12 P13 S15",
    """SELECT conv_id || '-' || turn AS path, 0::INT AS position, 'EMAIL_BODY' AS kind, 'text/plain' AS sniffed_type, octet_length(encode(text))::BIGINT AS size, NULL::VARCHAR AS skip_reason FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 1::INT, 'ATTACHMENT', CASE turn % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'application/x-empty' ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END,
 CASE turn % 4 WHEN 0 THEN 16 WHEN 1 THEN 10 WHEN 2 THEN 0 ELSE 7 END::BIGINT, CASE turn % 4 WHEN 2 THEN 'EMPTY' WHEN 3 THEN 'UNSUPPORTED_TYPE' END FROM conversations""",
)
def ingest_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents_of(I.flatten_mail(mails(spark, sf_dir))).select("path", "position", "kind", "sniffed_type", "size", "skip_reason")


@query(
    "J17 X15",
    """SELECT path, message_id, first_path FROM (SELECT conv_id || '-' || turn AS path, '<' || conv_id || '-' || turn || '@example.org>' AS message_id, min(conv_id || '-' || turn) OVER (PARTITION BY conv_id, turn) AS first_path FROM conversations)""",
)
def ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail with the first mail of its dedupe key."""
    mail = I.flatten_mail(mails(spark, sf_dir))
    keyed = mail.select("path", "message_id", T.dedupe_key(F.col("message_id"), F.col("sender"), F.col("subject"), F.col("sent"), F.col("body")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("path").alias("first_path"))
    return keyed.join(first, "key").select("path", "message_id", "first_path")


@query(
    "S09 P13",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'EMPTY' WHEN doc_id % 6 = 1 THEN 'NOT_A_PDF' WHEN doc_id % 6 = 2 THEN 'ENCRYPTED' WHEN doc_id % 6 = 3 THEN 'CORRUPT' WHEN doc_id % 6 = 4 AND length(text) > 5000 THEN 'TOO_LARGE' END AS failure
FROM (SELECT * FROM documents)""",
)
def pdf_load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    body = F.when(k == 0, F.lit("")).when(k == 1, F.lit("hello")).when(k == 2, F.lit("%PDF-1.4 /Encrypt %%EOF")).when(k == 3, F.lit("%PDF-1.4 ")).otherwise(F.lit("%PDF-1.4 %%EOF"))
    size = F.when((k == 4) & (F.length("text") > 5000), 1000).otherwise(0)
    content = F.concat(body, F.repeat(F.lit(" "), size)).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", I.load_failure(content, most=500).alias("failure"))


@query(
    "S13 J18 S12",
    """SELECT doc_id, sha, row_number() OVER (PARTITION BY sha ORDER BY doc_id) > 1 AS already, substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha AS path, substr(sha, 1, 2) || '/' || sha || '/p1@200.png' AS render
FROM (SELECT doc_id, sha256(text) AS sha FROM documents)""",
)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.stored(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("sha256").alias("sha"), "already", "path", B.render_path(F.col("sha256"), F.lit(1), 200).alias("render"))


@query(
    "S14 J07",
    """WITH f AS (SELECT doc_id, sha256(text) AS sha256, source FROM documents), c AS (SELECT sha256, max(source) AS payload FROM f WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0 GROUP BY 1)
SELECT doc_id, payload, payload IS NOT NULL AS from_cache, CASE WHEN payload IS NOT NULL THEN 0 END::INT AS llm_calls FROM f LEFT JOIN c USING (sha256)""",
)
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "source")
    status = F.when(F.col("doc_id") % 8 == 0, "PARSE_FAILED").otherwise("PARSED")
    cache = files.where(F.col("doc_id") % 4 == 0).select("sha256", F.col("source").alias("payload"), status.alias("parse_status"))
    return B.with_cache(files, cache).select("doc_id", "payload", "from_cache", "llm_calls")


@query("S10 S11", "SELECT o_orderkey, least(o_orderkey % 90, 60)::BIGINT AS pages_read, CASE WHEN o_orderkey % 90 > 60 THEN 'Y' ELSE 'N' END AS truncated FROM orders")
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90).alias("page_count"))
    return B.page_cap(pages).select("o_orderkey", "pages_read", "truncated")


@query("S03 S04 S05", "SELECT count(*) AS total, count(*) FILTER (turn % 2 = 1) AS unread FROM conversations")
def mailbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(table(spark, sf_dir, "conversations").withColumn("seen", F.col("turn") % 2 == 0))


@query(
    "W05 R16 Q07",
    with_entities("extracted_field")
    + """SELECT -field_id - 1 AS field_id, field_id AS supersedes, field_path, 'fixed' AS value_text, 1::DECIMAL(9,4) AS confidence, confidence AS confidence_pre_adjust,
 CASE WHEN case_id % 2 = 0 THEN 'Reviewer override. was ' || status ELSE 'Reviewer override.' END AS adjust_reason FROM extracted_field WHERE case_id % 5 = 0 AND superseded_by IS NULL""",
)
def field_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = entity(spark, sf_dir, "extracted_field").where("superseded_by is null")
    fields = fields.withColumn("adjust_reason", F.when(F.col("case_id") % 2 == 0, F.concat(F.lit("was "), F.col("status"))))
    wanted = fields.where(F.col("case_id") % 5 == 0).select("field_id").distinct().withColumn("new_value", F.lit("fixed"))
    return B.overridden_fields(fields, wanted)
