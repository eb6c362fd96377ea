"""Mail to documents: MIME flattening, sniffing by magic bytes, fan-out and skip reasons."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS

#: Magic numbers by type, and what extensions say about containers.
MAGIC = (
    ("application/pdf", "255044462D"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/gif", "47494638"), ("application/rtf", "7B5C727466"),
)
OLE, ZIP = "D0CF11E0A1B11AE1", "504B0304"
OLE_KINDS = {".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".msg": "application/vnd.ms-outlook"}
ZIP_KINDS = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
READABLE = ("application/pdf", "image/png", "image/jpeg", "image/gif")
FORWARDED = "----- Forwarded message -----"


def sniffed(content: Column, filename: Column) -> Column:
    """The type that the bytes show; containers are told apart by the file's extension."""
    head, name = F.hex(F.substring(content, 1, 8)), F.lower(F.coalesce(filename, F.lit("")))

    def container(kinds: dict[str, str], other: str) -> Column:
        return F.coalesce(*[F.when(F.endswith(name, F.lit(end)), F.lit(kind)) for end, kind in kinds.items()], F.lit(other))

    out = F.when(content.isNull() | (F.octet_length(content) == 0), "application/x-empty")
    for kind, magic in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    out = out.when(F.startswith(head, F.lit(OLE)), container(OLE_KINDS, "application/x-ole-storage"))
    out = out.when(F.startswith(head, F.lit(ZIP)), container(ZIP_KINDS, "application/zip"))
    return out.otherwise("application/octet-stream")


def skip_reason(kind: Column, size: Column, most: int = SETTINGS.attachment_max_bytes) -> Column:
    """Why an attachment isn't read, or null if it is."""
    return (
        F.when((kind == "application/x-empty") | (size == 0), "EMPTY")
        .when(size > most, "TOO_LARGE")
        .when(~kind.isin(*READABLE), "UNSUPPORTED_TYPE")
    )


def load_failure(content: Column, most: int = SETTINGS.attachment_max_bytes) -> Column:
    """Why a file can't be opened as PDF, as far as bytes tell: empty, too large, or not a PDF."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "EMPTY")
        .when(size > most, "TOO_LARGE")
        .when(~F.startswith(F.hex(F.substring(content, 1, 8)), F.lit("255044462D")), "NOT_A_PDF")
        .when(F.contains(content, F.lit(b"/Encrypt")), "ENCRYPTED")
        .when(~F.contains(content, F.lit(b"%%EOF")), "CORRUPT")
    )


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_to_text(html: str) -> str:
    import re

    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


def flatten(raw: bytes) -> dict:
    """Headers, body text and attachments of a message.

    Plain text is preferred to HTML, which is kept as well. A part is an attachment if it says so or has a file name. A
    message within goes one level deep: its text follows the body under a line that says so, its attachments are lifted
    with their level; anything deeper is recorded as too deep.
    """
    message = email.message_from_bytes(raw or b"", policy=email.policy.default)
    found: dict = {
        "message_id": _header(message, "Message-ID"), "sender": _header(message, "From"), "subject": _header(message, "Subject"), "sent": _header(message, "Date"),
        "text": [], "html": [], "inner": [], "attachments": [],
    }
    _walk(message, found, 0)
    body = "\n".join(found.pop("text"))
    html = "\n".join(found.pop("html"))
    body = body if body.strip() else html_to_text(html)
    for inner in found.pop("inner"):
        body = f"{body.rstrip()}\n\n{FORWARDED}\n{inner}"
    return {**found, "body": body, "html": html or None}


def _header(message, name: str) -> str | None:
    try:
        value = message[name]
    except Exception:  # a header that can't be parsed counts as absent
        return None
    return str(value).strip() if value is not None else None


def _content(part) -> str:
    data = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8", "latin-1"):
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return ""


def _walk(part, found: dict, level: int) -> None:
    kind = part.get_content_type()
    if kind == "message/rfc822":
        inner = part.get_payload()[0] if part.is_multipart() and part.get_payload() else None
        if inner is None or level >= 1:
            found["attachments"].append({"filename": part.get_filename() or "message.eml", "declared_type": kind, "content": None, "level": level, "skip": "NESTING_TOO_DEEP"})
            return
        deeper = {"text": [], "html": [], "inner": [], "attachments": []}
        _walk(inner, deeper, level + 1)
        text = "\n".join(deeper["text"])
        found["inner"].append(text if text.strip() else html_to_text("\n".join(deeper["html"])))
        found["attachments"] += deeper["attachments"]
        return
    if part.is_multipart():
        for child in part.iter_parts() if hasattr(part, "iter_parts") else part.get_payload():
            _walk(child, found, level)
        return
    name = part.get_filename()
    if part.get_content_disposition() == "attachment" or name:
        number = len(found["attachments"]) + 1
        found["attachments"].append({"filename": name or f"attachment-{number}", "declared_type": kind, "content": part.get_payload(decode=True) or b"", "level": level, "skip": None})
    elif kind == "text/html":
        found["html"].append(_content(part))
    elif kind.startswith("text/"):
        found["text"].append(_content(part))


ATTACHMENT = "struct<filename:string,declared_type:string,content:binary,level:int,skip:string>"
MAIL = f"message_id string, sender string, subject string, sent string, body string, html string, attachments array<{ATTACHMENT}>"


def flatten_mail(files: DataFrame) -> DataFrame:
    """(path, content) of ``binaryFile`` to one row a message."""
    kind = pa.list_(pa.struct([("filename", pa.string()), ("declared_type", pa.string()), ("content", pa.binary()), ("level", pa.int32()), ("skip", pa.string())]))
    names = ["message_id", "sender", "subject", "sent", "body", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [flatten(x.as_py()) for x in part.column("content")]
                columns = [pa.array([f[n] for f in found], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([part.column("path"), *columns, pa.array([f["attachments"] for f in found], kind)], ["path", *names, "attachments"])

    return files.select("path", "content").mapInArrow(run, f"path string, {MAIL}")


def documents_of(mail: DataFrame) -> DataFrame:
    """The fan-out: a document for the body and one for each attachment, those that aren't read with the reason."""
    bodies = mail.select("path", F.lit(0).alias("position"), F.lit("EMAIL_BODY").alias("kind"), F.lit(None).cast("string").alias("filename"), F.lit("text/plain").alias("sniffed_type"), F.octet_length("body").cast("long").alias("size"), F.lit(None).cast("string").alias("skip_reason"), F.sha2("body", 256).alias("sha256"))
    parts = mail.select("path", F.posexplode("attachments").alias("n", "a")).select("path", "n", "a.*")
    parts = parts.withColumn("sniffed_type", sniffed(F.col("content"), F.col("filename"))).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    parts = parts.withColumn("skip_reason", F.coalesce("skip", skip_reason(F.col("sniffed_type"), F.col("size"))))
    attached = parts.select("path", (F.col("n") + 1).alias("position"), F.lit("ATTACHMENT").alias("kind"), "filename", "sniffed_type", "size", "skip_reason", F.sha2("content", 256).alias("sha256"))
    return bodies.unionByName(attached)
