"""Mail: MIME flattening, sniffing, fan-out, and the file stream."""

from email.message import EmailMessage

from pyspark.sql import functions as F

from triagelake.operators import ingest as I
from triagelake.streaming import mail as M


def message(subject="s", body="hello", html=None, files=(), inner=None, mid="<1@x>"):
    m = EmailMessage()
    m["Subject"], m["From"], m["Date"] = subject, "A <a@x.org>", "Mon, 3 Jun 2024 10:00:00 +0000"
    if mid:
        m["Message-ID"] = mid
    m.set_content(body)
    if html:
        m.add_alternative(html, subtype="html")
    for name, data in files:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    if inner is not None:
        m.add_attachment(inner)
    return m


def test_flatten_prefers_text_and_keeps_html():
    found = I.flatten(bytes(message(body="plain é", html="<p>rich</p>", files=[("a.pdf", b"%PDF-1.4"), ("b.docx", b"PK\x03\x04")])))
    assert found["body"].strip() == "plain é" and "rich" in found["html"] and found["subject"] == "s" and found["message_id"] == "<1@x>"
    assert [(a["filename"], a["content"], a["level"]) for a in found["attachments"]] == [("a.pdf", b"%PDF-1.4", 0), ("b.docx", b"PK\x03\x04", 0)]


def test_html_alone_becomes_text():
    m = EmailMessage()
    m.set_content("<style>p{}</style><p>One<br>Two</p>", subtype="html")
    assert I.flatten(bytes(m))["body"].split() == ["One", "Two"]


def test_forwarded_messages_one_level():
    deep = message(subject="deep", body="too deep")
    inner = message(subject="in", body="inner text", files=[("in.pdf", b"%PDF-x")], inner=deep)
    found = I.flatten(bytes(message(body="outer", inner=inner)))
    assert found["body"].index("outer") < found["body"].index(I.FORWARDED) < found["body"].index("inner text") and "too deep" not in found["body"]
    assert [(a["filename"], a["level"], a["skip"]) for a in found["attachments"]] == [("in.pdf", 1, None), ("message.eml", 1, "NESTING_TOO_DEEP")]


def test_broken_mail_is_no_error():
    assert I.flatten(b"")["attachments"] == [] and I.flatten(None)["body"] == "" and I.flatten(b"\xff\xfe garbage")["message_id"] is None


def test_sniffing(spark):
    rows = [(b"%PDF-1", "x", "application/pdf"), (b"\x89PNG\r\n\x1a\n1", "x", "image/png"), (b"\xff\xd8\xff\xe0", None, "image/jpeg"), (b"GIF89a", "", "image/gif"), (b"{\\rtf1", "a", "application/rtf")]
    rows += [(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "A.DOC", "application/msword"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "x", "application/x-ole-storage"), (b"PK\x03\x04", "t.xlsx", I.ZIP_KINDS[".xlsx"]), (b"PK\x03\x04", None, "application/zip")]
    rows += [(b"", "a.pdf", "application/x-empty"), (None, "a", "application/x-empty"), (b"text", "a.pdf", "application/octet-stream")]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None, n, w) for c, n, w in rows], "c binary, n string, want string")
    assert all(r.got == r.want for r in df.select("want", I.sniffed(F.col("c"), F.col("n")).alias("got")).collect())


def test_skip_reasons(spark):
    rows = [("application/pdf", 5, None), ("image/gif", 5, None), ("application/zip", 5, "UNSUPPORTED_TYPE"), ("application/zip", 50, "TOO_LARGE"), ("application/pdf", 0, "EMPTY"), ("application/x-empty", 9, "EMPTY")]
    df = spark.createDataFrame(rows, "k string, n long, want string")
    assert all(r.got == r.want for r in df.select("want", I.skip_reason(F.col("k"), F.col("n"), 10).alias("got")).collect())


def test_stream_reads_each_mail_once(spark, tmp_path):
    inbox, out, state = (tmp_path / n for n in ("inbox", "out", "state"))
    inbox.mkdir()
    put = lambda name, m: (inbox / name).write_bytes(bytes(m))
    put("1.eml", message(mid="<1@x>"))
    put("2.eml", message(mid="<1@x>", subject="again"))
    put("3.eml", message(mid=None, body="no id", files=[("a.pdf", b"%PDF-1")]))
    put("note.txt", message())
    poll = lambda: M.poll(M.ingested(M.mailbox(spark, str(inbox))), str(out), str(state), once=True).awaitTermination()
    poll()
    assert spark.read.parquet(str(out)).count() == 2
    put("4.eml", message(mid="<1@x>"))
    put("5.eml", message(mid="<5@x>", files=[("b.gif", b"GIF89a"), ("c.bin", b"zz")]))
    poll()
    mail = spark.read.parquet(str(out))
    assert sorted(r.message_id or "" for r in mail.collect()) == sorted(["<5@x>", "", "<1@x>"])
    docs = I.documents_of(mail).groupBy("kind", "skip_reason").count().collect()
    assert {(r.kind, r.skip_reason): r["count"] for r in docs} == {("EMAIL_BODY", None): 3, ("ATTACHMENT", None): 2, ("ATTACHMENT", "UNSUPPORTED_TYPE"): 1}
