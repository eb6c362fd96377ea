"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number and trailer in the stored bytes in one pass. At each hit a validator of
that format reads the structure that the format promises (chunk lengths, checksums, trailers, sector tables); only what is
confirmed counts. A confirmed hit at the start gives the true type, which corrects a declared one; confirmed hits further
in are carved. FLAC frames bear no length: a stream ends where the next confirmed medium begins, or at the end.

Bytes with many false hits cost no more than others: trailers and braces are located once and looked up by binary search,
and what a walk from one place found is remembered for the walks that come by there.

Payloads are stored losslessly as 8-bit mono samples in a RIFF/WAVE container and read back through the same sniffing.

Defined results: a null content is empty; an empty content has no type (``application/x-empty``); unknown bytes are
``application/octet-stream``; equal contents give equal results; an empty table gives an empty result. Only the named
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The magic numbers of the formats, and the type that each stands for.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"BM": "image/bmp",
    b"fLaC": "audio/flac",
    b"OggS": "application/ogg",
    b"{\\rtf": "application/rtf",
    b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "application/x-ole-storage",
}
EMPTY, UNKNOWN = "application/x-empty", "application/octet-stream"
BLOCK, RATE = 64, 8000
#: The type that the query's column is said to have.
DECLARED = "text/plain"


#: The trailers that end a PDF and a ZIP archive.
PDF_END, ZIP_END = b"%%EOF", b"PK\x05\x06"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in (MAGIC | {PDF_END: PDF_END, ZIP_END: ZIP_END}).items():
        found.add_word(magic.decode("latin-1"), (magic, kind))
    found.make_automaton()
    return found


class Places:
    """What validators look up in one content: trailers and headers by place, matching braces, and walks done before."""

    def __init__(self, content: bytes, hits: list[tuple[int, object]]) -> None:
        self.content, self.hits, self.done = content, hits, {}

    @functools.cached_property
    def pdf(self) -> tuple[list[int], list[int]]:
        return [at for at, kind in self.hits if kind == "application/pdf"], [at for at, kind in self.hits if kind == PDF_END]

    @functools.cached_property
    def zip(self) -> dict[int, int]:
        """Where an archive begins, by the sizes in its end record, to the end of its first such record."""
        b, found = self.content, {}
        for end in (at for at, kind in self.hits if kind == ZIP_END):
            if end + 22 <= len(b):
                size, start, note = struct.unpack("<IIH", b[end + 12 : end + 22])
                if end + 22 + note <= len(b):
                    found.setdefault(end - size - start, end + 22 + note)
        return found

    @functools.cached_property
    def braces(self) -> tuple[list[int], list[int], dict[int, list[int]]]:
        """Places of braces that no backslash escapes, the depth after each, and the closing ones by that depth."""
        at, depths, closing, depth = [], [], {}, 0
        for m in BRACE.finditer(self.content):
            c = m[0][-1:]
            if c in b"{}" and len(m[0]) == 1:
                depth += 1 if c == b"{" else -1
                at.append(m.start())
                depths.append(depth)
                if c == b"}":
                    closing.setdefault(depth, []).append(m.start())
        return at, depths, closing

    def walk(self, kind: str, pos: int, step: Callable[[int], tuple[int, int]]) -> int:
        """Follows (end if found, next place) from ``pos``; places of one kind that were passed before give their result."""
        passed = []
        while True:
            if (kind, pos) in self.done:
                end = self.done[kind, pos]
                break
            passed.append(pos)
            end, pos = step(pos)
            if end or pos < 0:
                break
        for p in passed:
            self.done[kind, p] = end
        return end


#: A backslash with what it escapes, or a brace.
BRACE = re.compile(rb"\\.|[{}]", re.S)


def _wav(b: bytes, at: int, places: Places) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, pos, seen = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, set()
    if end > len(b):
        return 0
    while pos + 8 <= end:
        seen.add(b[pos : pos + 4])
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        pos += 8 + size + size % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int, places: Places) -> int:
    def step(pos: int) -> tuple[int, int]:
        size, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or zlib.crc32(memoryview(b)[pos + 4 : pos + 8 + size]) != int.from_bytes(b[pos + 8 + size : pos + 12 + size], "big"):
            return 0, -1
        return (pos + 12 + size if kind == b"IEND" else 0), pos + 12 + size

    end = places.walk("png", at + 8, step) if b[at + 12 : at + 16] == b"IHDR" else 0
    return max(0, end - at)


def _jpeg(b: bytes, at: int, places: Places) -> int:
    """Segments by their lengths, scans up to the next marker that isn't a restart, to the end of image."""

    def step(pos: int) -> tuple[int, int]:
        if pos + 2 > len(b) or b[pos] != 0xFF:
            return 0, -1
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2, -1
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if kind < 0xC0 or kind == 0xD8 or size < 2:
            return 0, -1
        if kind != 0xDA:
            return 0, pos + 2 + size
        marker = SCAN_END.search(b, pos + 2 + size)
        return (0, marker.start()) if marker else (0, -1)

    return max(0, places.walk("jpeg", at + 2, step) - at)


#: In a scan's data: a marker that is neither a stuffed byte nor a restart.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _gif(b: bytes, at: int, places: Places) -> int:
    def step(pos: int) -> tuple[int, int]:
        kind = b[pos] if pos < len(b) else 0
        if kind == 0x3B:
            return pos + 1, -1
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        else:
            return 0, -1
        return 0, places.walk("gif blocks", pos, blocks) or -1

    def blocks(pos: int) -> tuple[int, int]:
        if pos >= len(b):
            return 0, -1
        return (0, pos + 1 + b[pos]) if b[pos] else (pos + 1, -1)

    if len(b) < at + 13:
        return 0
    return max(0, places.walk("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), step) - at)


def _pdf(b: bytes, at: int, places: Places) -> int:
    """To the last end mark before the next header: a file saved again has several."""
    heads, ends = places.pdf
    k = bisect.bisect_right(heads, at)
    last = bisect.bisect_left(ends, heads[k] if k < len(heads) else len(b)) - 1
    return ends[last] + len(PDF_END) - at if last >= 0 and ends[last] > at and b[at + 5 : at + 6].isdigit() else 0


def _zip(b: bytes, at: int, places: Places) -> int:
    """To the end record whose sizes lead back here, so that archives within the archive don't end it."""
    return max(0, places.zip.get(at, 0) - at)


def _bmp(b: bytes, at: int, places: Places) -> int:
    if len(b) < at + 26:
        return 0
    size, spare, pixels = struct.unpack("<III", b[at + 2 : at + 14])
    return size if not spare and 26 <= pixels <= size <= len(b) - at and b[at + 14] in (12, 40, 108, 124) else 0


def _flac(b: bytes, at: int, places: Places) -> int:
    """To the first frame's header, behind all metadata blocks."""

    def step(pos: int) -> tuple[int, int]:
        if pos + 4 > len(b):
            return 0, -1
        after = pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
        if b[pos] & 0x80:
            return (after if b[after : after + 1] == b"\xff" and b[after + 1 : after + 2] in (b"\xf8", b"\xf9") else 0), -1
        return 0, after

    stream = b[at + 4 : at + 5] in (b"\x00", b"\x80") and b[at + 5 : at + 8] == b"\x00\x00\x22"
    return max(0, places.walk("flac", at + 4, step) - at) if stream else 0


def _ogg(b: bytes, at: int, places: Places) -> int:
    """All pages that follow each other whole."""

    def step(pos: int) -> tuple[int, int]:
        n = b[pos + 26] if pos + 27 <= len(b) else 0
        after = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if b[pos : pos + 5] != b"OggS\x00" or pos + 27 > len(b) or after > len(b):
            return pos, -1
        return 0, after

    return max(0, places.walk("ogg", at, step) - at)


def _rtf(b: bytes, at: int, places: Places) -> int:
    """To the brace that closes the first one."""
    braces, depths, closing = places.braces
    k = bisect.bisect_right(braces, at) - 1
    found = closing.get((depths[k] if k >= 0 else 0) - 1, [])
    k = bisect.bisect_right(found, at)
    return found[k] + 1 - at if k < len(found) else 0


def _ole(b: bytes, at: int, places: Places) -> int:
    """As many sectors as the sector table has in use."""
    if len(b) < at + 512 or b[at + 28 : at + 30] != b"\xfe\xff":
        return 0
    shift, tables, more = b[at + 30], int.from_bytes(b[at + 44 : at + 48], "little"), int.from_bytes(b[at + 68 : at + 72], "little")
    if shift not in (9, 12):
        return 0
    size = 1 << shift
    if not 0 < tables <= (len(b) - at) // size:
        return 0
    sectors = list(struct.unpack("<109I", b[at + 76 : at + 512]))
    while len(sectors) < tables and more < 0xFFFFFFFA:  # the list of tables goes on in sectors of its own
        part = b[at + size * (more + 1) : at + size * (more + 2)]
        if len(part) < size:
            return 0
        *listed, more = struct.unpack(f"<{size // 4}I", part)
        sectors += listed
    used = 0
    for k, sector in enumerate(sectors[:tables]):
        part = b[at + size * (sector + 1) : at + size * (sector + 2)]
        if len(part) < size:
            return 0
        entries = struct.unpack(f"<{size // 4}I", part)
        taken = [i for i, x in enumerate(entries) if x != 0xFFFFFFFF]
        used = max(used, k * (size // 4) + taken[-1] + 1) if taken else used
    length = size * (used + 1)
    return length if used and at + length <= len(b) else 0


VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "application/pdf": _pdf, "application/zip": _zip,
    "image/bmp": _bmp, "audio/flac": _flac, "application/ogg": _ogg, "application/rtf": _rtf, "application/x-ole-storage": _ole,
}


#: Formats without a length: they reach to the next medium.
OPEN = {"audio/flac"}


def sniff(content: bytes, found: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]]]:
    """The type of the whole, and (type, start, length) of the media confirmed within it, outermost only."""
    if not content:
        return EMPTY, []
    hits = [(end - len(magic) + 1, named) for end, (magic, named) in found.iter(content.decode("latin-1"))]
    hits.sort(key=lambda hit: hit[0])
    places = Places(content, hits)
    kind, carved, free = UNKNOWN, [], 0
    for at, named in hits:
        if named not in VALIDATORS or at and at < free:
            continue
        size = VALIDATORS[named](content, at, places)
        if size and not at:
            kind, free = named, _header(content, named)
        elif size:
            carved.append([named, at, size])
            free = at + size
    ends = [at for _, at, _ in carved[1:]] + [len(content)]
    return kind, [(named, at, end - at if named in OPEN else size) for (named, at, size), end in zip(carved, ends)]


def corrected(kind: str, declared: str | None) -> str:
    """The type to go by: the one found, or where nothing is known the declared one."""
    return kind if kind != UNKNOWN or declared is None else declared


def _header(content: bytes, kind: str) -> int:
    """Where a container's own content begins; nothing is carved from its header."""
    return content.find(b"data") + 8 if kind == "audio/wav" else 8


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def store(payload: bytes) -> bytes:
    """8-bit mono samples in a WAVE container; chunks of odd length are padded, as the format asks."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + bytes(odd)


def read_back(media: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    pos = 12
    while media[pos : pos + 4] != b"data":
        size = int.from_bytes(media[pos + 4 : pos + 8], "little")
        pos += 8 + size + size % 2
    size = int.from_bytes(media[pos + 4 : pos + 8], "little")
    return media[pos + 8 : pos + 8 + size]


def sniff_column(df: DataFrame, key: str, content: str, declared: str | None = None) -> DataFrame:
    """(key, declared_type, media_type, corrected, carved array of (type, start, length, sha256)) of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            types, fixed, parts = [], [], []
            said = batch.column(2).to_pylist() if declared else [None] * batch.num_rows
            for x, was in zip(batch.column(1), said):
                b = x.as_py() or b""
                kind, carved = sniff(b, found)
                types.append(corrected(kind, was))
                fixed.append(was is not None and was != types[-1])
                parts.append([{"type": k, "start": s, "length": n, "sha256": hashlib.sha256(b[s : s + n]).hexdigest()} for k, s, n in carved])
            part = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(said, pa.string()), pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(parts, part)],
                [key, "declared_type", "media_type", "corrected", "carved"],
            )

    kind = df.schema[key].dataType.simpleString()
    columns = [df[key], df[content].cast("binary").alias("content"), *([df[declared].alias("declared")] if declared else [])]
    return df.select(*columns).mapInArrow(
        run, f"{key} {kind}, declared_type string, media_type string, corrected boolean, carved array<struct<type:string,start:bigint,length:bigint,sha256:string>>"
    )


def store_and_sniff(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    What is stored is declared as what it was, ``DECLARED``. The feature names the corrected type, whether that differs,
    and the number and bytes of media carved from the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for x in batch.column("text"):
                n, payload = payload_of(x.as_py())
                media = store(payload)
                kind, carved = sniff(media, found)
                back = read_back(media)
                true = corrected(kind, DECLARED)
                feature = f"{true};corrected={int(true != DECLARED)};carved={len(carved)};bytes={sum(c[2] for c in carved)}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
