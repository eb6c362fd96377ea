"""Lexical retrieval packing.

1. Texts are encoded where they are read. Whole windows of a long document are sequences already; what remains of each
   document, less than a window, moves on with the ids that it needs.
2. Remainders are dealt by content: a document's key are its ``SALIENT`` weightiest token ids, by the term frequency part of
   BM25 and the rank of the id in the vocabulary, which grows as tokens get rarer. Ranges of keys go to tasks in sorted
   order, so that documents on one subject, and copies, follow each other at any size of the corpus.
3. A shard is a bounded run of them. It is indexed by an inverted BM25 index over token ids. A seed document opens a window,
   the index ranks the shard's unused documents by the seed's terms, and the best fill the window; the one that overruns
   it is cut and its rest seeds the next window. A shard's last window is split into powers of two, so nothing is padded.

Where the input has an order to keep, as a curriculum does, ranges are those of the order. A task then takes up a band of
consecutive documents, shards lie within it by content, and its sequences are numbered by the first of their documents.

sequence_id holds the task's number in its high bits. Equal keys are told apart by a hash of the row's number, so that any
number of equal texts spreads over tasks.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on its own; very long texts are
encoded in pieces, cut where the vocabulary's pattern always splits; an empty table gives no pieces. Ids of any type will
do. Only doc_id, text and the order's columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, released, texts_of

WINDOW, END = 2048, 1
#: A shard holds so many documents, and a band of an order so many shards.
SHARD_DOCS, BAND_SHARDS = 512, 64
#: Ids that name a document's content; characters encoded at once.
SALIENT, PIECE = 4, 1 << 20
K1, B = 1.2, 0.75
SPECIAL = {"<|endoftext|>": 50256}
#: Between a character and a single space before another: a new token always begins there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, object] = {}


def encoder(name: str = "byte_bpe_50k"):
    """Encodes as ``tokenizers`` does from the vocabulary's JSON file; the ranks file has the same merges and is read faster."""
    if name not in _ENCODERS:
        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[name]


def token_ids(text: str, enc, piece: int = PIECE) -> np.ndarray:
    """The text's ids and the end id."""
    parts, at = [], 0
    while at < len(text):
        found = SAFE.search(text, at + piece) if len(text) - at > piece else None
        end = found.start() if found else len(text)
        part = text[at:end] if at or found else text
        parts.append(enc.encode_to_numpy(part, allowed_special="all" if "<|" in part else set(), disallowed_special=()))
        at = end
    return np.concatenate([*parts, np.array([END], np.uint32)])


def content_key(ids: np.ndarray) -> int:
    """The weightiest ids, the first in the highest bits."""
    terms, tf = np.unique(ids, return_counts=True)
    weight = np.log1p(terms.astype(np.float64)) * tf * (K1 + 1) / (tf + K1)
    key = 0
    for k in np.lexsort((terms, -weight))[:SALIENT].tolist():
        key = key << 16 | min(int(terms[k]), 0xFFFF)
    key <<= 16 * max(0, SALIENT - len(terms))
    return key - (1 << 64) if key >> 63 else key


class Index:
    """BM25 postings of a shard: for each term, its documents and their weights."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        self.terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs)) if n else ((), ())
        sizes = np.fromiter(map(len, docs), np.float64, n)
        owner = np.repeat(np.arange(n), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(counts)
        order = np.argsort(term, kind="stable")
        term, owner, tf = term[order].astype(np.int64), owner[order], tf[order]
        self.first = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        df = np.diff(self.first)[term]
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        self.owner, self.n = owner, n
        self.weight = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm[owner])

    def scores(self, k: int) -> np.ndarray:
        """The BM25 score of every document for the terms of document k."""
        starts, ends = self.first[self.terms[k]], self.first[self.terms[k] + 1]
        sizes = ends - starts
        ahead = np.cumsum(sizes) - sizes
        at = np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.owner[at], self.weight[at], self.n)


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once; all but powers of two are ``window`` long."""
    done, start = [], [0] * len(docs)
    for k, d in enumerate(docs):
        for at in range(0, len(d) - window + 1, window):
            done.append([(k, at, window)])
            start[k] = at + window
    left = np.array([len(d) - s for d, s in zip(docs, start)], np.int64)
    index = Index(docs) if (left > 0).any() else None
    current: list[tuple[int, int, int]] = []
    seed, lowest = -1, 0
    while True:
        if seed < 0 or not left[seed]:
            while lowest < len(docs) and not left[lowest]:
                lowest += 1
            if lowest == len(docs):
                break
            seed = lowest
        free = window

        def give(k: int) -> None:
            nonlocal free
            n = min(free, int(left[k]))
            current.append((k, start[k], n))
            start[k] += n
            left[k] -= n
            free -= n

        first = seed
        give(first)
        if free:
            scores = index.scores(first)
            scores[left == 0] = -1.0
            best = np.argpartition(-scores, 8)[:8] if len(docs) > 8 else np.arange(len(docs))
            for chosen in (best, None):
                if chosen is None:
                    chosen = np.arange(len(docs))
                for k in chosen[np.lexsort((chosen, -scores[chosen]))].tolist():
                    if free and left[k]:
                        give(k)
                        seed = k
                if not free:
                    break
        if free:
            break  # nothing is left
        done.append(current)
        current = []
    total = sum(n for *_, n in current)
    for bit in range(total.bit_length() - 1, -1, -1):
        size = 1 << bit
        if not total & size:
            continue
        part = []
        while size:
            k, at, n = current.pop(0)
            take = min(n, size)
            part.append((k, at, take))
            size -= take
            if n > take:
                current.insert(0, (k, at + take, n - take))
        done.append(part)
    return done


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """A table and the place of its rows in its files, which is the order that it was written in."""
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:  # not read from files
        docs = cut(docs)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return docs, [F.coalesce(part, F.lit(0).cast("long")), *place]


def encoded(docs: DataFrame, window: int, with_ids: bool, order: list[Column]) -> DataFrame:
    """(doc_id, place, rid, key, start, doc_tokens, length, crc, ids): whole windows, and the rest with its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct(*[c.alias(f"at{k}") for k, c in enumerate(order)] or [F.lit(0).alias("at0")]).alias("place")
    rows = docs.select("doc_id", place, F.monotonically_increasing_id().alias("rid"), "text")
    place_kind = rows.schema["place"].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            source, found, known = [], [], {}  # equal texts of a batch are encoded once
            for k, text in enumerate(texts_of(batch)):
                if text not in known:
                    known[text] = token_ids(text, enc)
                ids = known[text]
                rest = len(ids) // window * window
                key = content_key(ids[rest:] if rest < len(ids) else ids[-window:])
                for at in [*range(0, rest, window), *([rest] if rest < len(ids) else [])]:
                    part = ids[at : at + window]
                    raw = part.astype("<u4").tobytes()
                    source.append(k)
                    found.append((key, at, len(ids), len(part), zlib.crc32(raw), raw if with_ids or len(part) < window else None))
            taken = batch.select(["doc_id", "place", "rid"]).take(pa.array(source, pa.int64()))
            types = [*[pa.int64()] * 5, pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], ["doc_id", "place", "rid", "key", "start", "doc_tokens", "length", "crc", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, place {place_kind}, rid long, key long, start long, doc_tokens long, length long, crc long, ids binary")


def pack_documents(docs: DataFrame, window: int = WINDOW, with_ids: bool = False, order: list[Column] | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length (and ids).

    With ``order``, columns of ``docs``, sequence_id grows with the documents' places in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = cut(encoded(docs, window, with_ids, order or []).withColumn("tie", F.xxhash64("rid")))  # ranges are found by reading it twice
    if order:
        places = [f"place.at{k}" for k in range(len(order))]
        parts = parts.repartitionByRange(*places, "tie").sortWithinPartitions(*places, "tie", "start")
    else:
        parts = parts.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "start")
    names = COLUMNS + (["ids"] if with_ids else [])
    ordered, shard_docs = bool(order), SHARD_DOCS
    held_docs = shard_docs * (BAND_SHARDS if ordered else 1)

    def band(rows: pa.Table, base: int) -> tuple[pa.RecordBatch, int]:
        """The sequences of rows in order, numbered from ``base`` on."""
        start, total, length, crc, key = (rows.column(c).to_numpy() for c in ("start", "doc_tokens", "length", "crc", "key"))
        whole = np.flatnonzero(length == window)
        rest = np.flatnonzero(length < window)
        by_content = rest[np.argsort(key[rest], kind="stable")] if ordered else rest
        sequences: list[tuple[int, list[tuple[int, int, int]]]] = [(k, [(k, 0, window)]) for k in whole.tolist()]
        raws = rows.column("ids")
        ids = {k: np.frombuffer(raws[k].as_buffer(), "<u4") for k in by_content.tolist()}
        for lo in range(0, len(by_content), shard_docs):
            shard = by_content[lo : lo + shard_docs].tolist()
            for pieces in pack([ids[k] for k in shard], window):
                pieces = [(shard[k], at, n) for k, at, n in pieces]
                sequences.append((min(k for k, *_ in pieces), pieces))
        if ordered:
            sequences.sort(key=lambda s: s[0])
        source, found, pieces_ids = [], [], []
        for s, (_, pieces) in enumerate(sequences):
            size, offset = sum(n for *_, n in pieces), 0
            for k, at, n in pieces:
                piece = ids[k][at : at + n].tobytes() if k in ids else raws[k].as_py()
                source.append(k)
                found.append((int(start[k]) + at, n, zlib.crc32(piece) if k in ids else int(crc[k]), int(total[k]), base + s, offset, size))
                offset += n
                if with_ids:
                    pieces_ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
        arrays = [rows.column("doc_id").take(pa.array(source, pa.int64())).combine_chunks(), *(pa.array(c, pa.int64()) for c in zip(*found))]
        if with_ids:
            arrays.append(pa.array(pieces_ids, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names), len(sequences)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = [], TaskContext.get().partitionId() << 33
        n = 0
        for batch in batches:
            while batch.num_rows:
                here = batch.slice(0, held_docs - n)
                batch = batch.slice(here.num_rows)
                held.append(here)
                n += here.num_rows
                if n >= held_docs:
                    out, more = band(pa.Table.from_batches(held), base)
                    yield out
                    held, n, base = [], 0, base + more
        if held:
            yield band(pa.Table.from_batches(held), base)[0]

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:]) + (", ids array<int>" if with_ids else "")
    return parts.select("doc_id", "key", "start", "doc_tokens", "length", "crc", "ids").mapInArrow(run, schema)
