"""Suffix-array dedup: removes every byte covered by a ``LENGTH``-byte string that starts earlier too.

Sorting every suffix of a corpus would move each byte many times over. Equal strings of ``LENGTH`` bytes choose the same
anchor, though: the leftmost of their grams with the least hash. So the suffixes are sorted in small groups:

1. Where texts are read, prefix polynomial hashes give all gram hashes, and a sliding minimum the anchors. An anchor stands
   for the run of windows that chose it; its context is all their bytes. Equal contexts of one chunk are pre-aggregated,
   after a comparison of their bytes.
2. Anchors meet by gram hash. Of equal contexts the first stays, the others are covered. Contexts lie in different tasks
   here, so equality is that of a 128-bit cryptographic digest of their bytes, never of the polynomial hash.
   Only where contexts of one gram differ do single windows have to be compared.
3. For those, contexts are cut from the texts and meet by gram. A mergesort orders the windows' suffixes; two suffixes are
   compared by binary search for their common extension on prefix hashes. Neighbours that agree on ``LENGTH`` bytes are
   equal strings, which is verified byte by byte; a collision is resolved by comparing strings.
4. Covered intervals go back to their rows, merge, and the rest of the text is kept.

Every row has a number of its own (``rid``, its place in the table as read) besides its document's place in the order, so
rows that share a doc_id, or have none, are never mixed up and never meet in one task for it. An input that isn't a table
is written as one first, as only a table gives its rows in the same order each time.

Hot grams: equal contexts are reduced in each chunk, and need 48 bytes in step 2. There rows are dealt by gram, those of
hot grams by context, so that a gram with many contexts spreads over tasks, and stream in sorted order, so that tasks hold a
block of rows however many they get. A hot gram, or one with more than ``HOT`` contexts, is dealt out window by window in
step 3, by the hash of the window, and equal windows are reduced before they move (``DEALT`` of them are held); so no group
of step 3 is larger than ``HOT`` contexts or what equal windows of different tasks make.

Defined results: a null text is empty; a null doc_id counts as larger than any other; rows with one doc_id, or none, are
documents of their own, earlier ones in the table first, so of repeated rows all but one lose everything, if ``LENGTH``
bytes long; texts shorter than that are kept whole; very long texts are read in overlapping pieces with the same result;
an empty table gives an empty result. Ids of any type that has an order will do. Extra columns are carried in one struct,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, released, stable

LENGTH, GRAM = 100, 28
#: Bytes hashed together; contexts of one gram that are sorted as one group; bytes of contexts sorted at once.
CHUNK, HOT, SORTED = 1 << 19, 1000, 1 << 20
#: Rows that a task takes up at once.
BLOCK = 100_000
#: Windows of hot grams that a task holds before it passes them on.
DEALT = 50_000
#: One in so many rows tells which grams are hot.
SAMPLED = 64
LAST = (1 << 63) - 1
INTERVAL = 127

_POSITION = np.uint64((1 << 21) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(0x5AFE).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers, and the inverse powers: (sums[e] - sums[s]) * inverse[s] hashes data[s:e]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    return sums, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pack(position: np.ndarray, ahead: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Position, bytes from the first window to the anchor, and windows after the first."""
    return (position << 14) | (ahead << 7) | more


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, (at >> 7) & 127, at & 127


def digests(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each data[lo:lo+size], as two columns."""
    view, digest = memoryview(data), hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (lo + size).tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash, context hash) for pieces of ``data``, all longer than a window."""
    sums, down = prefix_hashes(data)
    n = len(data)
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    least = (mixed(grams) & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= LENGTH - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    edge = np.zeros(len(least) + 1, np.int8)
    edge[starts] = 1
    edge[starts + sizes - LENGTH + 1] = -1
    windows = np.flatnonzero(np.cumsum(edge[:-1]))
    chosen = (least[windows] & _POSITION).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    anchor, lo, hi = chosen[first], windows[first], windows[last]
    context = (sums[hi + LENGTH] - sums[lo]) * down[lo]
    shape = ((anchor - lo) * 128 + (hi - lo)).astype(np.uint64)
    return anchor, lo, hi, grams[anchor], mixed(context + shape * np.uint64(0xD6E8FEB86659FD93))


def same_bytes(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[x:x+size] equals b[y:y+size], row by row."""
    out = np.ones(len(x), bool)
    step = 4096
    for k in range(0, len(x), step):
        n = size[k : k + step]
        at = np.arange(int(n.max()) if len(n) else 0)
        used = at[None, :] < n[:, None]
        left = a[np.where(used, x[k : k + step, None] + at, 0)]
        right = b[np.where(used, y[k : k + step, None] + at, 0)]
        out[k : k + step] = ((left == right) | ~used).all(axis=1)
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each owner (small whole numbers), joined where they touch or overlap."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    base = owner.astype(np.int64) << 36
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - base[last]


@released
def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rid, text) to (gram, c1, c2, doc, rid, at): anchors, and intervals covered by the same chunk."""

    def finish(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        sizes = np.fromiter((len(p[3]) for p in pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        docs, rids, moves = (np.fromiter((p[k] for p in pieces), np.int64, len(pieces)) for k in range(3))
        moves = moves - starts
        anchor, lo, hi, gram, context = anchors(data, starts, sizes)
        piece = np.searchsorted(starts, lo, "right") - 1
        at = pack(anchor + moves[piece], anchor - lo, hi - lo)
        order = np.lexsort((at, rids[piece], docs[piece], context, gram))
        again = np.zeros(len(order), bool)
        again[1:] = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        k, first = order[again], order[head[again]]
        k = k[same_bytes(data, data, lo[k], lo[first], hi[k] - lo[k] + LENGTH)]
        keep = np.ones(len(anchor), bool)
        keep[k] = False
        owner, s, e = merged(piece[k], lo[k], hi[k] + LENGTH)
        digest = digests(data, lo[keep], hi[keep] - lo[keep] + LENGTH)
        place = (anchor - lo)[keep]  # equal bytes are one context only if their anchor is in the same place
        zero = np.zeros(len(owner), np.int64)
        columns = (
            np.concatenate((gram[keep].view(np.int64), mixed(rids[owner].view(np.uint64) + np.uint64(1)).view(np.int64))),
            np.concatenate((digest[:, 0], e + moves[owner])),
            np.concatenate((digest[:, 1] ^ place, zero)),
            np.concatenate((docs[piece[keep]], docs[owner])),
            np.concatenate((rids[piece[keep]], rids[owner])),
            np.concatenate((at[keep], pack(s + moves[owner], np.full(len(s), INTERVAL), zero))),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(ANCHOR))

    pieces, held = [], 0
    for batch in batches:
        docs, rids = batch.column("doc").to_pylist(), batch.column("rid").to_pylist()
        for doc, rid, text in zip(docs, rids, batch.column("text")):
            raw = (text.as_py() or "").encode()
            for base in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
                piece = raw[base : base + CHUNK + LENGTH - 1]
                if held and held + len(piece) > CHUNK:
                    yield finish(pieces)
                    pieces, held = [], 0
                pieces.append((doc, rid, base, piece))
                held += len(piece)
    if pieces:
        yield finish(pieces)


def longs(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy() for c in names)


def rows(doc: np.ndarray, rid: np.ndarray, at: np.ndarray, value: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), len(doc)).copy()
    return pa.RecordBatch.from_arrays([*map(pa.array, (doc, rid, at, value, kinds))], ["doc", "rid", "at", "value", "kind"])


ROWS = "doc long, rid long, at long, value long, kind int"
#: What anchors are sorted by: the gram, the context's digest in two halves, the document, the row, the place in it.
ANCHOR = ("gram", "c1", "c2", "doc", "rid", "at")
ANCHORS = ", ".join(f"{c} long" for c in ANCHOR)
#: Kinds of rows: a covered interval (value: its end), a context to compare (value: its gram), one of a hot gram.
COVERED, COMPARE, DEAL = 1, 2, 3


def blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns as arrays of some ``BLOCK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield longs(pa.Table.from_batches(held), *names)
            held, n = [], 0
    if n:
        yield longs(pa.Table.from_batches(held), *names)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key in tables of some ``BLOCK`` rows that cut no group in two."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end:
                yield table.slice(0, end)
            held = table.slice(end).combine_chunks().to_batches()
            n = len(table) - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def match_anchors(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by gram, context, document, row and place to covered intervals and contexts to compare.

    Rows stream through: of each context only its head is held, and of one gram ``HOT`` heads at most. The contexts of a
    ``hot`` gram lie in many tasks, equal ones in one, so they are dealt out there as here.
    """
    before = (0, 0, 0, False)  # the row before this block, and whether there is one
    pending = (np.zeros(0, np.int64),) * 4  # heads of the last gram: gram, doc, rid, at
    dealt = None
    for gram, c1, c2, doc, rid, at in blocks(batches, *ANCHOR):
        done = (at >> 7) & 127 == INTERVAL
        if done.any():
            start, _, _ = unpack(at[done])
            zero = np.zeros(len(start), np.int64)
            yield rows(doc[done], rid[done], pack(start, zero, zero), c1[done], COVERED)
            gram, c1, c2, doc, rid, at = (c[~done] for c in (gram, c1, c2, doc, rid, at))
        if not len(gram):
            continue
        head = np.zeros(len(gram), bool)
        for x, c in zip(before, (gram, c1, c2)):
            head |= c != np.concatenate(([x], c[:-1]))
        head[0] |= not before[3]
        before = (int(gram[-1]), int(c1[-1]), int(c2[-1]), True)
        if not head.all():
            place, ahead, more = unpack(at[~head])
            zero = np.zeros(len(place), np.int64)
            yield rows(doc[~head], rid[~head], pack(place - ahead, zero, zero), place - ahead + more + LENGTH, COVERED)
        gram, doc, rid, at = (np.concatenate((p, c[head])) for p, c in zip(pending, (gram, doc, rid, at)))
        if not len(gram):
            continue
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        all_dealt = np.isin(gram, hot) | (size > HOT)
        if dealt is not None:
            all_dealt |= gram == dealt
        ready = (gram != gram[-1]) | all_dealt
        chosen = ready & (all_dealt | (size > 1))
        if chosen.any():
            yield rows(doc[chosen], rid[chosen], at[chosen], gram[chosen], np.where(all_dealt[chosen], DEAL, COMPARE))
        dealt = int(gram[-1]) if all_dealt[-1] else None
        pending = tuple(c[~ready] for c in (gram, doc, rid, at))
    if len(pending[0]) > 1:
        yield rows(pending[1], pending[2], pending[3], pending[0], COMPARE)


@released
def join_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges covered intervals of each row; they are sorted by row."""
    for table in whole_groups(batches, "rid"):
        doc, rid, at, value, kind = longs(table, "doc", "rid", "at", "value", "kind")
        rest = kind != COVERED
        if rest.any():
            yield rows(doc[rest], rid[rest], at[rest], value[rest], kind[rest])
        doc, rid, at, value = doc[~rest], rid[~rest], at[~rest], value[~rest]
        if len(doc):
            _, names, owner = np.unique(rid, return_index=True, return_inverse=True)
            own, start, end = merged(owner, at >> 14, value)
            zero = np.zeros(len(own), np.int64)
            yield rows(doc[names][own], rid[names][own], pack(start, zero, zero), end, COVERED)


@released
def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their contexts to compare to (gram, doc, rid, at, value, bytes); bytes are null for covered intervals."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["gram", "doc", "rid", "at", "value", "bytes"])

    def passed_on(dealt: dict) -> Iterator[tuple]:
        for window, (doc, rid, at) in dealt.items():
            yield (xxhash.xxh64_intdigest(window, 1) - (1 << 63), doc, rid, at, 0, window)
        dealt.clear()

    found, dealt = [], {}
    for batch in batches:
        wanted = batch.column("wanted")
        for k in np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False)).tolist():
            raw, doc, rid = (batch.column("text")[k].as_py() or "").encode(), batch.column("doc")[k].as_py(), batch.column("rid")[k].as_py()
            for row in wanted[k].as_py():
                at, gram = row["at"], row["value"]
                lo, more = (at >> 14) - ((at >> 7) & 127), at & 127
                if row["kind"] == COMPARE:
                    found.append((gram, doc, rid, at, 0, raw[lo : lo + more + LENGTH]))
                    continue
                for s in range(lo, lo + more + 1):
                    window, mine = raw[s : s + LENGTH], (doc, rid, s << 14)
                    first = dealt.setdefault(window, mine)
                    if first != mine:
                        dealt[window], late = min(first, mine), max(first, mine)
                        found.append((gram ^ rid, *late, (late[2] >> 14) + LENGTH, None))
                if len(dealt) > DEALT:
                    found += passed_on(dealt)
                if len(found) > 20_000:
                    yield out(found)
                    found = []
    found += passed_on(dealt)
    if found:
        yield out(found)


class Suffixes:
    """Compares suffixes of a buffer, up to ``LENGTH`` bytes, by prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.sums, self.down = prefix_hashes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes agree, found by binary search."""
        done = np.zeros(len(x), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            a, b = x + done, y + done
            fits = done + step <= LENGTH
            ea, eb = np.where(fits, a + step, a), np.where(fits, b + step, b)
            equal = (self.sums[ea] - self.sums[a]) * self.down[a] == (self.sums[eb] - self.sums[b]) * self.down[b]
            done += np.where(fits & equal, step, 0)
            step >>= 1
        return done

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        inside = n < LENGTH
        return np.where(inside, self.data[np.where(inside, x + n, 0)] < self.data[np.where(inside, y + n, 0)], or_equal)

    def mergesort(self, suffix: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The stable order of ``suffix`` within segments that begin at ``first`` and have ``size`` members.

        Runs of 1, 2, 4, ... merge by rank: a suffix moves on by the number of those in the neighbour run before it.
        """
        order = np.arange(len(suffix))
        local = order - np.repeat(first, size)
        start, size = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while len(size) and width < size.max():
            live = np.flatnonzero(size > width)
            run = local[live] // width
            lo = start[live] + (run ^ 1) * width
            hi = np.minimum(lo + width, start[live] + size[live])
            there = lo < hi
            live, run, lo, hi = live[there], run[there], lo[there], hi[there]
            low, high = lo.copy(), hi.copy()
            mine, after = suffix[order[live]], run % 2 == 1
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                before = self.less(suffix[order[middle]], mine[open_], after[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            moved = start[live] + (run // 2) * 2 * width + local[live] % width + (low - lo)
            new = order.copy()
            new[moved] = order[live]
            order = new
            width *= 2
        return order


def repeated_windows(group: np.ndarray, at: np.ndarray, offset: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) pairs that repeat an earlier context's window. Contexts are in order, earliest first, by group."""
    _, ahead, more = unpack(at)
    owner = np.repeat(np.arange(len(at)), more + 1)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    place = ahead[owner] - window  # of the anchor within the window: equal strings have it in the same place
    segment = group[owner] * 128 + place
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    new = np.ones(len(segment), bool)
    new[1:] = segment[1:] != segment[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(segment)))
    alone = np.repeat(size == 1, size)
    order, size = order[~alone], size[size > 1]
    owner, window = owner[order], window[order]
    if not len(owner):
        return owner, window
    first = np.cumsum(size) - size
    suffixes = Suffixes(data)
    suffix = offset[owner] + window
    order = suffixes.mergesort(suffix, first, size)
    owner, window, suffix = owner[order], window[order], suffix[order]
    same = np.zeros(len(order), bool)
    inner = np.ones(len(order), bool)
    inner[first] = False
    at_ = np.flatnonzero(inner)
    same[at_] = suffixes.common(suffix[at_ - 1], suffix[at_]) == LENGTH
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    late = np.flatnonzero(same)
    if not len(late):
        return owner[late], window[late]
    return _verified(owner[late], window[late], owner[head[late]], suffix[head[late]] - suffix[late], offset, data, group)


def _verified(owner, window, source, shift, offset, data, group) -> tuple[np.ndarray, np.ndarray]:
    """Compares the bytes of runs of repeated windows with the source's; where hashes collided, string by string."""
    order = np.lexsort((window, source, owner))
    owner, window, source, shift = owner[order], window[order], source[order], shift[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    x = offset[owner[first]] + window[first]
    right = same_bytes(data, data, x, x + shift[first], window[last] - window[first] + LENGTH)
    good = np.repeat(right, last - first + 1)
    for k in np.flatnonzero(~good).tolist():
        mine = offset[owner[k]] + window[k]
        text = data[mine : mine + LENGTH].tobytes()
        ends = np.append(offset, len(data))
        good[k] = any(text in data[ends[i] : ends[i + 1]].tobytes() for i in range(owner[k]) if group[i] == group[owner[k]])
    return owner[good], window[good]


@released
def sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram to covered intervals."""
    for table in whole_groups(batches, "gram"):
        yield from _compared(table)


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    gram, doc, rid, at, value = longs(table, "gram", "doc", "rid", "at", "value")
    texts = table.column("bytes").combine_chunks()
    cut_ = texts.is_valid().to_numpy(zero_copy_only=False)
    if not cut_.all():
        yield rows(doc[~cut_], rid[~cut_], at[~cut_], value[~cut_], COVERED)
    live = np.flatnonzero(cut_)
    live = live[np.lexsort((at[live], rid[live], doc[live], gram[live]))]
    if not len(live):
        return
    gram, doc, rid, at = gram[live], doc[live], rid[live], at[live]
    new = np.ones(len(live), bool)
    new[1:] = gram[1:] != gram[:-1]
    first = np.append(np.flatnonzero(new), len(live))
    work = np.append(0, np.cumsum((at & 127) + LENGTH))[first]
    k = 0
    while k < len(first) - 1:
        to = max(k + 1, int(np.searchsorted(work, work[k] + SORTED, "right")) - 1)
        part = slice(first[k], first[to])
        k = to
        if part.stop - part.start < 2:
            continue
        chunks = texts.take(pa.array(live[part])).to_pylist()
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        data = np.frombuffer(b"".join(chunks), np.uint8)
        own_at, own_doc, own_rid = at[part], doc[part], rid[part]
        owner, window = repeated_windows(np.cumsum(new[part]), own_at, np.cumsum(sizes) - sizes, data)
        if len(owner):
            place, ahead, _ = unpack(own_at)
            own, start, end = merged(owner, (place - ahead)[owner] + window, (place - ahead)[owner] + window + LENGTH)
            zero = np.zeros(len(own), np.int64)
            yield rows(own_doc[own], own_rid[own], pack(start, zero, zero), end, COVERED)


def numbered(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """doc (the document's place in the order, null last), rid (the row's own number), text, and what is carried."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.monotonically_increasing_id().alias("rid"), "text", *carried)
    ids = docs.select(F.col("doc_id").alias("known")).where("known is not null").distinct()
    order = cut(ids.repartitionByRange("known").sortWithinPartitions("known").withColumn("doc", F.monotonically_increasing_id()))
    rows_ = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text", *[c.alias(f"carried{k}") for k, c in enumerate(carried)])
    names = [docs.select(c).columns[0] for c in carried]
    both = rows_.join(order, F.col("doc_id") == F.col("known"), "left")
    return both.select(F.coalesce("doc", F.lit(LAST)).alias("doc"), "rid", "text", *[F.col(f"carried{k}").alias(n) for k, n in enumerate(names)])


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams that fill an eighth of a task's share or more, by one in ``SAMPLED`` rows: as many as eight a task at most.

    The sample only decides which grams are spread over tasks; the result is the same whichever they are.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = numbered(docs, []).where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0).mapInArrow(find_anchors, ANCHORS)
    counts = some.where(F.shiftright("at", 7).bitwiseAND(127) != INTERVAL).groupBy("gram").agg(F.count("*").alias("n")).persist()
    least = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / (8 * tasks)
    found = counts.where(F.col("n") >= max(8.0, least)).select("gram").toArrow().column("gram").to_numpy()
    counts.unpersist()
    return found


def with_intervals(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """doc, rid, text and what is carried, with the row's covered intervals (array of at, value; null if none)."""
    docs = stable(docs)
    hot = hot_grams(docs)
    texts = numbered(docs, carried)

    @released
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return match_anchors(batches, hot)

    found = numbered(docs, []).mapInArrow(find_anchors, ANCHORS)
    spread = docs.sparkSession.createDataFrame(pa.table({"gram": pa.array(hot, pa.int64())})) if len(hot) else None
    slot = F.col("gram")
    if spread is not None:
        found = found.join(F.broadcast(spread.withColumn("spread", F.lit(True))), "gram", "left")
        slot = F.when(F.col("spread"), F.xxhash64("gram", "c1")).otherwise(F.col("gram"))
    found = found.withColumn("slot", slot).repartition("slot").select(*ANCHOR).sortWithinPartitions(*ANCHOR)
    met = found.mapInArrow(match, ROWS).repartition("rid").sortWithinPartitions("rid")
    met = met.mapInArrow(join_intervals, ROWS)  # read twice behind the exchange, which Spark does once
    wanted = met.where(F.col("kind") != COVERED).groupBy("rid").agg(F.collect_list(F.struct("at", "value", "kind")).alias("wanted"))
    schema = "gram long, doc long, rid long, at long, value long, bytes binary"
    dealt = texts.repartition("rid")
    contexts = dealt.join(wanted.hint("shuffle_hash"), "rid", "left").mapInArrow(cut_contexts, schema)
    compared = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort_contexts, ROWS)
    covered = met.where(F.col("kind") == COVERED).union(compared).groupBy("rid").agg(F.collect_list(F.struct("at", "value")).alias("covered"))
    return dealt.join(covered.hint("shuffle_hash"), "rid", "left")


def kept_spans(raw: bytes, covered: list[dict] | None) -> tuple[list[tuple[int, int]], int]:
    """The (start, end) pieces of the text to keep, and the number of maximal removed runs."""
    spans = sorted((c["at"] >> 14, c["value"]) for c in covered or ())
    kept, at, removed = [], 0, 0
    for s, e in spans:
        if s > at or not removed:
            removed += 1
        if s > at:
            kept.append((at, s))
        at = max(at, e)
    if at < len(raw):
        kept.append((at, len(raw)))
    return kept, removed


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], int]]:
    for text, covered in zip(batch.column("text"), batch.column("covered")):
        raw = (text.as_py() or "").encode()
        yield raw, *kept_spans(raw, covered.as_py())


def dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for raw, spans, removed in _pieces(batch):
                left = hashlib.sha256()
                for s, e in spans:
                    left.update(raw[s:e])
                found.append((len(raw), len(raw) - sum(e - s for s, e in spans), removed, left.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*found), types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_intervals(docs, [F.col("doc_id")]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The input's columns with what repeats cut from the text; bytes of a character that was cut in two go as well.

    A column ``n_chars``, if there is one, is the length of the new text. A text of which nothing is left is empty.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(raw[s:e] for s, e in spans).decode("utf-8", "ignore") for raw, spans, _ in _pieces(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "left"])

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    kind = docs.select(others).schema["row"].dataType.simpleString()
    left = with_intervals(docs, [others]).mapInArrow(run, f"row {kind}, left string")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("left").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("left").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return left.select(*columns)
