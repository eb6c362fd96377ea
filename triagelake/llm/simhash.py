"""SimHash near-dedup with BK-trees over shards of fingerprints.

1. Every text gets a 64-bit SimHash of its 4-word shingles. Equal fingerprints are pre-aggregated to one row, so a group
   of copies costs one row from there on.
2. Two fingerprints that differ in at most four bits agree on two at least of six bands. Every fingerprint goes to the
   15 shards named by its pairs of bands, so each link is found in some shard and no shard has to be everywhere.
3. A shard builds a BK-tree: a node's children are keyed by their Hamming distance to it, and a search within radius r
   follows only the edges from d - r to d + r. The search takes nodes out as it reaches them, so that a dense shard costs
   no pair list: it gives one edge for each fingerprint, to the smallest of its component within the shard.
4. Those edges join to components by alternating large-star and small-star rounds, each checkpointed.

A shard holds distinct fingerprints that agree on 22 of 64 bits, however many copies there are; one of more than ``DENSE``
is split by the other 42 bits in the same way. Trees live where their shard is; nothing is broadcast, as no bound on all
trees holds at every size.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; a null doc_id counts as larger than any other; repeated rows share a component; an empty table gives an empty
result. Only doc_id and text are read, so other columns can't clash. Rows are numbered as they are read: an input
that isn't a table is written as one first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, released, stable, texts_of

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of each of the six bands.
BANDS = (11, 11, 11, 11, 10, 10)
CHUNK = 1 << 16
#: A shard of more fingerprints is split again.
DENSE = 20_000


def fingerprint(text: str) -> int:
    """A bit is set if more than half the shingles' hashes have it."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n < SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    total = n - SHINGLE + 1
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > total).astype(object)).sum()) if (2 * counts > total).any() else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rid (the row's number in the table as read), fp (signed 64 bits)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(fps)], ["doc_id", "rid", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(run, f"doc_id {kind}, rid long, fp long")


class BKTree:
    """Fingerprints by Hamming distance. ``take`` removes what it finds; empty subtrees are not entered again."""

    def __init__(self, values: list[int] = ()) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.left: list[int] = []  # not yet taken, in the subtree
        self.taken: list[bool] = []
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        self.parent.append(-1)
        self.left.append(1)
        self.taken.append(False)
        while new:
            self.left[at] += 1
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                self.parent[new] = at
                break
            at = below

    def remove(self, k: int) -> None:
        self.taken[k] = True
        while k >= 0:
            self.left[k] -= 1
            k = self.parent[k]

    def find(self, value: int, radius: int) -> list[int]:
        """The places of all values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            k = stack.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            stack += [below for edge, below in self.children[k].items() if d - radius <= edge <= d + radius]
        return found

    def take(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0]
        while stack:
            k = stack.pop()
            if not self.left[k]:
                continue
            d = (self.values[k] ^ value).bit_count()
            if d <= radius and not self.taken[k]:
                found.append(k)
            for edge, below in self.children[k].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)
        for k in found:
            self.remove(k)
        return found


def linked(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its component among the shard's distinct values) for all but the smallest."""
    if len(values) == 2:
        a, b = sorted(values)
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    tree, edges = BKTree(values), []
    for k in range(len(values)):
        if tree.taken[k]:
            continue
        tree.remove(k)
        group, at = [k], 0
        while at < len(group) and tree.left[0]:
            group += tree.take(values[group[at]], radius)
            at += 1
        if len(group) > 1:
            least = min(values[x] for x in group)
            edges += [(values[x], least) for x in group if values[x] != least]
    return edges


def shard_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and part to edges; one part of a shard at a time is held."""
    shard, members = None, []

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, parts = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        bounds = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1, [len(keys)]))
        edges: list[tuple[int, int]] = []
        several = np.diff(bounds) > 1
        several[[0, -1]] = True  # these may go on in another batch
        for k in np.flatnonzero(several).tolist():
            lo, hi = bounds[k], bounds[k + 1]
            if (keys[lo], parts[lo]) != shard:
                if len(members) > 1:
                    edges += linked(members, radius)
                shard, members = (keys[lo], parts[lo]), []
            members += fps[lo:hi].tolist()
        if edges:
            yield out(edges)
    if len(members) > 1 and (edges := linked(members, radius)):
        yield out(edges)


def _parts(value: Column, low: int, widths: tuple[int, ...]) -> list[Column]:
    """Consecutive bit fields from ``low`` on."""
    out = []
    for bits in widths:
        out.append(F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1)))
        low += bits
    return out


def _pairs(parts: list[Column], bits: int) -> list[Column]:
    """A key for each two parts: which two, and their bits."""
    found = []
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            found.append(F.lit(len(found) << 2 * bits) + parts[i] * F.lit(1 << bits) + parts[j])
    return found


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b), b smaller as unsigned: as many as join what links.

    A shard of more than ``dense`` fingerprints is split the same way again: what is left of two linked ones beside the two
    bands that they share differs in ``radius`` bits at most too, so of six parts of those bits two agree.
    """
    bands = _parts(F.col("fp"), 0, BANDS)
    dealt = fps.select("fp", F.explode(F.array(*_pairs(bands, 11))).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("shard")
    crowded = cut(sizes, 0)  # few
    if crowded.isEmpty():
        parts = dealt.select("fp", "shard", F.lit(0).cast("long").alias("part"))
    else:
        rest = F.lit(0).cast("long")  # the bits of the other four bands, side by side
        position = F.shiftrightunsigned("shard", 22)
        first = [i for i in range(6) for j in range(i + 1, 6)]
        second = [j for i in range(6) for j in range(i + 1, 6)]
        i, j = (F.element_at(F.array(*map(F.lit, x)), (position + 1).cast("int")) for x in (first, second))
        for k, (band, bits) in enumerate(zip(bands, BANDS)):
            rest = F.when((i == k) | (j == k), rest).otherwise(F.shiftleft(rest, bits).bitwiseOR(band))
        within = F.explode(F.array(*_pairs(_parts(F.col("rest"), 0, (8, 7, 7, 7, 7, 8)), 8)))
        split = dealt.join(crowded, "shard", "left_semi").withColumn("rest", rest).select("fp", "shard", within.alias("part"))
        parts = dealt.join(crowded, "shard", "left_anti").select("fp", "shard", F.lit(-1).cast("long").alias("part")).union(split)
    parts = parts.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return parts.mapInArrow(lambda batches: shard_edges(batches, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but roots; the root is the least node of its component.

    A hub's edges may be a third of all. Its least neighbour is pre-aggregated and written, so that the join of edges with
    it is between two plain exchanges, whose large partitions Spark splits. A round's tables go when the next is written.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state, rows = None, edges.count()  # rounds give no more edges than there are
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), rows)
        drop(edges, least)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), 2 * rows)
        drop(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def joined(fps: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (doc_id, rid, fp) with their components; ``find`` gives the edges between classes (fp)."""
    classes = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid")).alias("first")))
    roots = components(find(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts_ = rooted.groupBy("root").agg(F.min("first").alias("first"))
    rooted = cut(firsts_.join(rooted.select("root", F.col("fp").alias("key")), "root").select("key", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("first_rid")))
    drop(classes)
    return fps.join(rooted, fps["fp"] == rooted["key"]).select("doc_id", "rid", "fp", "component_id", "first_rid")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, rid, fp, component_id, first_rid: the first row of the component has that doc_id and number."""
    return joined(cut(fingerprints(docs)), lambda classes: links(classes.select("fp"), radius))


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, its first, in the input's columns; of repeated rows one."""
    docs = stable(docs)
    return firsts(docs, grouped(docs, radius))


def firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; texts move once, by the numbers of their rows."""
    kept = groups.where(F.col("rid") == F.col("first_rid")).select(F.col("rid").alias("kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    return rows.join(kept, F.col("rid") == F.col("kept"), "left_semi").select("row.*")
