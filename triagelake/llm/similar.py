"""Near-dedup by the similarity of whole texts: SimHash candidates from BK-trees, confirmed by Jaccard similarity.

A text is the set of its five-word shingles; two texts are linked if their sets' Jaccard similarity is 0.8 or more. A
fingerprint of 64 bits can't tell such pairs from others (they differ in 10 bits in the mean and often in 16), so:

1. Equal sets are one class from there on.
2. Shards are buckets of four least hashes, 32 a class, as no band of bits holds for so many differing bits. Two sets of
   similarity s share a shard but for a chance of (1 - s^4)^32: 5 in 100 million at 0.8, less above.
3. Every class is compared with the pivot of each of its shards: the member with the largest shards, which in a group of
   copies is the text that they are copies of. That joins most of a group by one edge a member.
4. Where a shard still holds several components, BK-trees over SimHashes of 2,048 bits find the pairs between them: at a
   similarity of 0.8 they differ in 310 bits in the mean with a deviation of 16, at 0.7 in 395, unrelated ones in 1,024,
   and the radius is four deviations above the first mean. Shingles that no other class there has can't be common, which
   bounds the similarity of a pair from above and leaves out most of what the radius lets in. Members of the pivot's component and the others are dealt to blocks, two blocks meet in a
   task, and two blocks of the pivot's component never do, so no group has to be in one place.
5. Every candidate pair is confirmed by its whole sets; confirmed links join to components as in ``simhash``.

A blank text is the empty set; fewer words than a shingle make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, released, stable, texts_of

SHINGLE, BANDS, LEAST = 5, 32, 4
#: Least similarity, as a fraction of whole numbers so that comparing is exact.
SIMILAR = (4, 5)
#: Bits of a fingerprint, and the most in which two candidates differ.
BITS, RADIUS = 2048, 375
BLOCK = 512
#: Shingles that are hashed at once.
CHUNK = 4096
_MIX = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * LEAST, 1), np.uint64)
FLIP, TIMES = _MIX[0], _MIX[1] * np.uint64(2) + np.uint64(1)
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """A key a band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * LEAST, ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[None, at : at + CHUNK] ^ FLIP) * TIMES).min(axis=1))
    bands = least.reshape(BANDS, LEAST)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A SimHash of ``BITS`` bits: a bit is set if more than half the shingles have it. Bits are counted by values of bytes."""
    counts = np.zeros((BITS // 8, 256), np.int64)
    for at in range(0, len(hashes), CHUNK):
        x = (hashes[at : at + CHUNK, None] ^ FLIP[: BITS // 64, 0]) * TIMES[: BITS // 64, 0]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        values = x.view(np.uint8).reshape(len(x), -1) + 256 * np.arange(BITS // 8)
        counts += np.bincount(values.ravel(), minlength=counts.size).reshape(counts.shape)
    return np.packbits(2 * (counts @ _BITS_OF) > len(hashes)).tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid, fp (the same for equal sets), keys."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts_of(batch)]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([keys_of(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(fps), keys], ["doc_id", "rid", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(run, f"doc_id {kind}, rid long, fp long, keys array<long>")


def members(fps: DataFrame) -> DataFrame:
    """fp, key, n (members) for the shards that bring classes together; of shards with the same members one is kept."""
    each = fps.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", F.explode("keys").alias("key"))
    alike = F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor(F.xxhash64("fp")).alias("all")
    shards = each.groupBy("key").agg(*alike).where("n > 1")
    once = shards.groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key"))
    return each.join(once.select("n", "key"), "key").select("fp", "key", "n")


def sized(docs: DataFrame, fps: DataFrame, chosen: DataFrame) -> DataFrame:
    """fp, wide (fingerprint), hashes (the set) of the chosen classes, read again from one text each."""
    first = fps.groupBy("fp").agg(F.min("rid").alias("at")).join(chosen, "fp")
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "text").join(first, F.col("rid") == F.col("at")).select("fp", "text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts_of(batch)]
            columns = pa.array([wide_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *columns], ["fp", "wide", "hashes"])

    return texts.mapInArrow(run, "fp long, wide binary, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar. Plain joins, so that Spark splits a pivot with many pairs."""
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("one")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("other")), "b")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, other in zip(batch.column("one"), batch.column("other")):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (one, other))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                enough = SIMILAR[1] * len(small) >= SIMILAR[0] * len(large)
                shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if enough else 0
                good.append(SIMILAR[1] * shared >= SIMILAR[0] * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, side, key, fp, root, wide, size, shared, keys) sorted by part and side to candidate pairs.

    A part is two blocks of a shard that meet, or one with itself; the first side's tree is searched with the other's
    members. Of what lies within the radius those are left that are of different components, whose shared shingles are
    enough for the similarity, and that meet here first: a pair counts in the least of the shards that it shares.
    """
    part, tree, first, out = None, simhash.BKTree(), [], []

    def passed() -> pa.RecordBatch:
        both = np.array(out, np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "side", "key", "fp", "root", "wide", "size", "shared", "keys"))
        for here, side, key, fp, root, wide, size, shared, keys in zip(*columns):
            if here != part:
                part, tree, first = here, simhash.BKTree(), []
            value = int.from_bytes(wide, "big")
            if side:  # 1: of the other block; -1: of the only block, against those before it
                for k in tree.find(value, radius):
                    other, its_root, its_size, its_shared, its_keys = first[k]
                    most = min(shared, its_shared)
                    if its_root != root and SIMILAR[1] * most >= SIMILAR[0] * (size + its_size - most) and min(set(keys) & set(its_keys)) == key:
                        out.append((fp, other))
            if side <= 0:
                first.append((fp, root, size, shared, keys))
                tree.add(value)
        if len(out) > 50_000:
            yield passed()
    if out:
        yield passed()


def shared_shingles(sets: DataFrame) -> DataFrame:
    """fp, wide, size and shared (shingles that another class has too) of the classes that share enough to be linked."""

    @released
    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, raw in zip(batch.column("fp").to_pylist(), batch.column("hashes")):
                hashes = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), fp)), pa.array(hashes)], ["fp", "h"])

    sets = cut(sets)
    each = sets.select("fp", "hashes").mapInArrow(spelt, "fp long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("fp").alias("owner"))
    alone = each.where("n = 1").groupBy("owner").agg(F.count("*").alias("alone"))
    size = F.floor(F.octet_length("hashes") / 8)
    both = sets.select("fp", "wide", size.alias("size")).join(alone, F.col("fp") == F.col("owner"), "left")
    both = both.select("fp", "wide", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    return both.where(SIMILAR[1] * F.col("shared") >= SIMILAR[0] * F.col("size"))


def links(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b) of linked classes: as many as join what links."""
    found = cut(members(fps))
    sets = cut(sized(docs, fps, found.select("fp").distinct()))
    central = found.groupBy("fp").agg(F.sum("n").alias("weight"))
    weighed = found.join(central, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp")).alias("top")).select("key", F.col("top.fp").alias("pivot"))
    pivots = cut(weighed, found.count())
    to_pivot = found.join(pivots, "key").where("fp != pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    near = cut(confirmed(to_pivot, sets))
    roots = simhash.components(near)
    rooted = found.join(roots, found["fp"] == roots["node"], "left").select("fp", "key", F.coalesce("root", "fp").alias("root"))
    leader = pivots.join(roots, pivots["pivot"] == roots["node"], "left").select("key", "pivot", F.coalesce("root", "pivot").alias("main"))
    mixed = rooted.join(leader, "key").where("fp != pivot").withColumn("stray", (F.col("root") != F.col("main")).cast("int"))
    mixed = mixed.select("fp", "key", "root", "stray")
    counts = mixed.groupBy("key").agg(F.sum("stray").alias("strays"), F.count("*").alias("n")).where("strays > 0 and n > 1")
    strays, others = F.ceil(F.col("strays") / BLOCK), F.ceil((F.col("n") - F.col("strays")) / BLOCK)
    listed = mixed.join(counts, "key").groupBy("fp").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # ``BANDS`` at most
    facts = shared_shingles(sets.join(listed.select("fp"), "fp", "left_semi")).join(listed, "fp")
    live = mixed.join(counts, "key").withColumn("ahead", strays).withColumn("blocks", strays + others)
    own = F.when(F.col("stray") == 1, F.pmod(F.xxhash64("fp"), F.col("ahead"))).otherwise(F.col("ahead") + F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.col("blocks") - F.col("ahead"))))
    met = live.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("stray") == 1, F.col("blocks")).otherwise(F.col("ahead")) - 1)))
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    part = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    dealt = met.select("fp", "key", "root", part.alias("part"), side.alias("side")).join(facts, "fp")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "side")
    pairs = dealt.mapInArrow(released(lambda batches: near_pairs(batches, RADIUS)), "a long, b long")
    return near.union(confirmed(pairs, sets))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, its first, in the input's columns; of repeated rows one."""
    docs = stable(docs)
    fps = cut(keyed(docs))
    return simhash.firsts(docs, simhash.joined(fps.select("doc_id", "rid", "fp"), lambda classes: links(docs, fps)))
