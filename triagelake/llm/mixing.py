"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Every source has a total of words to give (its target, the integral of its weight schedule over the training run) and
a schedule that spreads that total over training time. A document's place in its source, counted in words, is turned
into a training position by inverting the source's cumulative demand; sorting by position in ranges gives the mix.

No task holds a source, a list of all sources, or all rows of one document:

- Sources are ranked by ranges: a row's rank is its place in its range and the sizes of the ranges before it. The level
  to which targets are filled is found by sharing the excess again until no source is above its cap, a sum a time.
- Rows that agree in id, text and source are one group with a count, whose members take consecutive places.
- Prefix sums over a source are taken in two steps: groups fall into ``BUCKETS`` hash buckets, bucket totals are
  pre-aggregated and summed over at most that many rows, and only the groups of one bucket are put in order together.

Places go by the hash of id and text, so that reruns agree and rows with one id, or none, are dealt like others.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 and
sources without words take nothing; repeated rows are separate documents; an empty table gives an empty result. Extra
columns of the input are ignored by ``allocate`` and carried by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, stable

#: Weights by rank of the source, repeated; the share of all words that the mix takes; the most a source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Schedule by rank, repeated: a source's weight runs linearly from (1 - slope) to (1 + slope) times its mean.
SLOPES = (0.5, 0.0, -0.5)
#: Hash buckets of a source: the first four digits of a hexadecimal digest.
DIGITS = 4
BUCKETS = 16**DIGITS
#: Rows of one group that are written out together.
TOGETHER = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with the rank of each source by code point, null last."""
    dealt = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(F.broadcast(parts), "part").select("source", "source_size", (F.col("before") + F.row_number().over(inside)).alias("rank"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target): ``share`` of all words dealt by weight, none above ``most``."""
    sources = ranked(totals).withColumn("weight", cycled(weights, F.col("rank"))).withColumn("cap", F.col("source_size") * most)
    sources = cut(sources)
    everything = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, found = 0.0, None
    while everything[0] is not None:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        capped = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(full, F.col("weight")))).first()
        open_weight = everything[1] - (capped[2] or 0)
        if found == capped[0] or not open_weight:
            break
        found, level = capped[0], (everything[0] * share - (capped[1] or 0)) / open_weight
    return sources.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def placed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, place (a hash of id and text), and more."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(key).alias("place"), *more)


def groups(sized: DataFrame, weights: tuple, share: float, most: int, slopes: tuple) -> DataFrame:
    """Rows that agree in doc_id, source, size and place: n of them, and where the first lies in its source (offset)."""
    grouped = cut(sized.groupBy("source", "doc_id", "size", "place").agg(F.count("*").alias("n")))
    grouped = grouped.withColumn("bucket", F.conv(F.substring("place", 1, DIGITS), 16, 10).cast("int"))
    words = F.sum(F.col("size") * F.col("n"))
    sums = cut(grouped.groupBy("source", "bucket").agg(words.alias("bucket_size")))
    wanted = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sums = sums.alias("b").join(wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
    sums = sums.select("b.source", "bucket", "ahead", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("within", F.coalesce(words.over(inside), F.lit(0)))
    both = within.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    offset, slope = (F.col("ahead") + F.col("within")).alias("offset"), cycled(slopes, F.col("rank")).alias("slope")
    return both.select("doc_id", "d.source", "size", "place", "n", "source_size", "target", slope, offset)


def taken_copies() -> Column:
    """How often a document is taken: ``floor(target / source_size)`` whole passes, and one more if its middle word lies
    before what is left of the target, so that the words taken miss the target by half a document at most."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    more = (F.col("size") > 0) & (2 * F.col("offset") + F.col("size") <= 2 * rest)
    return F.when(F.col("size") > 0, passes + F.when(more, 1).otherwise(0)).otherwise(0).cast("int")


def allocate(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, slopes: tuple = SLOPES) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, position (of its first copy, 0 to 1, null if none).

    In the order of training; what isn't taken comes last.
    """
    found = groups(placed(docs), weights, share, most, slopes)
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER)))).repartition("place", "part")
    first = F.col("part") * TOGETHER
    each = parts.withColumn("i", F.explode(F.sequence(first, F.least(first + TOGETHER, F.col("n")) - 1)))
    each = each.withColumn("offset", F.col("offset") + F.col("i") * F.col("size")).withColumn("copies", taken_copies())
    each = each.withColumn("position", F.when(F.col("copies") > 0, position(F.lit(0))))
    each = each.orderBy(F.col("position").asc_nulls_last(), "place", "i")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "position")


def position(copy: Column) -> Column:
    """Training time at which the source's cumulative demand reaches the middle of this copy of the document.

    With a weight of 1 + slope * (2t - 1), the demand up to t is target * (t + slope * (t * t - t)); its inverse is a root.
    """
    done = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("offset") + F.col("size") / 2) / F.col("target"))
    a = F.col("slope")
    root = (a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * done)) / (2 * a)
    return F.when(a == 0, done).otherwise(root)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, slopes: tuple = SLOPES) -> DataFrame:
    """The training stream: the input's columns, a row for each copy, range-sorted by training position.

    Rows of one group are numbered in two steps too, by the part of the table that each was read from.
    """
    docs = stable(docs)
    rows = placed(docs, F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = cut(groups(placed(docs), weights, share, most, slopes))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("place", "doc_id", "source")]
    numbers = ("n", "source_size", "target", "slope", "offset")
    joined = rows.alias("r").join(found.alias("g"), same[0] & same[1] & same[2])
    joined = joined.select("row", "rid", F.col("r.place").alias("place"), F.col("r.doc_id").alias("doc_id"), F.col("r.source").alias("source"), F.col("r.size").alias("size"), *numbers)
    single = joined.where("n = 1").withColumn("i", F.lit(0).cast("long"))
    key = ("place", "doc_id", "source", "part")
    several = joined.where("n > 1").withColumn("part", F.shiftright("rid", 33))
    earlier = Window.partitionBy(*key[:3]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = several.groupBy(*key).agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    local = several.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("rid")))
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]
    again = local.alias("l").join(counts.alias("c"), match[0] & match[1] & match[2] & match[3])
    again = again.select("row", *[F.col(f"l.{c}").alias(c) for c in ("rid", "place", "doc_id", "source", "size")], *numbers, (F.col("before") + F.col("nth") - 1).alias("i"))
    each = single.union(again).withColumn("offset", F.col("offset") + F.col("i") * F.col("size")).withColumn("copies", taken_copies()).where("copies > 0")
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("row", position(F.col("copy")).alias("at"), "place", "i", "copy")
    return copies.orderBy("at", "place", "i", "copy").select("row.*")


def mixing_query(docs: DataFrame) -> DataFrame:
    return allocate(docs)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM d GROUP BY source),
c AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap,
             CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
             - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM c WINDOW before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ASC NULLS FIRST, d.size
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS "offset",
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CASE WHEN size = 0 THEN 0
                 ELSE passes + CASE WHEN 2 * "offset" + size <= 2 * (target - CAST(passes * source_size AS DOUBLE)) THEN 1 ELSE 0 END
            END AS copies,
         least(1.0::DOUBLE, ("offset" + size / 2.0::DOUBLE) / target) AS done
  FROM p)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN done
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * done)) / (2 * slope) END END AS position
FROM k
"""
