"""Evidence over tables: which quotes occur in which pages, and what that does to confidence.

A quote that cites a source is verified against that source's pages, joined by the source's id; every quote gets a verdict.

Quotes and pages never meet in a cross join. A quote of six words or more can occur only where the four words after its
first do, so quotes and pages join by the hash of those words; only candidate pairs are compared. Shorter quotes are looked
for by one Aho-Corasick automaton in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.evidence import NOTES, Verdict, fold, verdict

KEY_WORDS, LEAST_WORDS = 4, 6
#: Bytes of short quotes that are searched for at once.
BLOCK_BYTES = 8 << 20


def normalised(df: DataFrame, key: str, text: str, name: str, folded: Callable[[str | None], str | None] = fold) -> DataFrame:
    """(key, the text as quotes are compared); ``fold`` makes a null text empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [folded(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.string())], [key, name])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {name} string")


def _keys(words: Column, first: Column | int, count: Column | int) -> Column:
    at = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.xxhash64(F.array_join(F.slice(words, k + first + 1, F.lit(KEY_WORDS)), " ")))


def exact_pairs(quotes: DataFrame, pages: DataFrame, block_bytes: int = BLOCK_BYTES, folded: Callable[[str | None], str | None] = fold, empty: bool = False) -> DataFrame:
    """(quote_id, quote) and (page_id, text) to (quote_id, page_id) where the normalised quote occurs in the page.

    One row for each row of quotes that occurs in a row of pages, also where rows share an id or have none. Quotes that
    fit one block altogether are searched for in one pass over the pages; beyond that long quotes join by key. Quotes of
    which nothing is left occur nowhere or, on ``empty``, in every text, which gives as many rows as there are texts.
    """
    every = normalised(quotes, "quote_id", "quote", "needle", folded)
    if empty and every.where("needle = ''").limit(1).count():
        blank = every.where("needle = ''").select("quote_id").crossJoin(pages.where("text is not null").select("page_id"))
        return blank.union(exact_pairs(quotes, pages, block_bytes, folded))
    q = every.where("needle != ''")
    p = normalised(pages, "page_id", "text", "hay", folded)
    if _bytes(q) <= block_bytes:
        return _automaton_pairs(q, p)
    q = q.withColumn("words", F.split("needle", " "))
    whole = p.withColumn("p_row", F.monotonically_increasing_id())
    words = whole.withColumn("words", F.split("hay", " "))
    long = q.where(F.size("words") >= LEAST_WORDS).select("quote_id", "needle", F.element_at(_keys(F.col("words"), 1, F.lit(1)), 1).alias("key"))
    keyed = words.select("p_row", F.explode(F.array_distinct(_keys(F.col("words"), 0, F.size("words") - KEY_WORDS + 1))).alias("key"))
    candidates = keyed.join(long, "key").select("quote_id", "p_row", "needle")
    found = candidates.join(whole, "p_row").where(F.contains("hay", "needle")).select("quote_id", "page_id")
    short = q.where(F.size("words") < LEAST_WORDS).select("quote_id", "needle")
    blocks = _bytes(short) // max(1, block_bytes) + 1
    for block in range(blocks):
        found = found.union(_automaton_pairs(short.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block), p))
    return found


def _bytes(quotes: DataFrame) -> int:
    return quotes.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]


def _automaton_pairs(found_quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """A block of quotes, of bounded size, against all pages."""
    quotes = [tuple(r) for r in found_quotes.select("quote_id", "needle").collect()]
    kind = found_quotes.schema["quote_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_text: dict[str, list] = {}
        for key, needle in quotes:
            by_text.setdefault(needle, []).append(key)
        found = ahocorasick.Automaton()
        for needle, keys in by_text.items():
            found.add_word(needle, keys)
        found.make_automaton()
        for batch in batches:
            keys_of, pages_of = [], []
            for page, hay in zip(batch.column("page_id").to_pylist(), batch.column("hay").to_pylist()):
                hits = {id(keys): keys for _, keys in found.iter(hay or "")} if by_text else {}
                own = [q for keys in hits.values() for q in keys]
                keys_of += own
                pages_of += [page] * len(own)
            if keys_of:
                kind_of = pa.array([q for q, _ in quotes]).type if any(q is not None for q, _ in quotes) else pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(keys_of, kind_of), pa.array(pages_of, batch.column("page_id").type)], ["quote_id", "page_id"])

    return pages.select("page_id", "hay").mapInArrow(run, f"quote_id {kind}, page_id {pages.schema['page_id'].dataType.simpleString()}")


RESULT = "method string, match_score double, char_start long, char_end long, note string"


def verify_pairs(pairs: DataFrame, rate: bool = True) -> DataFrame:
    """(quote_id, page_id, quote, text, ...) with the verdict of each pair in place of both texts; ``rate`` scores failures."""
    others = [c for c in pairs.columns if c not in ("quote", "text")]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(q.as_py(), t.as_py(), rate=rate) for q, t in zip(batch.column("quote"), batch.column("text"))]
            columns = [pa.array([v[k] for v in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], [*others, *Verdict._fields])

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in others)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a pair costs far more to compare than to move
    return pairs.select(*others, "quote", "text").repartition(tasks, "quote_id", "page_id").mapInArrow(run, f"{schema}, {RESULT}")


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """A verdict for every row of quotes (quote_id, unit_id, cited_page, quote) by the pages (unit_id, page_no, text) of its unit.

    The cited page is tried first. Quotes that it doesn't prove go to the other pages of their unit: the first that proves
    the quote is the page, and the note says so; else the best of those pages' failures is reported for the cited page.
    Steps follow each other in one chain: each joins pages to the quotes that are still open and hands on the verdicts of
    the others, so that no step runs twice. Rows are numbered, so that quotes which share an id are told apart.
    """
    at = pages.select(F.col("unit_id").alias("unit"), F.col("page_no").alias("page_id"), "text", F.lit(True).alias("there"))
    of_unit, page = F.col("unit_id").eqNullSafe(F.col("unit")), F.col("page_id")
    of_others = of_unit & ~F.col("cited_page").eqNullSafe(page) & (F.col("before.method") == "FAILED")
    key, fields = ["row", "quote_id", "unit_id", "cited_page", "said"], ["page_id", *Verdict._fields]
    none = {"page_id": F.col("cited_page"), "method": F.lit("FAILED"), "match_score": F.lit(0.0), "char_start": F.lit(None).cast("long"), "char_end": F.lit(None).cast("long"), "note": F.lit(NOTES["no pages"])}
    no_pages = F.struct(*[c.alias(k) for k, c in none.items()])

    def tried(rows: DataFrame, on: Column, rate: bool) -> DataFrame:
        """The verdict of each row on each page that it meets; ``before`` where it meets none."""
        pairs = rows.join(at, on, "left").withColumn("quote", F.when(F.col("there"), F.col("said"))).drop("unit")
        now = F.when(F.col("there"), F.struct(*fields)).otherwise(F.col("before"))
        return verify_pairs(pairs, rate).select(*key, now.alias("before"))

    rows = quotes.select(F.monotonically_increasing_id().alias("row"), "quote_id", "unit_id", "cited_page", F.col("quote").alias("said"), no_pages.alias("before"))
    cited = tried(rows, of_unit & (F.col("cited_page") == page), False)
    cited = cited.withColumn("before", F.when(F.col("before.method") == "FAILED", no_pages).otherwise(F.col("before")))
    elsewhere = _best(tried(cited, of_others, False).select(*key, "before.*"), "row").select(*key, F.struct(*fields).alias("before"))
    rated = _best(tried(elsewhere, of_others, True).select(*key, "before.*"), "row")
    return _noted(rated).select("quote_id", "cited_page", *fields)


def best_page(results: DataFrame) -> DataFrame:
    """One verdict a quote: the cited page if it proves it, else the first page that does, else the best failure, as of the cited page."""
    return _noted(_best(results, "quote_id"))


def _best(results: DataFrame, key: str) -> DataFrame:
    won, here = F.col("method") != "FAILED", F.coalesce(F.col("page_id") == F.col("cited_page"), F.lit(False))
    rank = F.struct((~won).alias("failed"), (won & ~here).alias("elsewhere"), F.when(won, F.lit(0.0)).otherwise(-F.col("match_score")).alias("worse"), F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("page"))
    first = results.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), F.struct(*[c for c in results.columns if c != key]).alias("row_"))).alias("best"))
    return first.select(key, "best.row_.*")


def _noted(first: DataFrame) -> DataFrame:
    won, here = F.col("method") != "FAILED", F.col("page_id").eqNullSafe(F.col("cited_page"))
    moved = F.format_string(NOTES["elsewhere"], F.col("page_id"), F.col("cited_page"))
    elsewhere = won & F.col("cited_page").isNotNull() & F.col("page_id").isNotNull() & ~here
    note = F.when(elsewhere, F.concat_ws("; ", moved, F.nullif("note", F.lit("")))).otherwise(F.col("note"))
    return first.withColumn("note", note).withColumn("page_id", F.when(won, F.col("page_id")).otherwise(F.col("cited_page")))


def capped(confidence: Column, verified: Column, legibility: Column, conflict: Column) -> tuple[Column, Column]:
    """The deterministic chain of caps: (confidence to 4 digits, the reasons in order)."""
    low, split = F.lit(SETTINGS.unverified_confidence_cap), F.lit(SETTINGS.conflict_confidence_cap)
    start = F.least(F.greatest(confidence, F.lit(0)), F.lit(1)).cast("decimal(9,4)")
    one = F.when(~verified & (start > low), low.cast("decimal(9,4)")).otherwise(start)
    two = F.when(legibility < one, legibility.cast("decimal(9,4)")).otherwise(one)
    three = F.when(conflict & (two > split), split.cast("decimal(9,4)")).otherwise(two)
    reasons = F.concat_ws(
        "; ",
        F.when(~verified & (start > low), F.lit(f"evidence could not be verified, capped at {SETTINGS.unverified_confidence_cap}")),
        F.when(legibility < one, F.concat(F.lit("source page legibility "), legibility.cast("decimal(4,2)").cast("string"))),
        F.when(conflict & (two > split), F.lit(f"sources disagree, capped at {SETTINGS.conflict_confidence_cap}")),
    )
    return three, reasons
