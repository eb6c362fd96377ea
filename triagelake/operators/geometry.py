"""Pages as geometry: columns, reading order, offsets, tables and images, from tables of blocks and spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import clean_cell, header_key

#: Shares of the page width and distances in points that decide about columns and grids.
WIDE, CENTRED, SEPARATION, ROW_GAP, GRID_SHARE, MOST_COLUMNS = 0.65, 0.04, 0.12, 6.0, 0.6, 3
#: Rows of blocks that a task takes up at once.
ROWS = 20_000


def centres(values: np.ndarray, k: int, rounds: int = 40) -> np.ndarray | None:
    """One-dimensional k-means from quantiles; None if a cluster runs empty."""
    values = np.sort(values)
    if len(values) < k:
        return None
    at = values[((np.arange(k) + 0.5) * len(values) / k).astype(int)].astype(float)
    for _ in range(rounds):
        mine = np.abs(values[:, None] - at[None, :]).argmin(axis=1)
        sizes = np.bincount(mine, minlength=k)
        if not sizes.all():
            return None
        moved = np.bincount(mine, values, k) / sizes
        still = np.abs(moved - at).max() < 0.5
        at = moved
        if still:
            break
    return at


def columns(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, width: float) -> tuple[int, np.ndarray]:
    """(number of columns, column of each block). Left edges cluster; banners and centred lines belong to column 0.

    Blocks to the right that mostly stand level with blocks to the left are a grid, which is read across: one column.
    """
    none = np.zeros(len(x0), int)
    apart = ((x1 - x0) >= width * WIDE) | (np.abs((x0 + x1) / 2 - width / 2) < width * CENTRED)
    edges = x0[~apart]
    if len(x0) < 4 or len(edges) < 4:
        return 1, none
    best = np.array([edges.mean()])
    for k in range(2, MOST_COLUMNS + 1):
        if len(edges) < 2 * k:
            break
        found = centres(edges, k)
        if found is None:
            continue
        found = np.sort(found)
        if np.diff(found).min() < width * SEPARATION:
            break
        best = found
    mine = np.abs(x0[:, None] - best[None, :]).argmin(axis=1)
    mine[apart] = 0
    right, left = y0[~apart & (mine > 0)], y0[~apart & (mine == 0)]
    if len(best) > 1 and len(right) >= 3 and len(left):
        level = (np.abs(right[:, None] - left[None, :]) < ROW_GAP).any(axis=1)
        if level.mean() > GRID_SHARE:
            return 1, none
    return len(best), mine


def by_page(blocks: DataFrame, schema: str, page_of: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None]) -> DataFrame:
    """Maps each page's blocks as arrays to arrays of the schema; pages stream in sorted order, one is held at a time."""
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < ROWS:
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held)
            data = {c: table.column(c).to_numpy() for c in names}
            pages = data["page_id"]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(pages)) + 1, [len(pages)]))
            whole = len(edges) - 1 if batch is None else len(edges) - 2
            found = [page_of({c: v[edges[k] : edges[k + 1]] for c, v in data.items()}) for k in range(whole)]
            found = [f for f in found if f is not None]
            if found:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([f[c] for f in found]) for c in found[0]})
            held = table.slice(edges[whole]).combine_chunks().to_batches() if batch is not None else []

    return blocks.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(run, schema)


def page_columns(blocks: DataFrame) -> DataFrame:
    """Blocks (page_id, block, x0, x1, y0, width) with column and column_count."""

    def page_of(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        count, mine = columns(page["x0"], page["x1"], page["y0"], float(page["width"][0]))
        return {"page_id": page["page_id"], "block": page["block"], "column": mine.astype(np.int32), "column_count": np.full(len(mine), count, np.int32)}

    return by_page(blocks.select("page_id", "block", "x0", "x1", "y0", "width"), "page_id long, block int, column int, column_count int", page_of)


def reading_order(blocks: DataFrame, column: bool = True) -> DataFrame:
    """Blocks with their place: by column, then line, then left edge; or without columns, the naive order."""
    keys = ([F.col("column")] if column else []) + [F.bround("y0", 1), F.col("x0"), F.col("block")]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*keys)))


def char_offsets(spans: DataFrame) -> DataFrame:
    """Spans (page_id, block, line, span, text) with char_start and char_end: a line feed after each line and each block."""
    order = Window.partitionBy("page_id").orderBy("block", "line", "span")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    next_line = (F.lead("line").over(order) != F.col("line")) | (F.lead("block").over(order) != F.col("block"))
    next_block = F.lead("block").over(order) != F.col("block")
    gap = F.coalesce(next_line.cast("int"), F.lit(0)) + F.coalesce(next_block.cast("int"), F.lit(0))
    sized = spans.withColumn("step", F.length("text") + gap)
    start = F.coalesce(F.sum("step").over(before), F.lit(0)).cast("int")
    return sized.withColumn("char_start", start).withColumn("char_end", start + F.length("text")).drop("step")


def union_box(spans: Column, start: Column, end: Column) -> Column:
    """The box around the spans (array of s, e, b) that overlap a character range; null if none does."""
    hit = F.filter(spans, lambda x: (x["s"] < end) & (x["e"] > start))
    side = lambda k, f: f(F.transform(hit, lambda x: x["b"][k]))
    return F.when(F.size(hit) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def line_boxes(spans: Column, start: Column, end: Column) -> Column:
    """A box for each line of a character range: spans of a column join the line whose first span is level with them."""
    hit = F.array_sort(F.transform(F.filter(spans, lambda x: (x["s"] < end) & (x["e"] > start)), lambda x: F.struct(x["col"].alias("col"), x["b"][1].alias("y"), x["b"][0].alias("x"), x["b"].alias("b"), x["font"].alias("font"))))
    rows = F.slice(F.transform(hit, lambda x: F.struct(x["col"].alias("col"), x["y"].alias("y"), x["b"].alias("b"))), 1, 0)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (last["col"] == x["col"]) & (F.abs(last["y"] - x["y"]) < F.greatest(F.lit(2.0), x["font"] * 0.6))
        joined = F.struct(
            last["col"].alias("col"),
            last["y"].alias("y"),
            F.array(F.least(last["b"][0], x["b"][0]), F.least(last["b"][1], x["b"][1]), F.greatest(last["b"][2], x["b"][2]), F.greatest(last["b"][3], x["b"][3])).alias("b"),
        )
        new = F.struct(x["col"].alias("col"), x["y"].alias("y"), x["b"].alias("b"))
        return F.when(same, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined)).otherwise(F.array_append(done, new))

    folded = F.when(F.size(hit) > 0, F.aggregate(hit, rows, lambda d, x: F.when(F.size(d) == 0, F.array(F.struct(x["col"].alias("col"), x["y"].alias("y"), x["b"].alias("b")))).otherwise(step(d, x))))
    return F.transform(folded, lambda r: r["b"])


def visual_rows(x0: np.ndarray, y0: np.ndarray) -> list[list[int]]:
    """Blocks by visual line: each joins the first line whose first block is less than six points away."""
    rows: list[list[int]] = []
    for k in np.lexsort((x0, np.round(y0))).tolist():
        for row in rows:
            if abs(y0[row[0]] - y0[k]) < ROW_GAP:
                row.append(k)
                break
        else:
            rows.append([k])
    return rows


def tabular_region(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple | None:
    """(x0, y0, x1, y1, rows, columns) of blocks that line up as a table: three lines that share two left edges."""
    if len(x0) < 6:
        return None
    rows = [r for r in visual_rows(x0, y0) if len(r) >= 2]
    edges = [set((np.round(x0[r] / 5) * 5).tolist()) for r in rows]
    if len(rows) < 3 or sum(len(e & edges[0]) >= 2 for e in edges) < 3:
        return None
    used = [k for r in rows for k in r]
    return float(x0[used].min()), float(y0[used].min()), float(x1[used].max()), float(y1[used].max()), len(rows), max(map(len, rows))


def tabular_regions(blocks: DataFrame) -> DataFrame:
    """Pages (page_id, x0, y0, x1, y1 of blocks) with a region that looks like a table."""
    names = ("x0", "y0", "x1", "y1")

    def page_of(page: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        found = tabular_region(*(page[c] for c in names))
        if found is None:
            return None
        sizes = {"rows": np.array(found[4:5], np.int32), "columns": np.array(found[5:], np.int32)}
        return {"page_id": page["page_id"][:1], **{c: np.array([v]) for c, v in zip(names, found)}, **sizes}

    return by_page(blocks.select("page_id", *names), "page_id long, x0 double, y0 double, x1 double, y1 double, rows int, columns int", page_of)


def clean_tables(tables: DataFrame) -> DataFrame:
    """Tables (headers, rows) cleaned: cells trimmed, empty rows gone, the header taken from the first row if there is none,
    a row that repeats the header gone; a table of a header alone goes."""
    rows = F.filter(F.transform("rows", lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    own = F.transform("headers", clean_cell)
    out = tables.withColumn("rows", rows).withColumn("own", own)
    out = out.withColumn("headers", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("rows")[0]))
    drop = (F.size("rows") > 0) & ((F.size("own") <= 0) | (F.col("rows")[0] == F.col("own")))
    return out.withColumn("rows", F.when(drop, F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))).where(F.size("rows") > 0).drop("own")


def merge_continued(tables: DataFrame) -> DataFrame:
    """Tables (document_id, page_no, table_index, headers, rows): one that opens the next page with the same header goes on
    the one before. A joined table keeps its first page, so only the page right after that joins."""
    keyed = tables.withColumn("key", header_key(F.col("headers")))
    first = F.min("table_index").over(Window.partitionBy("document_id", "page_no")) == F.col("table_index")
    keyed = keyed.withColumn("opens", first)
    entry = F.struct("page_no", "table_index", "headers", "key", "opens", "rows", F.lit(1).alias("parts"))
    grouped = keyed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "table_index", entry.alias("t")))).alias("all"))
    items = F.transform("all", lambda a: a["t"])

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & t["opens"] & (t["page_no"] == last["page_no"] + 1) & (t["key"] == last["key"])
        grown = F.struct(last["page_no"], last["table_index"], last["headers"], last["key"], last["opens"], F.concat(last["rows"], t["rows"]).alias("rows"), (last["parts"] + 1).alias("parts"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), grown)).otherwise(F.array_append(done, t))

    grouped = grouped.withColumn("items", items)
    start = F.slice("items", 1, 1)
    merged = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start, step)
    return grouped.select("document_id", F.explode(merged).alias("t")).select("document_id", "t.page_no", "t.table_index", "t.headers", "t.rows", "t.parts")


def image_verdicts(images: DataFrame) -> DataFrame:
    """Images (document_id, page_no, xref, width, height, page_area, stddev) with pages, area_ratio, keep and reject_reason."""
    pages = F.size(F.collect_set("page_no").over(Window.partitionBy("document_id", "xref")))
    ratio = F.coalesce(F.try_divide(F.col("width") * F.col("height"), F.col("page_area")), F.lit(0.0))
    reason = (
        F.when(F.col("area_ratio") >= SETTINGS.image_full_page_ratio, "FULL_PAGE_SCAN")
        .when(F.col("area_ratio") < SETTINGS.image_min_area_ratio, "too small")
        .when(F.col("pages") > 1, F.concat(F.lit("repeated on "), F.col("pages").cast("string"), F.lit(" pages")))
        .when(F.col("stddev") < SETTINGS.image_min_stddev, "flat colour")
    )
    out = images.withColumn("pages", pages).withColumn("area_ratio", F.round(ratio, 6)).withColumn("reject_reason", reason)
    return out.withColumn("keep", F.col("reject_reason").isNull())


def page_image_stats(images: DataFrame) -> DataFrame:
    """Per page: the share of its largest image, and how many it has."""
    return images.groupBy("document_id", "page_no").agg(F.round(F.max(F.col("width") * F.col("height") / F.col("page_area")), 6).alias("largest_ratio"), F.count("*").alias("images"))


def colour_spread(images: DataFrame, samples: str) -> DataFrame:
    """Adds spread: the population deviation of up to 4096 samples taken at even steps; 0 below two samples.

    Sums and squares are folded in one pass over the taken samples, which are a column of their own.
    """
    step = F.greatest(F.lit(1), F.floor(F.size(samples) / 4096).cast("int"))
    out = images.withColumn("_step", step)
    out = out.withColumn("_taken", F.filter(samples, lambda _, i: i % F.col("_step") == 0))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    folded = F.aggregate("_taken", start, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v.cast("long") * v).alias("q")))
    out = out.withColumn("_sums", folded).withColumn("_n", F.size("_taken"))
    mean = F.col("_sums.s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_sums.q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return out.withColumn("spread", F.when(F.col("_n") < 2, 0.0).otherwise(spread)).drop("_step", "_taken", "_sums", "_n")
