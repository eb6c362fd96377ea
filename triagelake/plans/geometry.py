"""Geometry queries over pages synthesised from line items: an order is a page, its lines are blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources.tables import table
from .registry import query

BLOCKS = """SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS block,
 CAST(CASE WHEN l_partkey % 2 = 0 THEN 51 ELSE 308 END + l_suppkey % 3 AS DOUBLE) AS x0, CAST(l_linenumber * 60 + l_suppkey % 4 AS DOUBLE) AS y0, CAST(l_quantity AS INT) AS size FROM {lineitem}"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(BLOCKS, lineitem=table(spark, sf_dir, "lineitem"))
    return found.withColumns({"x1": F.col("x0") + 200, "y1": F.col("y0") + 40, "width": F.lit(595.0), "column": F.when(F.col("x0") < 200, 0).otherwise(1)})


BLOCKS_SQL = "WITH b AS (" + BLOCKS.format(lineitem="lineitem") + ") "


@query(
    "O07 X58",
    BLOCKS_SQL
    + """SELECT page_id, block, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN x0 < 200 THEN 0 ELSE 1 END, round(y0, 1), x0, block)::INT AS place, row_number() OVER (PARTITION BY page_id ORDER BY round(y0, 1), x0, block)::INT AS naive FROM b""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = G.reading_order(blocks(spark, sf_dir))
    return G.reading_order(ordered.withColumnRenamed("place", "by_column"), column=False).select("page_id", "block", F.col("by_column").alias("place"), F.col("place").alias("naive"))


@query(
    "W03",
    BLOCKS_SQL
    + """, t AS (SELECT page_id, block, i % 2 AS line, i // 2 AS span, repeat('x', size % 7 + i) AS text FROM b, (VALUES (0), (1), (2), (3)) AS v(i)),
g AS (SELECT *, length(text) + coalesce((lead(line) OVER w <> line OR lead(block) OVER w <> block)::INT, 0) + coalesce((lead(block) OVER w <> block)::INT, 0) AS step FROM t WINDOW w AS (PARTITION BY page_id ORDER BY block, line, span))
SELECT page_id, block, line::INT AS line, span::INT AS span, (sum(step) OVER (PARTITION BY page_id ORDER BY block, line, span ROWS UNBOUNDED PRECEDING) - step)::INT AS char_start,
 (sum(step) OVER (PARTITION BY page_id ORDER BY block, line, span ROWS UNBOUNDED PRECEDING) - step + length(text))::INT AS char_end FROM g""",
)
def span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.explode(F.array(*map(F.lit, range(4))))
    spans = blocks(spark, sf_dir).select("page_id", "block", "size", i.alias("i"))
    spans = spans.select("page_id", "block", (F.col("i") % 2).alias("line"), F.floor(F.col("i") / 2).cast("int").alias("span"), F.expr("repeat('x', size % 7 + i)").alias("text"))
    return G.char_offsets(spans).drop("text")


@query("X45 X46")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column of each block by one-dimensional clustering; the tests hold it against worked pages."""
    return G.page_columns(blocks(spark, sf_dir))


@query("X47 W07")
def tabular_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are merged by ten, so that lines of blocks line up."""
    pages = blocks(spark, sf_dir).withColumn("page_id", F.floor(F.col("page_id") / 10))
    return G.tabular_regions(pages.select("page_id", "x0", "y0", "x1", "y1"))


IMAGES = """SELECT l_orderkey AS document_id, CAST(l_linenumber AS INT) AS page_no, l_partkey % 40 AS xref, l_quantity * 12 AS width, l_quantity * 17 AS height, 595.0 * 842.0 AS page_area, l_discount * 300 AS stddev, l_suppkey AS tie FROM {lineitem}"""
IMAGES_SQL = "WITH i AS (" + IMAGES.format(lineitem="lineitem").replace("595.0 * 842.0", "595.0::DOUBLE * 842.0::DOUBLE") + ")"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMAGES, lineitem=table(spark, sf_dir, "lineitem")).withColumn("page_area", F.col("page_area").cast("double"))


@query(
    "A36 X43",
    IMAGES_SQL
    + """, p AS (SELECT document_id, xref, count(DISTINCT page_no) AS pages FROM i GROUP BY 1, 2), r AS (SELECT i.*, pages, round(width * height / page_area, 6) AS area_ratio FROM i JOIN p USING (document_id, xref)),
v AS (SELECT *, CASE WHEN area_ratio >= 0.80 THEN 'FULL_PAGE_SCAN' WHEN area_ratio < 0.03 THEN 'too small' WHEN pages > 1 THEN 'repeated on ' || pages || ' pages' WHEN stddev < 12 THEN 'flat colour' END AS reject_reason FROM r)
SELECT document_id, page_no, xref, area_ratio, pages::INT AS pages, reject_reason, reject_reason IS NULL AS keep FROM v""",
)
def image_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.image_verdicts(images(spark, sf_dir)).select("document_id", "page_no", "xref", "area_ratio", "pages", "reject_reason", "keep")


@query("X56", IMAGES_SQL + "SELECT document_id, page_no, round(max(width * height / page_area), 6) AS largest_ratio, count(*) AS images FROM i GROUP BY 1, 2")
def page_image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_image_stats(images(spark, sf_dir))


@query(
    "X44",
    """WITH s AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: unicode(c) % 256) AS v FROM conversations), t AS (SELECT conv_id, turn, CASE WHEN len(v) < 8192 THEN v ELSE NULL END AS v FROM s)
SELECT conv_id, turn, CASE WHEN len(v) < 2 THEN 0.0 ELSE round(list_stddev_pop(v), 6) END AS spread FROM t""",
)
def colour_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters stand for colour samples."""
    samples = F.transform(F.split("text", ""), lambda c: F.ascii(c) % 256)
    images = table(spark, sf_dir, "conversations").select("conv_id", "turn", samples.alias("samples"))
    return G.colour_spread(images, "samples").select("conv_id", "turn", F.round("spread", 6).alias("spread"))


@query(
    "X48 J14 W08",
    BLOCKS_SQL
    + """, s AS (SELECT *, block * 10 AS s, block * 10 + 8 AS e FROM b), h AS (SELECT * FROM s WHERE s < 25 AND e > 5)
SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x0 + 200) AS x1, max(y0 + 40) AS y1 FROM h GROUP BY 1""",
)
def quote_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around characters 5 to 25 of each page."""
    span = F.struct((F.col("block") * 10).alias("s"), (F.col("block") * 10 + 8).alias("e"), F.array("x0", "y0", "x1", "y1").alias("b"), F.col("column").alias("col"), F.lit(10.0).alias("font"))
    page = blocks(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    box = G.union_box(F.col("spans"), F.lit(5), F.lit(25))
    return page.withColumn("box", box).where("box is not null").select("page_id", *[F.col("box")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("W01 R24 X30 X31")
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables cleaned, joined over page breaks and written as Markdown; the tests hold them against plain Python."""
    from ..functions import text as T

    head = F.array(F.lit(" Test "), F.when(F.col("l_suppkey") % 3 == 0, "Result").otherwise("Value"), F.lit(""))
    cells = F.array(F.array(F.lit("Test"), F.when(F.col("l_suppkey") % 3 == 0, "Result").otherwise("Value"), F.lit("")), F.array(F.col("l_returnflag"), F.col("l_quantity").cast("string"), F.lit(" x\n y ")), F.array(F.lit(" "), F.lit(""), F.lit("")))
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("table_index"), head.alias("headers"), cells.alias("rows")
    )
    merged = G.merge_continued(G.clean_tables(found.dropDuplicates(["document_id", "page_no", "table_index"])))
    return merged.select("document_id", "page_no", "table_index", "parts", F.size("rows").alias("rows"), T.markdown_table(F.col("headers"), F.col("rows")).alias("markdown"))
