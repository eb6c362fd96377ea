"""Pages as geometry, on worked examples."""

import numpy as np
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import geometry as G


def test_two_columns_and_a_title():
    x0 = np.array([51, 51, 51, 308, 308, 308, 60.0])
    x1 = np.array([288, 107, 288, 545, 400, 545, 540.0])
    y0 = np.array([100, 200, 310, 118, 227, 345, 40.0])
    count, mine = G.columns(x0, x1, y0, 595.0)
    assert count == 2 and mine.tolist() == [0, 0, 0, 1, 1, 1, 0]


def test_a_grid_is_read_across():
    y0 = np.array([100, 130, 160, 190, 100, 130, 160, 190.0])
    x0 = np.array([51] * 4 + [308] * 4, float)
    assert G.columns(x0, x0 + 100, y0, 595.0)[0] == 1
    assert G.columns(x0[:3], x0[:3] + 100, y0[:3], 595.0)[0] == 1


def test_close_edges_are_one_column():
    x0 = np.array([50, 52, 55, 60, 90, 95, 99, 100.0])
    assert G.columns(x0, x0 + 150, np.arange(8) * 50.0, 595.0)[0] == 1


def test_columns_by_page(spark):
    rows = [(p, k, 51.0 if k < 3 else 308.0, 250.0 if k < 3 else 500.0, k * 37.0, 595.0) for p in (1, 2) for k in range(6)]
    got = G.page_columns(spark.createDataFrame(rows, "page_id long, block int, x0 double, x1 double, y0 double, width double")).collect()
    assert {(r.block, r.column, r.column_count) for r in got} == {(k, int(k >= 3), 2) for k in range(6)}


def test_tabular_region():
    x, y = np.meshgrid([50.0, 200.0, 350.0], [100.0, 120.0, 140.0, 160.0])
    x, y = x.ravel(), y.ravel() + np.tile([0, 1, 2], 4)
    assert G.tabular_region(x, y, x + 80, y + 10) == (50.0, 100.0, 430.0, 172.0, 4, 3)
    assert G.tabular_region(x[:5], y[:5], x[:5], y[:5]) is None
    assert G.tabular_region(np.arange(8) * 31.0, np.arange(8) * 20.0, np.arange(8) * 31.0, np.arange(8) * 20.0) is None


def test_tables_join_over_page_breaks(spark):
    head, other = ["A", " b ", ""], ["A", "c"]
    rows = [
        (1, 1, 0, other, [["A", "c"], ["1", "2"]]), (1, 1, 1, head, [["x", "y", ""]]), (1, 2, 0, ["a", "B"], [["z", "w", ""]]), (1, 3, 0, head, [["late", "", ""]]),
        (1, 3, 1, head, [["second", "", ""]]), (2, 1, 0, [], [["h1", "h2"], ["", " "], ["v", " w  w "]]), (3, 1, 0, head, [["", " ", ""]]),
    ]
    df = spark.createDataFrame(rows, "document_id long, page_no int, table_index int, headers array<string>, rows array<array<string>>")
    got = {(r.document_id, r.page_no, r.table_index): r for r in G.merge_continued(G.clean_tables(df)).collect()}
    assert set(got) == {(1, 1, 0), (1, 1, 1), (1, 3, 0), (1, 3, 1), (2, 1, 0)}
    assert got[1, 1, 1].parts == 2 and [r[0] for r in got[1, 1, 1].rows] == ["x", "z"]
    assert got[1, 1, 0].rows == [["1", "2"]] and got[2, 1, 0].headers == ["h1", "h2"] and got[2, 1, 0].rows == [["v", "w w"]]


def test_boxes_and_lines(spark):
    span = lambda s, e, b, col: {"s": s, "e": e, "b": b, "col": col, "font": 10.0}
    spans = [span(0, 5, [10.0, 10.0, 50.0, 20.0], 0), span(6, 9, [52.0, 12.0, 80.0, 20.0], 0), span(10, 14, [10.0, 30.0, 40.0, 40.0], 0), span(15, 20, [300.0, 11.0, 350.0, 20.0], 1)]
    df = spark.createDataFrame([(spans,)], "spans array<struct<s:int,e:int,b:array<double>,col:int,font:double>>")
    r = df.select(
        G.union_box(F.col("spans"), F.lit(3), F.lit(8)).alias("box"), G.union_box(F.col("spans"), F.lit(90), F.lit(99)).alias("none"), G.line_boxes(F.col("spans"), F.lit(3), F.lit(18)).alias("lines")
    ).first()
    assert r.box == [10.0, 10.0, 80.0, 20.0] and r.none is None
    assert r.lines == [[10.0, 10.0, 80.0, 20.0], [10.0, 30.0, 40.0, 40.0], [300.0, 11.0, 350.0, 20.0]]


def test_markdown(spark):
    df = spark.createDataFrame([(["a", "b"], [["1", "x\ny"]]), ([], [["z"]])], "h array<string>, r array<array<string>>")
    assert [x[0] for x in df.select(T.markdown_table(F.col("h"), F.col("r"))).collect()] == ["a | b\n--- | ---\n1 | x y", "z"]
