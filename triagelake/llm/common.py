"""What the operators of this package share: table readers, lineage cuts and texts of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


#: Small rows to a file.
FILE_ROWS = 250_000
#: Rows that go to a Python worker at once, in place of Spark's 10,000: texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads a table. Where the session leaves Spark's setting for Arrow batches as it is, they get smaller."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one (tests, notebooks) gets a folder beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lost executors cost no recomputation of what lies before.

    ``rows``, a bound on its rows where they are small ones, keeps small tables to few files.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it is a table, or columns and rows picked from one; else ``df`` written as one.

    A table gives the same rows in the same order each time it is read, so its rows can be numbered as they are read. What
    comes out of an exchange, a Python function or any RDD may come in another order.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    fixed, node = plan.deterministic(), plan
    while fixed and node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return df if fixed and (node.nodeName().startswith("Relation") or node.nodeName() in ("LogicalRelation", "LocalRelation")) else cut(df)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        drop_table(df.sparkSession, df.written_to)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The batch's texts one at a time, null as empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Gives back to the system what a task's arrays have left free, as the Python worker lives on for other tasks."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return run
