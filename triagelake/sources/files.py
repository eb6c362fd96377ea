"""File sources and sinks: golden labels, exported samples, reports, append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Golden fields are a sparse map of dotted paths; inferring a struct would give a column a path.
GOLDEN = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("edge_cases", T.ArrayType(T.StringType())),
        T.StructField("cases", T.ArrayType(T.StructType([T.StructField("icsr_elements", T.MapType(T.StringType(), T.BooleanType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))),
    ]
)


def goldens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(GOLDEN).json(folder)


def golden_facts(found: DataFrame) -> DataFrame:
    """(key, case_index, path, expected)."""
    cases = found.select("key", F.posexplode("cases").alias("case_index", "c"))
    return cases.select("key", "case_index", F.explode("c.fields").alias("path", "expected"))


def append_log(rows: DataFrame, folder: str) -> None:
    """Appends to a log table; logs are only ever appended to."""
    rows.write.mode("append").parquet(folder)


def replace_messages(rows: DataFrame, folder: str) -> None:
    """An idempotent run: the partitions of the messages in ``rows`` are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("message_id").parquet(folder)


def export_samples(details: DataFrame, folder: str) -> None:
    """Nested JSON, a line a message."""
    details.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def report(tables: dict[str, DataFrame]) -> tuple[str, str]:
    """(JSON, Markdown) of small result tables, whole."""
    data = {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in tables.items()}
    lines = []
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str(r.get(c, "")) for c in df.columns) + " |" for r in data[name]]
        lines.append("")
    return json.dumps(data, indent=2, ensure_ascii=False, default=str), "\n".join(lines)
