"""Typed cases to flat rows of facts, one a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cases(orders: DataFrame) -> DataFrame:
    """Orders as typed cases with nested blocks."""
    products = F.transform(
        F.when(F.col("o_orderkey") % 3 > 0, F.sequence(F.lit(0), (F.col("o_orderkey") % 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("drug "), (F.col("o_orderkey") + i).cast("string")).alias("name")),
    )
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.struct((F.col("o_custkey") % 90).cast("string").alias("age"), F.when(F.col("o_custkey") % 3 == 0, "UNKNOWN").otherwise("FEMALE").alias("sex")).alias("patient"),
        F.struct(F.to_date("o_orderdate").cast("string").alias("onset_date")).alias("reaction"),
        F.struct((F.col("o_totalprice") > 250000).alias("is_serious")).alias("severity"),
        products.alias("products"),
    )


def enum_status(value: Column) -> Column:
    """An UNKNOWN answer states nothing."""
    return F.when(value == "UNKNOWN", "NOT_STATED").otherwise("STATED")


def flatten(typed: DataFrame) -> DataFrame:
    """A row a path: scalars by one array of structs, products by position, without a join."""

    def row(path: Column | str, group: str, value: Column, status: Column | None = None) -> Column:
        path = F.lit(path) if isinstance(path, str) else path
        status = F.lit("STATED") if status is None else status
        return F.struct(path.alias("field_path"), F.lit(group).alias("field_group"), F.when(status == "NOT_STATED", "").otherwise(value).alias("value_text"), status.alias("status"))

    fixed = F.array(
        row("patient.age", "PATIENT", F.col("patient.age")),
        row("patient.sex", "PATIENT", F.col("patient.sex"), enum_status(F.col("patient.sex"))),
        row("reaction.onset_date", "REACTION", F.col("reaction.onset_date")),
        row("severity.is_serious", "SEVERITY", F.col("severity.is_serious").cast("string")),
    )
    listed = F.transform("products", lambda p, i: row(F.concat(F.lit("product["), i.cast("string"), F.lit("].name")), "PRODUCT", p["name"]))
    return typed.select("case_id", F.explode(F.concat(fixed, listed)).alias("r")).select("case_id", "r.*")


def seriousness(reactions: DataFrame, key: str) -> DataFrame:
    """(key, status, criteria array): serious if any reaction states criteria; the criteria keep their repetitions."""
    return reactions.groupBy(key).agg(F.bool_or((F.col("status") == "STATED") & (F.size("criteria") > 0)).alias("is_serious"), F.flatten(F.collect_list("criteria")).alias("criteria"))


def iso_date(raw: Column, iso: Column, relative: Column) -> tuple[Column, Column]:
    """(payload JSON, extra reason) of a partial date; a relative date is never resolved."""
    return F.to_json(F.struct(raw.alias("raw"), iso.alias("iso"), relative.alias("is_relative")), {"ignoreNullFields": "false"}), F.when(relative, "relative date, not resolved")
