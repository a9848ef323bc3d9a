"""Vendor trailers and status logs: tall and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.functions.text import number, sanitized_label


def tall(rows: DataFrame) -> DataFrame:
    """(ordinal, label, value, value_float): trimmed values, and their number where they are one."""
    return rows.select("ordinal", "label", F.trim("value").alias("value"), number(F.col("value")).alias("value_float"))


def first_values(rows: DataFrame) -> DataFrame:
    """The first value of each (ordinal, label), by position."""
    return rows.groupBy("ordinal", "label").agg(F.min_by("value", "position").alias("value"), F.min("position").alias("position"))


def column_names(rows: DataFrame) -> DataFrame:
    """(label, name, numeric): labels in the order first seen, names made unique by _1, _2 and so on, numeric if all values are numbers."""
    seen = rows.groupBy("label").agg(F.min(F.struct("ordinal", "position")).alias("first"), (F.count_if(F.col("value").isNotNull() & number(F.col("value")).isNull()) == 0).alias("numeric"))
    named = seen.withColumn("bare", sanitized_label(F.col("label")))
    n = F.row_number().over(Window.partitionBy("bare").orderBy("first")) - 1
    return named.select("label", F.when(n == 0, F.col("bare")).otherwise(F.concat_ws("_", "bare", n.cast("string"))).alias("name"), "numeric", "first")


def wide(rows: DataFrame) -> DataFrame:
    """One row per ordinal, one column per label; the labels, a few hundred at most, come to the driver to name the columns."""
    names = column_names(rows).orderBy("first").collect()
    pivoted = first_values(rows).groupBy("ordinal").pivot("label", [r["label"] for r in names]).agg(F.first("value"))
    typed = [(F.col(f"`{r['label']}`").try_cast("double") if r["numeric"] else F.col(f"`{r['label']}`")).alias(r["name"]) for r in names]
    return pivoted.select("ordinal", *typed)
