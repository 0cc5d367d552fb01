"""Sequences: index spaces, skips, padding."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lumenstack.model import numbered


def index_enumerator(spark: SparkSession, *sizes: int) -> DataFrame:
    """All indices of a space in C order: i0, i1, ... made from one range."""
    names, rest = [], math.prod(sizes)
    cells = spark.range(rest)
    for k, n in enumerate(sizes):
        rest //= max(1, n)
        cells = cells.withColumn(f"i{k}", F.expr(f"id div {max(1, rest)} % {max(1, n)}"))
        names.append(f"i{k}")
    return cells.select(*names)


def range_with_skip(spark: SparkSession, start: int, stop: int, step: int = 1, to_skip: list[int] | None = None) -> DataFrame:
    """id from start to stop without the values to skip."""
    ids = spark.range(start, stop, step)
    return ids.filter(~F.col("id").isin(*to_skip)) if to_skip else ids


def skip_values(df: DataFrame, column: str, to_skip: DataFrame) -> DataFrame:
    """Rows whose value isn't among those of to_skip; null values stay."""
    return df.join(to_skip.select(F.col(to_skip.columns[0]).alias(column)).distinct(), column, "left_anti")


def skip_indices(df: DataFrame, index: str, to_skip: DataFrame) -> DataFrame:
    """Rows whose position, held in a column, isn't to be skipped."""
    return skip_values(df, index, to_skip)


def reverse_each_element(df: DataFrame, column: str) -> DataFrame:
    """Strings and arrays of a column reversed."""
    return df.withColumn(column, F.reverse(column))


def filled_stringify_numbers(df: DataFrame, column: str, out: str = "padded") -> DataFrame:
    """Numbers as text, padded with zeros to the width of the widest: one small aggregate, then a projection."""
    width = df.agg(F.max(F.length(F.col(column).cast("string"))).alias("w"))
    return df.crossJoin(F.broadcast(width)).withColumn(out, F.lpad(F.col(column).cast("string"), F.col("w"), F.lit("0"))).drop("w")


def sliding_window(df: DataFrame, column: str, size: int, partition: list[str], order: list[str]) -> DataFrame:
    """Each row with the `size` values from it on, where so many are left."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(0, size - 1)
    return df.withColumn("window", F.collect_list(column).over(w)).filter(F.size("window") == size)


def filled_stringify_enumerate(df: DataFrame, order: list[str], index: str = "index", out: str = "padded") -> DataFrame:
    """The rows with their place in the order, from 0, and the place as text, padded with zeros to the width of the last. Rows are numbered range by range."""
    placed = numbered(df, order, index)
    width = placed.agg(F.length((F.max(index)).cast("string")).alias("w"))
    return placed.crossJoin(F.broadcast(width)).withColumn(out, F.lpad(F.col(index).cast("string"), F.col("w"), F.lit("0"))).drop("w")


def filled_stringify_range(df: DataFrame, order: list[str]) -> DataFrame:
    """(index, padded) of as many places as there are rows."""
    return filled_stringify_enumerate(df, order).select("index", "padded")
