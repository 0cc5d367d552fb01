"""Frames brought to zero mean and unit norm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def vector_norm(data: Column, ord: float = 2) -> Column:
    """p-norm of an array, p above 0; infinity gives the largest magnitude. An empty array has norm 0."""
    if not ord > 0:
        raise ValueError("ord must be above 0")
    if ord == float("inf"):
        return F.coalesce(F.array_max(F.transform(data, F.abs)), F.lit(0.0))
    total = F.aggregate(data, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(ord))))
    return F.sqrt(total) if ord == 2 else F.pow(total, F.lit(1.0 / ord))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: inlined in a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def zeroed_mean_images(frames: DataFrame) -> DataFrame:
    """Each frame minus its mean. Inside a row: no shuffle."""
    mean = F.try_divide(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), F.size("data"))
    return frames.withColumn("data", bound(mean, lambda m: F.transform("data", lambda x: x - m)))


def renormalized_images(frames: DataFrame, ord: float = 2) -> DataFrame:
    """Each frame divided by its norm; frames of norm zero stay."""

    def scaled(data: Column) -> Column:
        return bound(vector_norm(data, ord), lambda n: F.when(n != 0, F.transform(data, lambda x: x / n)).otherwise(data))

    return frames.withColumn("data", bound(F.col("data"), scaled))


def normalize_data(frames: DataFrame, ord: float = 2) -> DataFrame:
    """Zero mean, then unit norm."""
    return renormalized_images(zeroed_mean_images(frames), ord)


def projections(pixels: DataFrame) -> DataFrame:
    """Maximum and mean over time for each pixel."""
    return pixels.groupBy("y", "x").agg(F.max("v").alias("mx"), F.avg("v").alias("mn"))
