"""Synthetic stacks for tests: balls, shells and Gaussians on a grid of two or three dimensions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenstack.model import axes, places
from lumenstack.operators.filters import axis_filter, gaussian_kernel


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All pixels of a shape."""
    return spark.range(math.prod(shape)).select(*[c.alias(a) for a, c in zip(axes(len(shape)), places("id", [str(n) for n in shape]))])


def hyperdisc_masks(spark: SparkSession, shape: tuple[int, ...], centers: list, radii_max: list, include_max: bool = False, radii_min: list | None = None, include_min: bool = False) -> DataFrame:
    """(k[, z], y, x): pixels of ball k, or of the shell between two radii; each border is in or out as asked."""
    names = axes(len(shape))
    radii_min = [-1.0] * len(centers) if radii_min is None else radii_min
    balls = [
        F.struct(F.lit(k).alias("k"), *[F.lit(float(c)).alias(f"c{a}") for a, c in zip(names, center)], F.lit(float(r)).alias("r"), F.lit(float(s)).alias("s"))
        for k, (center, r, s) in enumerate(zip(centers, radii_max, radii_min))
    ]
    cells = grid(spark, shape).withColumn("d", F.explode(F.array(*balls)))
    far = F.sqrt(sum([F.pow(F.col(a) - F.col(f"d.c{a}"), 2) for a in names], start=F.lit(0.0)))
    inside = far <= F.col("d.r") if include_max else far < F.col("d.r")
    outside = far >= F.col("d.s") if include_min else far > F.col("d.s")
    return cells.filter(inside & outside).select(F.col("d.k").cast("bigint").alias("k"), *names)


def hypersphere_masks(spark: SparkSession, shape: tuple[int, ...], centers: list, radii: list, include_boundary: bool = False) -> DataFrame:
    return hyperdisc_masks(spark, shape, centers, radii, include_boundary)


def gaussian_images(spark: SparkSession, shape: tuple[int, ...], means: list, std_devs: list, magnitudes: list) -> DataFrame:
    """(t[, z], y, x, v): image t is a point of a magnitude at its mean, smoothed by a Gaussian cut at 4 deviations, the edge held at the borders."""
    names = axes(len(shape))
    result = None
    for t, (mean, s, magnitude) in enumerate(zip(means, std_devs, magnitudes)):
        at = F.lit(True)
        for a, m in zip(names, mean):
            at = at & (F.col(a) == int(m))
        one = grid(spark, shape).select(F.lit(t).cast("bigint").alias("t"), *names, F.when(at, F.lit(float(magnitude))).otherwise(0.0).alias("v"))
        for a, n in zip(names, shape):
            one = axis_filter(one, a, gaussian_kernel(s, 4.0), n, border="nearest")
        result = one if result is None else result.unionByName(one)
    return result


def random_points(spark: SparkSession, shape: tuple[int, ...], radii: list[int], seed: int = 42) -> DataFrame:
    """(k[, z], y, x): for each radius a uniform point at least so far from the borders."""
    rows = spark.range(len(radii)).withColumn("r", F.get(F.array(*[F.lit(int(r)) for r in radii]), F.col("id").cast("int")))
    within = [(F.floor(F.rand(seed + k) * (n - 2 * F.col("r"))) + F.col("r")).alias(a) for k, (a, n) in enumerate(zip(axes(len(shape)), shape))]
    return rows.select(F.col("id").alias("k"), *within)
