"""Noise estimates and significance masks, by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def estimate_noise(pixels: DataFrame, significance_threshold: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Population deviation of the values strictly within so many deviations of their mean; NaN if none is."""
    by = ["t"] if by is None else by
    stats = pixels.groupBy(*by).agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    near = F.abs(F.col("v") - F.col("__m")) < significance_threshold * F.col("__s")
    inner = pixels.join(stats, by).groupBy(*by).agg(F.stddev_pop(F.when(near, F.col("v"))).alias("noise"), F.first("__m").alias("mean"))
    return inner.select(*by, F.coalesce("noise", F.lit(float("nan"))).alias("noise"), "mean")


def significant_mask(pixels: DataFrame, noise_threshold: float = 6.0, significance_threshold: float = 3.0, noise: DataFrame | None = None) -> DataFrame:
    """Pixels with `significant`: at least noise_threshold times the noise away from the frame's mean. noise: (t, noise, mean)."""
    noise = estimate_noise(pixels, significance_threshold) if noise is None else noise
    far = F.abs(F.col("v") - F.col("mean")) >= noise_threshold * F.col("noise")
    return pixels.join(noise, "t").withColumn("significant", far & ~F.isnan("noise")).drop("noise", "mean")


def noise_mask(pixels: DataFrame, noise_threshold: float = 6.0, **options) -> DataFrame:
    """Pixels with `noise`: what is not significant."""
    return significant_mask(pixels, noise_threshold, **options).withColumn("noise", ~F.col("significant")).drop("significant")
