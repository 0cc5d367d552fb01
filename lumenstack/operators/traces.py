"""Traces of regions over time, backgrounds and relative change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenstack.operators.filters import gaussian_filter, rank_filter


def expand_rois(pixels: DataFrame, roi: Column | DataFrame) -> DataFrame:
    """(roi, y, x, corr): each region's normalised mean trace, correlated with every pixel of the normalised frames.

    roi: a column over pixels, or a table (roi, y, x). Frames, then traces, have mean 0 and norm 1.
    """
    by_frame = pixels.groupBy("t").agg(F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("*").alias("n"))
    scale = F.sqrt(F.greatest(F.col("ss") - F.col("n") * F.col("m") * F.col("m"), F.lit(0.0)))
    data = pixels.join(by_frame.select("t", "m", scale.alias("s")), "t").select("t", "y", "x", F.try_divide(F.col("v") - F.col("m"), "s").alias("v"))
    inside = data.join(roi, ["y", "x"]) if isinstance(roi, DataFrame) else data.withColumn("roi", roi)
    trace = inside.groupBy("roi", "t").agg(F.avg("v").alias("tr"))
    stats = trace.groupBy("roi").agg(F.avg("tr").alias("m"), F.sqrt(F.var_pop("tr") * F.count("*")).alias("s"))
    unit = trace.join(stats, "roi").select("roi", "t", F.try_divide(F.col("tr") - F.col("m"), "s").alias("tr"))
    return data.join(unit, "t").groupBy("roi", "y", "x").agg(F.sum(F.col("tr") * F.col("v")).alias("corr"))


def estimate_f0(pixels: DataFrame, half_window_size: int, which_quantile: float, sizes: dict[str, int], temporal_stdev: float = 0.0, spatial_stdev: float = 0.0, window_size: float = 5.0, spatial_window_size: float | None = None) -> DataFrame:
    """The background: a temporal Gaussian, a rank filter along time, a spatial Gaussian, which has the window of the first unless it has its own."""
    spatial_window_size = window_size if spatial_window_size is None else spatial_window_size
    smooth = gaussian_filter(pixels, {"t": temporal_stdev}, window_size, sizes)
    ranked = rank_filter(smooth, half_window_size, which_quantile, sizes["t"])
    return gaussian_filter(ranked, {a: spatial_stdev for a in sizes if a != "t"}, spatial_window_size, sizes)


def extract_f0(pixels: DataFrame, bias: float | None = None, by: list[str] | None = None, **background) -> DataFrame:
    """(F - F0) / (F0 + bias); the bias is 1 - min(F) unless given, over all pixels or within the stacks that `by` tells apart."""
    keys = [c for c in pixels.columns if c != "v"]
    f0 = estimate_f0(pixels, **background).withColumnRenamed("v", "f0")
    joined = pixels.join(f0, keys)
    if bias is not None:
        joined = joined.withColumn("b", F.lit(float(bias)))
    elif by:
        joined = joined.join(pixels.groupBy(*by).agg((1 - F.min("v")).alias("b")), by)
    else:
        joined = joined.crossJoin(F.broadcast(pixels.agg((1 - F.min("v")).alias("b"))))
    return joined.select(*keys, F.try_divide(F.col("v") - F.col("f0"), F.col("f0") + F.col("b")).alias("v"))


def rolling_df_over_f(events: DataFrame, half: int, quantile: float, key: str, order: list[str], value: str) -> DataFrame:
    """Relative change of irregular series: the background is a clipped rolling quantile (the value at rank ceil(q n)) of each series."""
    around = W.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    near = events.withColumn("__near", F.sort_array(F.collect_list(value).over(around)))
    f0 = F.get("__near", F.greatest(F.ceil(F.size("__near") * F.lit(quantile)).cast("int") - 1, F.lit(0)))
    bias = events.agg((1 - F.min(value)).alias("__b"))
    return near.withColumn("f0", f0).crossJoin(F.broadcast(bias)).withColumn("df", (F.col(value) - F.col("f0")) / (F.col("f0") + F.col("__b"))).drop("__near", "__b")
