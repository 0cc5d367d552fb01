"""Separable filters along one axis at a time, rank filters, morphology and undecimated wavelets.

A filter along an axis deals series out in blocks with as much of their neighbours as the window reaches, in one shuffle, and runs
over each in numpy; along the axes of whole frames it runs where the frame lies.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lumenstack.model import axes, cut


def binomial_coefficients(n: int) -> list[int]:
    return [math.comb(n, k) for k in range(n + 1)]


def binomial_kernel(level: int, n: int = 4) -> dict[int, float]:
    """Offset to weight: row n of Pascal's triangle over 2^n, its taps 2^(level-1) apart."""
    if level < 1 or n < 1:
        raise ValueError("level and n must be at least 1")
    step = 1 << (level - 1)
    return {(k - n // 2) * step: float(Fraction(c, 1 << n)) for k, c in enumerate(binomial_coefficients(n))}


def gaussian_kernel(stdev: float, window_size: float) -> dict[int, float]:
    """Offset to weight of a normalised Gaussian, cut at window_size deviations; deviation 0 is the identity."""
    if stdev == 0:
        return {0: 1.0}
    half = max(1, int(window_size * stdev + 0.5))
    weights = {k: math.exp(-0.5 * (k / stdev) ** 2) for k in range(-half, half + 1)}
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def reached(at: np.ndarray, n: int, border: str) -> np.ndarray:
    """The indices of 0..n-1 that stand for any indices: mirrored without repeating the edge, as often as it takes, or held at it ("nearest")."""
    if border == "nearest" or n == 1:
        return np.clip(at, 0, n - 1)
    within = at % (2 * (n - 1))
    return np.minimum(within, 2 * (n - 1) - within)


def along(pixels: DataFrame, axis: str, size: int, reach: int, kernel: Callable[[np.ndarray], np.ndarray], first: int = 0, border: str = "mirror", block: int | None = None) -> DataFrame:
    """Pixels whose v is kernel(window values) along an axis, which must be complete from `first` on for `size` places.

    The axis is cut into blocks. A pixel goes to its block and to those within reach of it, (block + 2 reach) / block rows for one; series
    stand sorted in their partitions and pass by one run at a time. The kernel gets a run with `reach` values more at each end and gives a
    value for each place between. All other columns tell series apart.
    """
    others = [c for c in pixels.columns if c not in (axis, "v")]
    block = block or max(4 * reach, 1024)
    place = F.col(axis) - first
    held = F.sequence(F.expr(f"greatest({axis} - {first + reach}, 0) div {block}"), F.expr(f"least({axis} - {first - reach}, {size - 1}) div {block}"))
    dealt = pixels.select("v", *others, place.cast("bigint").alias("__p"), F.explode(held).alias("__block"))
    rows = dealt.repartition("__block", *others).sortWithinPartitions("__block", *others, "__p")
    keys = ["__block", *others]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole runs."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if not len(table):
                continue
            last = table.slice(len(table) - 1)
            same = np.ones(len(table), bool)
            for key in keys:
                same &= pc.equal(table.column(key), last.column(key)[0]).to_numpy(zero_copy_only=False)
            start = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield table.slice(0, start)
            rest = table.slice(start)
        if rest is not None and len(rest):
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            table = table.combine_chunks()
            places, values, blocks = (table.column(c).to_numpy() for c in ("__p", "v", "__block"))
            opens = np.ones(len(table), bool)
            opens[1:] = False
            for key in keys:
                column = table.column(key).to_numpy()
                opens[1:] |= column[1:] != column[:-1]
            starts = np.append(np.flatnonzero(opens), len(table))
            kept, made = [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                low, high = int(blocks[a]) * block, min(size, int(blocks[a]) * block + block)
                from_, to = max(0, low - reach), min(size, high + reach)
                if b - a != to - from_ or places[a] != from_ or places[b - 1] != to - 1:
                    raise ValueError(f"pixels must be complete along {axis}, from {first} for {size} places")
                made.append(kernel(values[a:b][reached(np.arange(low - reach, high + reach), size, border) - from_]))
                kept.append(np.arange(a + low - from_, a + high - from_))
            out = table.take(pa.array(np.concatenate(kept)))
            columns = [out.column(c) for c in others] + [pa.array(out.column("__p").to_numpy() + first), pa.array(np.concatenate(made).astype(float))]
            yield from pa.table(columns, names=[*others, axis, "v"]).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in others) + f"{', ' * bool(others)}`{axis}` bigint, v double"
    return rows.mapInArrow(run, fields).select(*pixels.columns)


def axis_filter(pixels: DataFrame, axis: str, kernel: dict[int, float], size: int, first: int = 0, border: str = "mirror") -> DataFrame:
    """Correlate v with the kernel along an axis of the given size, of any length; borders are mirrored without repeating
    the edge (as often as a long kernel needs), or with border="nearest" hold the edge's value."""
    reach = max(map(abs, kernel))

    def correlate(window: np.ndarray) -> np.ndarray:
        n = len(window) - 2 * reach
        out = np.zeros(n)
        for offset, weight in sorted(kernel.items()):
            out += weight * window[reach + offset : reach + offset + n]
        return out

    return along(pixels, axis, size, reach, correlate, first, border)


def gaussian_filter(pixels: DataFrame, stdev: dict[str, float], window_size: float, sizes: dict[str, int], border: str = "mirror") -> DataFrame:
    """One pass for each axis whose deviation isn't 0."""
    for axis, s in stdev.items():
        if s:
            pixels = axis_filter(pixels, axis, gaussian_kernel(s, window_size), sizes[axis], border=border)
    return pixels


def sliding_rank(window: np.ndarray, half: int, rank: int) -> np.ndarray:
    """The value of a rank among each 2 half + 1 values that follow each other; NaN sorts last.

    A sorted list takes each new value in and lets the oldest go; short windows are sorted at once.
    """
    n = len(window) - 2 * half
    if half <= 16 or np.isnan(window).any():
        return np.concatenate([np.sort(np.lib.stride_tricks.sliding_window_view(window[a : a + 4096 + 2 * half], 2 * half + 1), axis=1)[:, rank] for a in range(0, n, 4096)])
    values, out = window.tolist(), np.empty(n)
    held = sorted(values[: 2 * half])
    for k in range(n):
        insort(held, values[k + 2 * half])
        out[k] = held[rank]
        del held[bisect_left(held, values[k])]
    return out


def rank_filter(pixels: DataFrame, half_window_size: int, quantile: float, size: int, axis: str = "t") -> DataFrame:
    """The value of rank round(q * 2h) among the 2h + 1 around each, borders mirrored."""
    h = half_window_size
    rank = round(quantile * 2 * h)
    return along(pixels, axis, size, h, lambda window: sliding_rank(window, h, rank))


def binary_dilation(mask: DataFrame, footprint: list[tuple[int, int]], sizes: tuple[int, int]) -> DataFrame:
    """Pixels (t, y, x) within a footprint offset of a pixel of the mask, the borders symmetric (edge repeated).

    mask: rows of its true pixels. A pixel p is set if p + offset is, for some offset.
    """
    reached = mask.select("t", "y", "x", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in footprint])).alias("o"))

    def back(axis: str, delta: str, n: int):
        i, d = F.col(axis), F.col(f"o.{delta}")
        period = F.lit(2 * n)
        return F.filter(F.array(F.pmod(i - d, period), F.pmod(-1 - i - d, period)), lambda p: p < n)

    return reached.select("t", F.explode(back("y", "dy", sizes[0])).alias("y"), "x", "o").select("t", "y", F.explode(back("x", "dx", sizes[1])).alias("x")).distinct()


def binary_erosion(mask: DataFrame, grid: DataFrame, footprint: list[tuple[int, int]], sizes: tuple[int, int]) -> DataFrame:
    """Pixels all of whose footprint neighbours are in the mask: what a dilation of the rest of the grid doesn't reach."""
    rest = grid.select("t", "y", "x").join(mask, ["t", "y", "x"], "left_anti")
    return grid.select("t", "y", "x").join(binary_dilation(rest, footprint, sizes), ["t", "y", "x"], "left_anti")


def box(half_y: int, half_x: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-half_y, half_y + 1) for dx in range(-half_x, half_x + 1)]


def wavelet_transform(pixels: DataFrame, scale: int | dict[str, int], sizes: dict[str, int], include_lower_scales: bool = False, include_intermediates: bool = False) -> DataFrame:
    """Undecimated wavelet: the last detail band, or with include_lower_scales all of them, in a column `band` from 1.

    Level i smooths each axis whose scale is at least i by the binomial kernel of that level; a band is the
    difference of two neighbouring smoothings. With include_intermediates all bands have a column `smooth`, the image after that level.
    Any axis may be smoothed, time too; where only axes of the frames are, frame_wavelets moves no rows.
    """
    scale = {a: scale for a in sizes} if isinstance(scale, int) else scale
    bands, current = [], pixels
    for level in range(1, max(scale.values()) + 1):
        smooth = current
        for axis, last in scale.items():
            if level <= last:
                smooth = axis_filter(smooth, axis, binomial_kernel(level), sizes[axis])
        keys = [c for c in pixels.columns if c != "v"]
        # a union and an aggregate instead of a join: the difference is a sum with signs
        signed = current.withColumn("__s", F.lit(None).cast("double")).unionByName(smooth.select(*keys, (-F.col("v")).alias("v"), F.col("v").alias("__s")))
        band = signed.groupBy(*keys).agg(F.sum("v").alias("v"), F.max("__s").alias("smooth")).withColumn("band", F.lit(level))
        bands.append(band if include_intermediates else band.drop("smooth"))
        current = cut(smooth) if max(scale.values()) > 2 else smooth
    if not (include_lower_scales or include_intermediates):
        return bands[-1].drop("band")
    result = bands[0]
    for b in bands[1:]:
        result = result.unionByName(b)
    return result


def smoothed(image: np.ndarray, axis: int, kernel: dict[int, float]) -> np.ndarray:
    """The image correlated with the kernel along an axis, borders mirrored without repeating the edge."""
    n = image.shape[axis]
    out = np.zeros(image.shape)
    for offset, weight in sorted(kernel.items()):
        out += weight * np.take(image, reached(np.arange(n) + offset, n, "mirror"), axis)
    return out


def frame_wavelets(frames: DataFrame, scale: int | dict[str, int], ndim: int = 2, include_lower_scales: bool = False, include_intermediates: bool = False) -> DataFrame:
    """(t, band, shape, data[, smooth]): the wavelet of each frame along its own axes, computed where the frame lies.

    The last band, all of them (include_lower_scales), or all with the smoothed image of each level (include_intermediates).
    """
    names = axes(ndim)
    scale = {a: scale for a in names} if isinstance(scale, int) else scale
    levels = max(scale.values())
    every = include_lower_scales or include_intermediates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("data")
            values, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for row, (a, b, shape) in enumerate(zip(starts, starts[1:], batch.column("shape").to_pylist())):
                current, made = values[a:b].astype(float).reshape(shape), []
                for level in range(1, levels + 1):
                    smooth = current
                    for k, name in enumerate(names):
                        if level <= scale.get(name, 0):
                            smooth = smoothed(smooth, k, binomial_kernel(level))
                    if every or level == levels:
                        made.append((level, current - smooth, smooth))
                    current = smooth
                n = len(made)
                columns = [pa.array([batch.column("t")[row].as_py()] * n, pa.int64()), pa.array([m[0] for m in made], pa.int32()), pa.array([shape] * n, pa.list_(pa.int32()))]
                for k in (1, 2) if include_intermediates else (1,):
                    ends = np.arange(n + 1, dtype=np.int32) * (b - a)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([m[k].ravel() for m in made]))))
                yield pa.RecordBatch.from_arrays(columns, names=["t", "band", "shape", "data", "smooth"][: len(columns)])

    schema = "t bigint, band int, shape array<int>, data array<double>" + ", smooth array<double>" * include_intermediates
    return frames.select("t", "shape", "data").mapInArrow(run, schema)
