"""Segmentation of basis images into neurons, and the repair of zeroed lines.

Images are frames; t numbers the image. Thresholds, masks and selections are aggregates and joins over
pixels; labelling and flooding are frame kernels.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenstack.model import axes, axes_of, cut, flat_index, places, to_frames, to_pixels
from lumenstack.operators import filters, noise, regions
from lumenstack.operators.neurons import extract_neurons


def wavelet_thresholding(pixels: DataFrame, significance_threshold: float, wavelet_scale: int, noise_threshold: float, sizes: dict[str, int]) -> DataFrame:
    """(band, t[, z], y, x, v, significant): all wavelet bands of each image and what of them stands out of the noise.

    The noise is that of the original image; the mean is taken over all bands of an image together.
    """
    names = axes_of(pixels)
    level = noise.estimate_noise(pixels, significance_threshold).select("t", "noise")
    stack = to_frames(pixels, tuple(sizes[a] for a in names))
    bands = to_pixels(filters.frame_wavelets(stack, wavelet_scale, len(names), include_lower_scales=True), len(names))
    mean = bands.groupBy("t").agg(F.avg("v").alias("mean"))
    stats = level.join(mean, "t")
    far = F.abs(F.col("v") - F.col("mean")) >= noise_threshold * F.col("noise")
    return bands.join(stats, "t").select("band", "t", *names, "v", (far & ~F.isnan("noise")).alias("significant"))


def labelled(pixels: DataFrame, shape: tuple[int, ...], nonzero: bool = False) -> DataFrame:
    """Pixels (t[, z], y, x, v, label) above 0, or other than 0, in components by image."""
    names = axes(len(shape))
    signed = pixels.withColumn("v", F.abs("v")) if nonzero else pixels
    labels = regions.label_components(to_frames(signed, shape), 0.0, ndim=len(shape)).select("t", *names, "label")
    return pixels.join(labels, ["t", *names])


def _peaks(cells: DataFrame, shape: tuple[int, ...], images: DataFrame) -> DataFrame:
    """(t, label[, z], y, x, v): extended maxima of the labelled pixels' image, at their rounded centre, if that lies in a region."""
    at = ["t", *axes(len(shape))]
    image = images.select(*at).join(cells.select(*at, "v"), at, "left").fillna({"v": 0.0})
    peaks = regions.extended_local_maxima(to_frames(image, shape), len(shape))
    return peaks.join(cells, at).select("t", "label", *at[1:], "v")


def wavelet_denoising(
    pixels: DataFrame,
    shape: tuple[int, ...],
    wavelet_scale: int = 3,
    significance_threshold: float = 3.0,
    noise_threshold: float = 4.0,
    accepted_region_shape_constraints: dict | None = None,
    accepted_neuron_shape_constraints: dict | None = None,
    percentage_pixels_below_max: float = 0.0,
    min_local_max_distance: float = 10.0,
) -> DataFrame:
    """Neurons (t, label, ...) of each image, of two or three dimensions.

    (1) the last band where it is significant, its regions that break the shape constraints replaced by the band before;
    (2) components above 0, their maxima without weak and too close ones; (3) a watershed from the maxima; regions with
    several maxima after it, or out of the constraints for neurons, are dropped; (4) extraction from the original image.
    """
    if wavelet_scale < 2:
        raise ValueError("the band before the last is needed: wavelet_scale must be at least 2")
    at = ["t", *axes(len(shape))]
    sizes = dict(zip(at[1:], shape))
    bands = wavelet_thresholding(pixels, significance_threshold, wavelet_scale, noise_threshold, sizes)
    kept = cut(bands.filter(F.col("band") >= wavelet_scale - 1).withColumn("v", F.when(F.col("significant"), F.col("v")).otherwise(F.lit(0.0))))
    last, lower = (kept.filter(F.col("band") == b).select(*at, "v") for b in (wavelet_scale, wavelet_scale - 1))
    first = cut(labelled(last, shape, nonzero=True))
    fine = regions.match_regions_properties(regions.region_properties(first, ["t", "label"]), accepted_region_shape_constraints or {}).select("t", "label")
    broken = first.join(fine, ["t", "label"], "left_anti").select(*at)
    mended = last.join(broken, at, "left_anti").unionByName(lower.join(broken, at, "left_semi"))
    cells = cut(labelled(mended, shape))
    peaks = regions.remove_low_intensity_local_maxima(_peaks(cells, shape, pixels), cells, percentage_pixels_below_max)
    peaks = cut(regions.remove_too_close_local_maxima(cut(peaks), min_local_max_distance, ["t", "label"]))
    alive = cells.join(peaks.select("t", "label").distinct(), ["t", "label"], "left_semi")
    flooded = cut(_flooded(alive, peaks, pixels, shape))
    again = _peaks(flooded, shape, pixels).groupBy("t", "label").agg(F.count("*").alias("n")).filter("n = 1").select("t", "label")
    single = flooded.join(again, ["t", "label"], "left_semi")
    good = regions.match_regions_properties(regions.region_properties(single, ["t", "label"]), accepted_neuron_shape_constraints or {}).select("t", "label")
    final = single.join(good, ["t", "label"], "left_semi").select(*at, "label")
    return extract_neurons(final.join(pixels, at), ["t", "label"])


def _flooded(cells: DataFrame, peaks: DataFrame, grid: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Pixels (t[, z], y, x, v, label) of a watershed of the cells' intensity from the peaks, which are numbered by image."""
    names = axes(len(shape))
    at = ["t", *names]
    numbered = peaks.withColumn("marker", F.row_number().over(W.partitionBy("t").orderBy(*names))).select(*at, "marker")
    image = grid.select(*at).join(cells.select(*at, "v"), at, "left").join(numbered, at, "left")
    both = image.groupBy("t").agg(F.sort_array(F.collect_list(F.struct(flat_index(names, shape).alias("i"), F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("marker", F.lit(0)).alias("m")))).alias("c"))
    doubled = F.array(F.lit(2 * shape[0]), *[F.lit(n) for n in shape[1:]])
    packed = both.select("t", doubled.alias("shape"), F.concat(F.transform("c", lambda s: s["v"]), F.transform("c", lambda s: s["m"].cast("double"))).alias("data"))

    def kernel(stack: np.ndarray) -> np.ndarray:
        values, markers = stack[: shape[0]], stack[shape[0] :].astype(int)
        return regions.watershed(values, markers, values > 0)

    found = regions.frame_kernel(packed, kernel, "labels").select("t", F.posexplode("labels").alias("i", "label")).filter("label > 0")
    placed = found.select("t", *[c.alias(a) for a, c in zip(names, places("i", [str(n) for n in shape]))], "label")
    return placed.join(cells.select(*at, "v"), at)


def remove_zeroed_lines(pixels: DataFrame, grid_sizes: tuple[int, int], erosion: list[tuple[int, int]], axis: str = "x") -> DataFrame:
    """Lines of zeros filled by linear interpolation between the values next to them along an axis; at a border the nearest value.

    A zero belongs to a line if the erosion of the frame's zeros by the footprint keeps it. This is the case of lines one
    or more pixels wide whose neighbours along the axis are intact.
    """
    zero = pixels.filter("v = 0").select("t", "y", "x")
    lines = filters.binary_erosion(zero, pixels, erosion, grid_sizes).withColumn("__line", F.lit(True))
    other = "y" if axis == "x" else "x"
    marked = pixels.join(lines, ["t", "y", "x"], "left").withColumn("__ok", F.when(F.col("__line").isNull(), F.struct(F.col(axis).alias("p"), "v")))
    along = W.partitionBy("t", other).orderBy(axis)
    before = F.last("__ok", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("__ok", ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing))
    filled = marked.withColumns({"__a": before, "__b": after})
    share = (F.col(axis) - F.col("__a.p")) / (F.col("__b.p") - F.col("__a.p"))
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share
    value = F.when(F.col("__line").isNull(), F.col("v")).when(F.col("__a").isNull() | F.col("__b").isNull(), F.coalesce("__a.v", "__b.v", F.lit(0.0))).otherwise(between)
    return filled.select("t", "y", "x", value.alias("v"))


def _spread(mask: np.ndarray, sizes: list[int], grow: bool) -> np.ndarray:
    """Dilation or erosion by a box, the borders symmetric (edge repeated)."""
    for axis, size in enumerate(sizes):
        n = mask.shape[axis]
        taken = []
        for offset in range(-(size // 2), size - size // 2):
            at = (np.arange(n) + offset) % (2 * n)
            taken.append(np.take(mask, np.minimum(at, 2 * n - 1 - at), axis))
        mask = np.logical_or.reduce(taken) if grow else np.logical_and.reduce(taken)
    return mask


def delaunay_weights(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(corners, weights): the simplex of the points' Delaunay triangulation that holds a place, and its barycentric coordinates; None outside the hull.

    Lifted onto a paraboloid, the triangulation is the lower side of a convex hull, so the corners are those of the weights that make up the place and
    have the least mean of squared distances: a linear program with one row an axis and one more, solved by the simplex method (least index first, which can't cycle).
    """
    x = (points - at).astype(float)
    n, d = x.shape
    rows, goal = np.vstack([x.T, np.ones(n)]), np.r_[np.zeros(d), 1.0]
    full = np.hstack([rows, np.eye(d + 1)])
    basis = np.arange(n, n + d + 1)
    for cost in (np.r_[np.zeros(n), np.ones(d + 1)], np.r_[(x * x).sum(axis=1), np.zeros(d + 1)]):
        while True:
            inverse = np.linalg.inv(full[:, basis])
            now = inverse @ goal
            better = np.flatnonzero(cost[:n] - (cost[basis] @ inverse) @ rows < -1e-9)
            if not len(better):
                break
            step = inverse @ rows[:, better[0]]
            spare = (basis >= n) & (np.abs(now) < 1e-9) & (np.abs(step) > 1e-9)
            ratio = np.where(spare, 0.0, np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1.0), np.inf))
            low = np.flatnonzero(ratio <= ratio.min() + 1e-12)
            basis[low[np.argmin(basis[low])]] = better[0]
        if now[basis >= n].sum() > 1e-9:
            return None
    return basis[basis < n], now[basis < n]


def interpolated(points: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values at integer places by linear interpolation over the Delaunay triangulation of integer points; 0 outside their hull.

    Where the points lie in a subspace there is no triangulation, and the last point's value serves for all. Two points on a line along an axis whose circle holds no other
    are an edge of every triangulation; places between them need no search. Among corners on one circle any triangulation is as good.
    """
    if len(points) <= points.shape[1] or np.linalg.matrix_rank(points - points[0]) < points.shape[1]:
        return np.full(len(wanted), values[-1], float)
    out, left = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    for axis in range(points.shape[1]):
        others = [a for a in range(points.shape[1]) if a != axis]
        lines: dict[tuple, list[tuple[int, int]]] = {}
        for k, p in enumerate(points.tolist()):
            lines.setdefault(tuple(p[a] for a in others), []).append((p[axis], k))
        for line in lines.values():
            line.sort()
        for k in np.flatnonzero(left):
            place = wanted[k].tolist()
            line = lines.get(tuple(place[a] for a in others), [])
            at = bisect_left(line, (place[axis], -1))
            if 0 < at < len(line):
                (low, i), (high, j) = line[at - 1], line[at]
                twice = 2 * points - points[i] - points[j]
                if ((twice * twice).sum(axis=1) <= (high - low) ** 2).sum() == 2:
                    share = (place[axis] - low) / (high - low)
                    out[k], left[k] = values[i] + (values[j] - values[i]) * share, False
    for k in np.flatnonzero(left):
        found = delaunay_weights(points, wanted[k])
        if found is not None:
            out[k] = values[found[0]] @ found[1]
    return out


def filled_holes(image: np.ndarray, erosion_shape: list[int], dilation_shape: list[int]) -> np.ndarray:
    """An image whose holes, the components of what an erosion by a box leaves of its zeros, are interpolated from their outlines: what a dilation by a box adds to them."""
    holes = regions.label_image(_spread(image == 0, erosion_shape, False), 4)
    out = image.copy()
    for k in range(1, int(holes.max(initial=0)) + 1):
        hole = holes == k
        outline = _spread(hole, dilation_shape, True) & ~hole
        if outline.any():
            out[hole] = interpolated(np.argwhere(outline), image[outline], np.argwhere(hole))
    return out


def fill_zeroed_frames(frames: DataFrame, erosion_shape: list[int], dilation_shape: list[int] | None = None) -> DataFrame:
    """Frames with their zeroed lines and regions filled (see filled_holes), each where it lies. The dilation is 3 along every axis by default."""
    erosion = list(erosion_shape)
    dilation = [3] * len(erosion) if dilation_shape is None else list(dilation_shape)
    filled = regions.frame_kernel(frames, lambda image: filled_holes(image, erosion, dilation), "__filled", "array<double>")
    return filled.withColumn("data", F.col("__filled")).drop("__filled")


def fill_zeroed_regions(pixels: DataFrame, shape: tuple[int, ...], erosion_shape: list[int], dilation_shape: list[int] | None = None) -> DataFrame:
    """fill_zeroed_frames over pixels, which must be complete."""
    return to_pixels(fill_zeroed_frames(to_frames(pixels, shape), erosion_shape, dilation_shape), len(shape)).select("t", *axes(len(shape)), "v")
