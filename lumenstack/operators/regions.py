"""Regions of frames: labels, properties, local maxima and their selection.

Labelling needs a whole frame at once, or a slab of a volume, and runs as a numpy kernel over Arrow batches; all that
follows is aggregates and joins over the labelled pixels. Frames have two or three dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenstack.model import axes, axes_of, cut, numbered, places
from lumenstack.operators.components import unite


def neighbours(ndim: int, connectivity: int = 4) -> list[tuple[int, ...]]:
    """Offsets to the neighbours of a pixel: those across its faces (4 or 6), or all around it (8 or 26)."""
    if connectivity not in (4, 6, 8, 26):
        raise ValueError("connectivity is 4 or 6 (faces), 8 or 26 (all)")
    return [o for o in product((-1, 0, 1), repeat=ndim) if any(o) and (connectivity in (8, 26) or sum(map(abs, o)) == 1)]


def shifted(image: np.ndarray, offset: tuple[int, ...], fill) -> np.ndarray:
    """result[p] = image[p + offset], fill outside."""
    out = np.full_like(image, fill)
    to = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(offset, image.shape))
    source = tuple(slice(max(0, d), n + min(0, d)) for d, n in zip(offset, image.shape))
    out[to] = image[source]
    return out


def first_pixels(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Each true pixel's component, by the index of its first pixel in scan order, and the size of the mask elsewhere: least indices spread until none changes."""
    size = mask.size
    root = np.where(mask, np.arange(size).reshape(mask.shape), size)
    near = neighbours(mask.ndim, connectivity)
    while True:
        least = root
        for offset in near:
            least = np.minimum(least, shifted(root, offset, size))
        least = np.where(mask, least, size)
        jump = np.append(least.ravel(), size)
        least = np.where(mask, np.minimum(least, jump[least]), size)
        if (least == root).all():
            return root
        root = least


def label_image(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components numbered from 1 in scan order of their first pixel, 0 outside."""
    root = first_pixels(mask, connectivity)
    return np.where(mask, np.searchsorted(np.unique(root[mask]), root) + 1, 0)


def extended_maxima(image: np.ndarray) -> np.ndarray:
    """True on plateaus all of whose neighbours are lower; the border counts as lower, a constant image has none."""
    if image.size == 0 or (image == image.flat[0]).all():
        return np.zeros(image.shape, bool)
    peak = np.ones(image.shape, bool)
    near = neighbours(image.ndim, 8)
    for offset in near:
        peak &= shifted(image, offset, -np.inf) <= image
    while True:  # a plateau with one pixel that isn't a peak is none
        lost = np.zeros(image.shape, bool)
        for offset in near:
            lost |= peak & (shifted(image, offset, np.nan) == image) & ~shifted(peak, offset, True)
        if not lost.any():
            return peak
        peak &= ~lost


def watershed(image: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Floods the image from its lowest values, each marker's label into the mask; earlier pixels win ties."""
    from heapq import heappop, heappush

    out, heap, count = np.where(mask, markers, 0), [], 0
    for p in zip(*(x.tolist() for x in np.nonzero(out))):
        heappush(heap, (image[p], count, p))
        count += 1
    near = neighbours(image.ndim, 4)
    while heap:
        _, _, p = heappop(heap)
        for offset in near:
            q = tuple(a + d for a, d in zip(p, offset))
            if all(0 <= a < n for a, n in zip(q, image.shape)) and mask[q] and not out[q]:
                out[q] = out[p]
                heappush(heap, (image[q], count, q))
                count += 1
    return out


def frame_kernel(frames: DataFrame, kernel, out: str, kind: str = "array<bigint>") -> DataFrame:
    """Frames with a column more: kernel(image) of each frame, flattened. Batches stream; a frame is all a step holds."""
    names = frames.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", {out} {kind}"
    at, sh = names.index("data"), names.index("shape")
    item = np.int64 if "bigint" in kind else np.bool_ if "boolean" in kind else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            values, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            made = [np.asarray(kernel(values[a:b].astype(float).reshape(shape)), item).ravel() for a, b, shape in zip(starts, starts[1:], batch.column(sh).to_pylist())]
            ends = np.cumsum([0] + [len(m) for m in made]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, item)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, out])

    return frames.mapInArrow(run, fields)


def label_components(frames: DataFrame, threshold: float, connectivity: int = 4, ndim: int = 2) -> DataFrame:
    """Pixels (t[, z], y, x, v, label) above the threshold, labelled by frame in scan order; a frame is labelled as a whole."""
    labelled = frame_kernel(frames, lambda image: label_image(image > threshold, connectivity), "labels")
    cells = labelled.select("t", "shape", F.posexplode(F.arrays_zip("data", "labels")).alias("i", "c")).filter("c.labels > 0")
    named = [c.alias(a) for a, c in zip(axes(ndim), places("i", [f"shape[{k}]" for k in range(ndim)]))]
    return cells.select("t", *named, F.col("c.data").alias("v"), F.col("c.labels").alias("label"))


def label_planes(planes: DataFrame, threshold: float, depth: int = 16, connectivity: int = 6) -> DataFrame:
    """Pixels (t, z, y, x, v, label) above the threshold, in components of whole volumes, labelled in scan order.

    planes: (t, z, shape, data), a row per plane, all of one size; planes that are absent hold nothing. Slabs of `depth` planes are labelled on their
    own, each with the first plane of the next; what that plane is called by either is one component, and a union of such names over all
    seams gives the components of a volume. No task holds more than a slab.
    """
    slabs = F.array_distinct(F.array(F.expr(f"z div {depth}"), F.expr(f"greatest(z - 1, 0) div {depth}")))
    dealt = planes.select("t", F.explode(slabs).alias("slab"), F.col("z").cast("bigint").alias("z"), "shape", "data")
    held = dealt.groupBy("t", "slab").agg(F.sort_array(F.collect_list(F.struct("z", "data"))).alias("p"), F.first("shape").alias("plane"))
    volumes = held.select("t", "slab", F.col("p.z").alias("zs"), F.concat(F.array(F.size("p")), "plane").alias("shape"), F.flatten("p.data").alias("data"))
    fields = volumes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                shape, zs = (np.array(one.column(fields.index(c))[0].as_py()) for c in ("shape", "zs"))
                data = one.column(fields.index("data")).flatten().to_numpy(zero_copy_only=False).reshape(shape)
                mask = np.zeros((zs[-1] - zs[0] + 1, *shape[1:]), bool)
                mask[zs - zs[0]] = data > threshold
                root = first_pixels(mask, connectivity)
                root = np.where(mask, root + zs[0] * shape[1] * shape[2], -1)[zs - zs[0]].ravel()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([root], pa.list_(pa.int64()))], names=[*fields, "roots"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in volumes.schema) + ", roots array<bigint>"
    cells = volumes.mapInArrow(run, schema).select("t", "slab", "zs", "shape", F.posexplode(F.arrays_zip("data", "roots")).alias("i", "c")).filter("c.roots >= 0")
    layer, y, x = places("i", [f"shape[{k}]" for k in range(3)])
    named = cut(cells.select("t", "slab", F.get("zs", layer.cast("int")).alias("z"), y.alias("y"), x.alias("x"), F.col("c.data").alias("v"), F.col("c.roots").alias("root")))
    own = F.expr(f"z div {depth} = slab")
    seam = named.filter(~own).select("t", "z", "y", "x", F.struct("t", "root").alias("a"))
    edges = seam.join(named.filter(own & (F.col("z") % depth == 0)).select("t", "z", "y", "x", F.struct("t", "root").alias("b")), ["t", "z", "y", "x"]).select("a", "b")
    whole = unite(edges).select(F.col("node.t").alias("t"), F.col("node.root").alias("root"), F.col("root.root").alias("whole"))
    joined = named.filter(own).join(whole, ["t", "root"], "left").withColumn("label", F.coalesce("whole", "root"))
    return renumber_labels(joined.select("t", "z", "y", "x", "v", "label"), ["t"])


def to_planes(volumes: DataFrame) -> DataFrame:
    """Three-dimensional frames as planes (t, z, shape, data), each cut out where the volume lies."""
    size = F.col("shape")[1] * F.col("shape")[2]
    each = F.transform(F.sequence(F.lit(0), F.col("shape")[0] - 1), lambda z: F.slice("data", z * size + 1, size))
    cut_out = volumes.select("t", F.slice("shape", 2, 2).alias("plane"), F.posexplode(each).alias("z", "part"))
    return cut_out.select("t", F.col("z").cast("bigint").alias("z"), F.col("plane").alias("shape"), F.col("part").alias("data"))


def renumber_labels(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Labels as 1, 2, ... in their order within a group; only the distinct labels are ranked."""
    names = pixels.select(*by, "label").distinct().withColumn("__new", F.dense_rank().over(W.partitionBy(*by).orderBy("label")))
    return pixels.join(names, [*by, "label"]).withColumn("label", F.col("__new")).drop("__new")


def moments(names: tuple[str, ...]) -> list[Column]:
    """Integer sums of the coordinates, s{a}, and of their products, s{a}{b}, for aggregates."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    return [F.sum(a).alias(f"s{a}") for a in names] + [F.sum(F.expr(f"{a} * {b}")).alias(f"s{a}{b}") for a, b in pairs]


def eigenvalues(c: dict[str, Column], names: tuple[str, ...]) -> tuple[Column, Column]:
    """The largest and the smallest eigenvalue of a symmetric matrix of size 1 to 3, given by its entries `c{a}{b}`, in closed form."""
    if len(names) == 1:
        only = c[f"c{names[0]}{names[0]}"]
        return only, only
    if len(names) == 2:
        (y, x) = names
        half, spread = (c[f"c{y}{y}"] + c[f"c{x}{x}"]) / 2, F.sqrt(F.pow((c[f"c{y}{y}"] - c[f"c{x}{x}"]) / 2, 2) + F.pow(c[f"c{y}{x}"], 2))
        return half + spread, F.greatest(half - spread, F.lit(0.0))
    z, y, x = names
    zz, yy, xx, zy, zx, yx = (c[f"c{k}"] for k in (z + z, y + y, x + x, z + y, z + x, y + x))
    q = (zz + yy + xx) / 3
    p = F.sqrt((F.pow(zz - q, 2) + F.pow(yy - q, 2) + F.pow(xx - q, 2) + 2 * (F.pow(zy, 2) + F.pow(zx, 2) + F.pow(yx, 2))) / 6)
    a, b, d = zz - q, yy - q, xx - q
    det = a * (b * d - yx * yx) - zy * (zy * d - yx * zx) + zx * (zy * yx - b * zx)
    turn = F.acos(F.least(F.greatest(F.coalesce(F.try_divide(det / 2, F.pow(p, 3)), F.lit(1.0)), F.lit(-1.0)), F.lit(1.0))) / 3
    return q + 2 * p * F.cos(turn), F.greatest(q + 2 * p * F.cos(turn + 2 * F.pi() / 3), F.lit(0.0))


def region_properties(pixels: DataFrame, by: list[str]) -> DataFrame:
    """By region of two- or three-dimensional pixels: area, centroid, second moments from integer sums, axis lengths, eccentricity, bounding box and intensities.

    An axis length is four times the square root of the largest or smallest eigenvalue of the population covariance of the coordinates.
    """
    names = axes_of(pixels)
    sums = pixels.groupBy(*by).agg(
        F.count("*").alias("area"), *moments(names),
        *[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in names],
        F.max("v").alias("max_f"), F.min("v").alias("min_f"), F.avg("v").alias("mean_f"),
    )
    n = F.col("area")
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    props = sums.select(
        *by, "area", *[(F.col(f"s{a}") / n).alias(f"c{a}") for a in names],
        *[((n * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double") / (n * n)).alias(f"c{a}{b}") for a, b in pairs],
        *[f"{k}_{a}" for k in ("min", "max") for a in names], "max_f", "min_f", "mean_f",
    )
    big, small = eigenvalues({f"c{a}{b}": F.col(f"c{a}{b}") for a, b in pairs}, names)
    box = math.prod([F.col(f"max_{a}") - F.col(f"min_{a}") + 1 for a in names], start=F.lit(1))
    around = {1: n.cast("double"), 2: F.sqrt(4 * n / F.pi()), 3: F.cbrt(6 * n / F.pi())}[len(names)]
    return props.withColumns(
        {
            "major_axis_length": 4 * F.sqrt(big),
            "minor_axis_length": 4 * F.sqrt(small),
            "eccentricity": F.sqrt(1 - F.coalesce(F.try_divide(small, big), F.lit(1.0))),
            "equivalent_diameter": around,
            "extent": n / box,
        }
    )


def match_regions_properties(props: DataFrame, constraints: dict[str, dict[str, float]]) -> DataFrame:
    """Regions within all inclusive ranges: {property: {"min": low, "max": high}}, either end optional."""
    for name, limits in constraints.items():
        if "min" in limits:
            props = props.filter(F.col(name) >= limits["min"])
        if "max" in limits:
            props = props.filter(F.col(name) <= limits["max"])
    return props


def local_maxima(pixels: DataFrame, half: int = 1) -> DataFrame:
    """Pixels above 0 that no pixel of their neighbourhood, half pixels to each side along each axis, exceeds.

    Each pixel sends its value to its neighbours, and a maximum by target decides: one shuffle, no join.
    """
    names = axes_of(pixels)
    reach = [F.struct(*[F.lit(d).alias(a) for a, d in zip(names, o)]) for o in product(range(-half, half + 1), repeat=len(names))]
    sent = pixels.withColumn("o", F.explode(F.array(*reach)))
    own = F.when(math.prod([(F.col(f"o.{a}") == 0).cast("int") for a in names], start=F.lit(1)) == 1, F.col("v"))
    seen = sent.groupBy("t", *[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in names]).agg(F.max(own).alias("v"), F.max("v").alias("most"))
    return seen.filter("v > 0 and most <= v").drop("most")


def extended_local_maxima(frames: DataFrame, ndim: int = 2) -> DataFrame:
    """(t, peak[, z], y, x): the rounded centre of each plateau that is a maximum."""

    def kernel(image: np.ndarray) -> np.ndarray:
        return label_image(extended_maxima(image), 8)

    labelled = frame_kernel(frames, kernel, "labels")
    cells = labelled.select("t", "shape", F.posexplode("labels").alias("i", "peak")).filter("peak > 0")
    centres = [F.bround(F.avg(c)).cast("bigint").alias(a) for a, c in zip(axes(ndim), places("i", [f"shape[{k}]" for k in range(ndim)]))]
    return cells.groupBy("t", "peak").agg(*centres)


def remove_low_intensity_local_maxima(maxima: DataFrame, pixels: DataFrame, percentage_pixels_below_max: float) -> DataFrame:
    """Maxima (t, label, y, x, v) with at least that share of their region's pixels below them."""
    joined = maxima.join(pixels.select("t", "label", F.col("v").alias("__v")), ["t", "label"])
    share = joined.groupBy(*maxima.columns).agg(F.avg(F.when(F.col("__v") < F.col("v"), 1.0).otherwise(0.0)).alias("__share"))
    return share.filter(F.col("__share") >= percentage_pixels_below_max).select(*maxima.columns)


def remove_too_close_local_maxima(maxima: DataFrame, min_local_max_distance: float, by: list[str]) -> DataFrame:
    """Of two maxima of a group closer than the distance (strictly) the weaker goes, of equals the later; deletions don't cascade.

    Maxima meet in cells as wide as the distance, so a group is not compared in full.
    """
    d, names = float(min_local_max_distance), axes_of(maxima)
    cells = [f"__c{a}" for a in names]
    own = maxima.withColumns({c: F.floor(F.col(a) / d).cast("bigint") for a, c in zip(names, cells)})
    around = [F.struct(*[F.lit(k).alias(c) for c, k in zip(cells, o)]) for o in product((-1, 0, 1), repeat=len(names))]
    other = own.withColumn("__o", F.explode(F.array(*around))).select(
        *by, *[(F.col(c) + F.col(f"__o.{c}")).alias(c) for c in cells], F.struct(*[F.col(a) for a in names]).alias("__at"), F.col("v").alias("__v")
    )
    here = F.struct(*[F.col(a) for a in names])
    near = sum([F.pow(F.col(a) - F.col(f"__at.{a}"), 2) for a in names], start=F.lit(0.0))
    before = (F.col("__v") > F.col("v")) | ((F.col("__v") == F.col("v")) & (F.col("__at") < here))
    losers = own.join(other, [*by, *cells]).filter((near < d * d) & before).select(*by, *names).distinct()
    return maxima.join(losers, [*by, *names], "left_anti").select(*maxima.columns)


def contour(mask: DataFrame, sizes: tuple[int, ...], by: list[str]) -> DataFrame:
    """Pixels of a mask with a neighbour across a face outside it, the frame's outside included."""
    names = axes(len(sizes))
    near = neighbours(len(sizes))
    sent = mask.withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(names, o)]) for o in near])))
    held = sent.groupBy(*by, *[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in names]).agg(F.count("*").alias("n")).filter(F.col("n") == len(near))
    return mask.join(held, [*by, *names], "left_anti")


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Each true pixel's squared Euclidean distance to the nearest false one; 0 where false, infinite where there is none.

    Along one axis after another the least of a pixel's own value and of those at an offset, the offset's square added; offsets
    whose square exceeds all values can't lower any.
    """
    least = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        before, n = least, mask.shape[axis]
        offset = 1
        while offset < n and offset * offset < least.max():
            for sign in (-offset, offset):
                step = tuple(sign if k == axis else 0 for k in range(mask.ndim))
                least = np.minimum(least, shifted(before, step, np.inf) + offset * offset)
            offset += 1
    return least


def band_contours(frames: DataFrame, separation_distance: float = 1.0, margin: float = 1.0) -> DataFrame:
    """Frames (masks or images that are 0 outside) of which is left what lies, from the nearest pixel that is 0, at the distance give or take half the margin.

    A frame without a 0 has no contour. Frames of two or three dimensions, each where it lies.
    """
    low, high = separation_distance - margin / 2, separation_distance + margin / 2

    def kernel(image: np.ndarray) -> np.ndarray:
        far = np.sqrt(squared_distances(image != 0))
        return np.where((low <= far) & (far <= high), image, 0.0)

    return frame_kernel(frames, kernel, "__contour", "array<double>").withColumn("data", F.col("__contour")).drop("__contour")


def labeled_contours(frames: DataFrame, separation_distance: float = 1.0, margin: float = 1.0) -> DataFrame:
    """Frames with a column `labels`: the contours' components, diagonal neighbours included, numbered in scan order."""
    return frame_kernel(band_contours(frames, separation_distance, margin), lambda image: label_image(image != 0, 8), "labels")


def enumerate_masks(masks: DataFrame, by: list[str], name: str = "k") -> DataFrame:
    """Pixels of masks with `number`: the place of their mask, from 1, among the values that are there of the column `name`, within `by`."""
    present = masks.select(*by, name).distinct()
    if by:
        names = present.withColumn("number", F.row_number().over(W.partitionBy(*by).orderBy(name)).cast("bigint"))
    else:
        names = numbered(present, [name], "number").withColumn("number", F.col("number") + 1)
    return masks.join(names, [*by, name])


def enumerate_masks_max(masks: DataFrame, by: list[str], name: str = "k") -> DataFrame:
    """(by, pixel, number): of the masks that hold a pixel the one with the greatest number."""
    return enumerate_masks(masks, by, name).groupBy(*by, *axes_of(masks)).agg(F.max("number").alias("number"))
