"""Random samples for dictionary learning: points, groups of points that light up together, and dimming, blurred, noisy frames.

Every draw is an expression of the seed and of what is drawn, by the inverse of its distribution, so a sample doesn't
depend on how Spark deals its rows out, and a lost part is drawn again as it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lumenstack.model import axes, flat_index
from lumenstack.operators.filters import gaussian_kernel


def uniform(seed: int, what: str, *keys: Column) -> Column:
    """A number in [0, 1) for each combination of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *keys), 11) / F.lit(float(1 << 53))


def choice(n: Column, seed: int, what: str, *keys: Column) -> Column:
    """A place from 0 to n - 1, all equally likely; null if n is 0."""
    return F.when(n > 0, F.least(F.floor(uniform(seed, what, *keys) * n), n - 1)).cast("bigint")


def geometric(p: float, seed: int, what: str, *keys: Column) -> Column:
    """How many trials up to the first success of probability p: 1 or more, 1 / p on average."""
    if not 0 < p <= 1:
        raise ValueError("p must be above 0 and at most 1")
    if p == 1:
        return F.lit(1).cast("bigint")
    return F.greatest(F.ceil(F.log(1 - uniform(seed, what, *keys)) / math.log(1 - p)), F.lit(1)).cast("bigint")


def uniform_mapping(rows: DataFrame, values: list, seed: int, out: str = "drawn") -> DataFrame:
    """Rows with one of the values each, all equally likely; the rows' columns are the keys. Null if there are no values."""
    if not values:
        return rows.withColumn(out, F.lit(None))
    at = choice(F.lit(len(values)), seed, out, *[F.col(c) for c in rows.columns])
    return rows.withColumn(out, F.get(F.array(*[F.lit(v) for v in values]), at.cast("int")))


def geometric_groups(rows: DataFrame, n: Column, p: float, seed: int) -> DataFrame:
    """Each row once for each member of a group of geometric size, with the member's number and a place below n, which may recur."""
    keys = [F.col(c) for c in rows.columns]
    members = F.explode(F.sequence(F.lit(1).cast("bigint"), geometric(p, seed, "size", *keys)))
    grown = rows.withColumn("member", members)
    return grown.withColumn("place", choice(n, seed, "place", *keys, F.col("member"))).filter("place is not null")


def random_mask(rows: DataFrame, shape: tuple[int, ...], draws: int, seed: int) -> DataFrame:
    """(the rows' columns[, z], y, x): where so many random pixels fall, each once; a pixel may be drawn more than once."""
    keys = [F.col(c) for c in rows.columns]
    drawn = rows.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws))) if draws else F.explode(F.array().cast("array<int>")))
    at = [choice(F.lit(n), seed, a, *keys, F.col("__draw")).alias(a) for a, n in zip(axes(len(shape)), shape)]
    return drawn.select(*keys, *at).distinct()


@dataclass
class Sample:
    """points: (run, pixel); activations: (run, group, pixel, v); noiseless and frames: (run, t, shape, data)."""

    points: DataFrame
    activations: DataFrame
    noiseless: DataFrame
    frames: DataFrame


def dictionary_sample(
    spark: SparkSession, frame_shape: tuple[int, ...], num_objects: int, num_groups: int, num_frames: int, mean_group_size: float,
    object_spread: float, object_max_intensity: float, object_min_intensity: float, background_noise_intensity: float, num_runs: int = 1, seed: int = 42,
) -> Sample:
    """Runs of a film in which groups of points light up, each for num_frames frames in which it dims to nothing in a line.

    A group's size is geometric, its points come from the run's with repeats, each point's intensity is uniform between the two; its blur is one for all its frames,
    uniform up to twice the spread, its image reflected at the borders. Noise is normal.
    """
    names = axes(len(frame_shape))
    runs = spark.range(num_runs).select(F.col("id").alias("run"))
    points = random_mask(runs, frame_shape, num_objects, seed)
    listed = points.withColumn("place", F.row_number().over(W.partitionBy("run").orderBy(*names)).cast("bigint") - 1)  # at most num_objects
    sizes = listed.groupBy("run").agg(F.count("*").alias("n"))
    groups = runs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(num_groups - 1))) if num_groups else F.explode(F.array().cast("array<int>")))
    members = geometric_groups(groups.select("run", F.col("group").cast("bigint").alias("group")), F.lit(1 << 40), 1.0 / mean_group_size, seed).join(sizes, "run")
    placed = members.withColumn("place", F.col("place") % F.col("n")).join(listed, ["run", "place"])
    level = object_min_intensity + (object_max_intensity - object_min_intensity) * uniform(seed, "level", F.col("run"), F.col("group"), F.col("member"))
    lit = placed.groupBy("run", "group", *names).agg(F.max_by(level, "member").alias("v"))  # of equal points the last one counts
    sigma = 2 * object_spread * uniform(seed, "sigma", F.col("run"), F.col("group"))
    index = flat_index(names, frame_shape)
    films = lit.groupBy("run", "group").agg(F.sort_array(F.collect_list(F.struct(index.alias("i"), "v"))).alias("lit")).select("run", "group", "lit.i", "lit.v", sigma.alias("sigma"))

    def film(noise: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    image = np.zeros(math.prod(frame_shape))
                    image[row["i"]] = row["v"]
                    image = blurred(image.reshape(frame_shape), row["sigma"]).ravel()
                    for k in range(num_frames):
                        t = row["group"] * num_frames + k
                        frame = image * ((num_frames - k) / num_frames)
                        if noise:
                            frame = frame + np.random.default_rng([seed, row["run"], t]).normal(scale=noise, size=image.shape)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["run"]]), pa.array([t]), pa.array([list(frame_shape)], pa.list_(pa.int32())), pa.array([frame], pa.list_(pa.float64()))], names=["run", "t", "shape", "data"]
                        )

        return films.mapInArrow(run, "run bigint, t bigint, shape array<int>, data array<double>")

    return Sample(points, lit, film(0.0), film(background_noise_intensity))


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian cut at 4 deviations along each axis, borders symmetric (edge repeated)."""
    half = int(4 * sigma + 0.5)
    if not half:
        return image
    kernel = gaussian_kernel(sigma, 4.0)
    for axis, n in enumerate(image.shape):
        at = np.arange(n)
        total = np.zeros(image.shape)
        for offset, weight in kernel.items():
            spot = (at + offset) % (2 * n)
            total += weight * np.take(image, np.minimum(spot, 2 * n - 1 - spot), axis)
        image = total
    return image
