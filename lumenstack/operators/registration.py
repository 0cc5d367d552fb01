"""Registration of frames: whole-pixel shifts found by correlation, and shifts by any amount."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenstack.model import cut

log = logging.getLogger(__name__)


def roll(pixels: DataFrame, dy: int, dx: int, sizes: tuple[int, int]) -> DataFrame:
    """Pixels rolled cyclically; masked where they wrapped around."""
    h, w = sizes
    y, x = F.col("y") + dy, F.col("x") + dx
    return pixels.withColumns({"masked": (y < 0) | (y >= h) | (x < 0) | (x >= w), "y": F.pmod(y, F.lit(h)), "x": F.pmod(x, F.lit(w))})


def roll_by(pixels: DataFrame, shifts: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Each frame rolled by its own shift (t, dy, dx)."""
    h, w = sizes
    joined = pixels.join(shifts, "t")
    y, x = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    return joined.withColumns({"masked": (y < 0) | (y >= h) | (x < 0) | (x >= w), "y": F.pmod(y, F.lit(h)), "x": F.pmod(x, F.lit(w))}).drop("dy", "dx")


def truncate_masked(pixels: DataFrame) -> DataFrame:
    """Without every pixel that is masked in any frame; the coordinates begin at 0 again."""
    bad = pixels.groupBy("y", "x").agg(F.bool_or("masked").alias("bad")).filter("bad").drop("bad")
    left = pixels.join(bad, ["y", "x"], "left_anti")
    corner = left.agg(F.min("y").alias("__y"), F.min("x").alias("__x"))
    return left.crossJoin(F.broadcast(corner)).withColumns({"y": F.col("y") - F.col("__y"), "x": F.col("x") - F.col("__x")}).select("t", "y", "x", "v")


def _correlated(batches: Iterator[pa.RecordBatch], template: np.ndarray) -> Iterator[pa.RecordBatch]:
    conj = np.conj(np.fft.fft2(template))
    h, w = template.shape
    for batch in batches:
        frames = batch.column("data").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, h, w)
        score = np.round(np.abs(np.fft.ifft2(np.fft.fft2(frames) * conj).real), 12).reshape(len(frames), -1)
        best = score.argmax(axis=1)  # ties: the first in C order
        columns = [batch.column("t"), pa.array(-(best // w), pa.int64()), pa.array(-(best % w), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["t", "dy", "dx"])


def find_offsets(frames: DataFrame, template: np.ndarray) -> DataFrame:
    """(t, dy, dx): minus the cyclic shift at which each frame correlates best with the template. A frame is all a step holds."""
    return frames.select("t", "data").mapInArrow(lambda b: _correlated(b, template), "t bigint, dy bigint, dx bigint")


def shortest_wraparound(column: str, size: int):
    """A shift as the shortest of those that are equal on a cycle."""
    half, d = size // 2, F.col(column)
    once = F.when(d > half, d - size).otherwise(d)
    return F.when(once < -half, once + size).otherwise(once)


def translate_fourier(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each frame moved cyclically by its own shift (t, d: an array with a real number for each axis), by a phase ramp over its spectrum.

    Whole shifts roll the frame; others give the values between pixels of the trigonometric interpolation, its real part.
    Frames without a shift are left out.
    """
    joined = frames.select("t", "shape", "data").join(shifts.select("t", F.col("d").cast("array<double>").alias("d")), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row, (shape, d) in enumerate(zip(batch.column("shape").to_pylist(), batch.column("d").to_pylist())):
                image = batch.column("data").slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(shape)
                if len(d) != image.ndim:
                    raise ValueError("a shift needs a number for each axis")
                spectrum = np.fft.fftn(image)
                for axis, by in enumerate(d):
                    ramp = np.exp(-2j * np.pi * np.fft.fftfreq(shape[axis]) * by)
                    spectrum = spectrum * ramp.reshape([-1 if k == axis else 1 for k in range(image.ndim)])
                made.append(np.fft.ifftn(spectrum).real.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("shape"), pa.array(made, pa.list_(pa.float64()))], names=["t", "shape", "data"])

    return joined.mapInArrow(run, "t bigint, shape array<int>, data array<double>")


def _added_frames(table: pa.Table) -> pa.Table:
    sums = table.column("total").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
    return pa.table({"part": table.column("part").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([sums], pa.list_(pa.float64()))})


def mean_frame(frames: DataFrame, shape: tuple[int, int], shifts: DataFrame | None = None) -> np.ndarray:
    """The mean of the shifted frames, a frame in size.

    Each task rolls its frames and adds them up; the tasks' sums are added in two steps, a row each, so no pixel is a row.
    """
    still = [F.lit(0).cast("bigint").alias(a) for a in ("dy", "dx")]
    moved = frames.select("t", "data", *still) if shifts is None else frames.select("t", "data").join(shifts.select("t", "dy", "dx"), "t").select("t", "data", "dy", "dx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape), 0
        for batch in batches:
            images = batch.column("data").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            for image, dy, dx in zip(images, batch.column("dy").to_pylist(), batch.column("dx").to_pylist()):
                total += np.roll(image, (dy, dx), (0, 1))
            n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "total"])

    schema = "part int, n bigint, total array<double>"
    parts = moved.mapInArrow(run, "n bigint, total array<double>").select((F.spark_partition_id() % 64).alias("part"), "n", "total")
    some = parts.groupBy("part").applyInArrow(_added_frames, schema).select(F.lit(0).alias("part"), "n", "total")
    row = some.groupBy("part").applyInArrow(_added_frames, schema).first()  # of at most 64
    return np.zeros(shape) if row is None else np.reshape(row.total, shape) / row.n


def register_mean_offsets(frames: DataFrame, shape: tuple[int, int], max_iters: int = 10, tell: bool = False) -> DataFrame:
    """(t, dy, dx) that bring the frames onto their own mean: correlate, centre, average again, until no shift changes.

    The mean over frames of the shifts, rounded half to even, is taken off. There are at most max_iters rounds, or as many
    as it takes if that is below 0; shifts that then come back to those of an earlier round would go round for ever, and end
    there with a warning. With `tell` a column `converged` says whether the last round changed no shift.
    """
    shifts = frames.select("t", F.lit(0).cast("bigint").alias("dy"), F.lit(0).cast("bigint").alias("dx"))
    rounds, seen, same = 0, set(), False
    while rounds != max_iters:
        rounds += 1
        raw = find_offsets(frames, mean_frame(frames, shape, shifts))
        mean = raw.agg(*[F.bround(F.avg(a)).cast("bigint").alias(f"m{a}") for a in ("dy", "dx")])
        centred = raw.crossJoin(F.broadcast(mean)).select("t", (F.col("dy") - F.col("mdy")).alias("dy"), (F.col("dx") - F.col("mdx")).alias("dx"))
        new = cut(centred.select("t", *[shortest_wraparound(a, n).cast("bigint").alias(a) for a, n in zip(("dy", "dx"), shape)]))
        same = new.join(shifts, ["t", "dy", "dx"], "left_anti").isEmpty()
        shifts = new
        if same:
            break
        if max_iters >= 0:
            continue
        state = tuple(new.agg(F.bit_xor(F.xxhash64("t", "dy", "dx")), F.sum(F.hash("t", "dy", "dx")), F.sum("dy"), F.sum("dx")).first())
        if state in seen:
            log.warning("no fixed point: after %d rounds the shifts are those of an earlier round", rounds)
            break
        seen.add(state)
    return shifts.withColumn("converged", F.lit(same)) if tell else shifts
