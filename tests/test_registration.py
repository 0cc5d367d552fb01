"""Shifts by phase ramps, means in a tree, and registration in blocks of any size."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack import model
from lumenstack.operators import registration
from lumenstack.plans import cli


def stack_of(spark, images):
    return spark.createDataFrame([(t, list(np.shape(i)), np.asarray(i, float).ravel().tolist()) for t, i in enumerate(images)], model.FRAMES)


@pytest.mark.parametrize("shape", [(5, 8), (3, 4, 6)])
def test_whole_shifts_roll(spark, shape):
    images = np.random.default_rng(1).random((4, *shape))
    by = [[1, -2, 3][: len(shape)], [0] * len(shape), [7] * len(shape), [-1] * len(shape)]
    shifts = spark.createDataFrame(list(enumerate(by)), "t bigint, d array<int>")
    for r in registration.translate_fourier(stack_of(spark, images), shifts).collect():
        assert np.allclose(np.reshape(r.data, shape), np.roll(images[r.t], by[r.t], tuple(range(len(shape)))))
    with pytest.raises(Exception, match="each axis"):
        registration.translate_fourier(stack_of(spark, images), shifts.withColumn("d", F.array(F.lit(1)))).collect()


def test_half_a_pixel(spark):
    """A wave below the highest frequency is moved to where its formula puts it."""
    y, x = np.mgrid[:9, :10].astype(float)

    def wave(dy, dx):
        return np.cos(2 * np.pi * (2 * (y - dy) / 9 + 3 * (x - dx) / 10)) + 0.5 * np.sin(2 * np.pi * (x - dx) / 10)

    shifts = spark.createDataFrame([(0, [0.5, -0.25]), (1, [-1.75, 2.5])], "t bigint, d array<double>")
    found = {r.t: np.reshape(r.data, (9, 10)) for r in registration.translate_fourier(stack_of(spark, [wave(0, 0)] * 2), shifts).collect()}
    assert np.allclose(found[0], wave(0.5, -0.25)) and np.allclose(found[1], wave(-1.75, 2.5))


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_moved_frame_comes_back(spark, partitions):
    """Twenty frames of a block of ones, one of them moved by three, however they are dealt out."""
    image = np.zeros((10, 11))
    image[3:7, 3:8] = 1
    images = [np.roll(image, 3, 1) if t == 10 else image for t in range(20)]
    frames = stack_of(spark, images).repartition(partitions)
    shifts = registration.register_mean_offsets(frames, (10, 11), -1, tell=True)
    rows = {r.t: r for r in shifts.collect()}
    assert {t: (r.dy, r.dx) for t, r in rows.items()} == {t: (0, -3 if t == 10 else 0) for t in range(20)} and all(r.converged for r in rows.values())
    assert np.allclose(registration.mean_frame(frames, (10, 11), shifts), image)
    assert not registration.register_mean_offsets(frames, (10, 11), 1, tell=True).first().converged
    assert not registration.mean_frame(frames.limit(0), (10, 11)).any()


def test_unknown_parameters_are_told(spark, tmp_path):
    stack_of(spark, np.ones((2, 3, 3))).write.parquet(str(tmp_path / "frames"))
    for wrong in ({"max_iter": 3}, {"to_truncate": False}):
        (tmp_path / "r.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            cli.main("register", str(tmp_path / "r.json"), str(tmp_path / "out"), str(tmp_path / "frames"))
