"""Frames as they arrive: what is done inside a frame works on a stream as on a table, and running projections keep state by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenstack.model import to_pixels
from lumenstack.operators.renorm import normalize_data, projections


def normalized(stream: DataFrame, ord: float = 2) -> DataFrame:
    """Zero mean and unit norm of each frame of a stream of frames."""
    return normalize_data(stream, ord)


def running_projections(stream: DataFrame) -> DataFrame:
    """Maximum and mean so far by pixel, for output mode complete or update: the state is one frame in size."""
    return projections(to_pixels(stream))
