"""Commands: convert images to frames, register frames, learn neurons. Each takes a configuration, inputs and an output table.

    python -m lumenstack.plans.cli convert CONFIG OUTPUT INPUT...
    python -m lumenstack.plans.cli register CONFIG OUTPUT INPUT
    python -m lumenstack.plans.cli learn CONFIG OUTPUT INPUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenstack import model
from lumenstack.operators import registration
from lumenstack.plans import pipeline
from lumenstack.sources import config, store, tiff


def _stack(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int], int]:
    """(frames, shape, length) of a table of frames."""
    frames = spark.read.parquet(path)
    first = frames.select("shape").first()
    return frames, tuple(first.shape), frames.agg(F.max("t")).first()[0] + 1


def convert(spark: SparkSession, parameters: dict, output: str, inputs: list[str]) -> None:
    """Image files to frames."""
    known = {k: parameters[k] for k in ("channel", "z_index", "pages_to_channel") if k in parameters}
    if parameters.get("axis", 0) != 0:
        raise ValueError("files are joined along time only")
    tiff.convert(spark, *inputs, **known).write.parquet(output)


def register(spark: SparkSession, parameters: dict, output: str, inputs: list[str]) -> None:
    """Frames onto their mean, cut to what every frame has; with include_shift the shifts go to a table beside."""
    frames, shape, _ = _stack(spark, inputs[0])
    known = {"max_iters", "float_type", "include_shift", "block_frame_length", "to_truncate"}  # Spark deals frames out itself, in blocks of any length
    if unknown := sorted(parameters.keys() - known):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    if not parameters.get("to_truncate", True):
        raise ValueError("frames are cut to what every one has; to_truncate can't be off")
    if "128" in str(parameters.get("float_type", "")):
        raise ValueError("Spark has no floats of 128 bits")
    shifts = registration.register_mean_offsets(frames, shape, max_iters=parameters.get("max_iters", -1))
    pixels = registration.truncate_masked(registration.roll_by(model.to_pixels(frames.select("t", "shape", "data")), shifts, shape))
    size = pixels.agg(F.max("y"), F.max("x")).first()
    model.to_frames(pixels, (size[0] + 1, size[1] + 1)).write.parquet(output)
    if parameters.get("include_shift"):
        shifts.write.parquet(f"{output}_shift")


def learn(spark: SparkSession, parameters: dict, output: str, inputs: list[str]) -> None:
    """Frames to neurons, whole or in blocks; stages are kept below the output's path so that a later run can resume."""
    frames, shape, length = _stack(spark, inputs[0])
    blocked = parameters.get("generate_neurons_blocks")
    if blocked:
        options = {"block_shape": "block_shape", "num_blocks": "num_blocks", "half_window_shape": "half_window", "half_border_shape": "half_border"}
        given = {options[k]: v for k, v in blocked.items() if k in options}
        found = pipeline.generate_neurons_blocks(frames, shape, length, blocked["generate_neurons"], **given)
    else:
        kept = store.recorder(spark, f"{output}_stages", overwrite=True)
        found = pipeline.generate_neurons(frames, shape, length, parameters["generate_neurons"], kept)
    found.write.parquet(output)


COMMANDS = {"convert": convert, "register": register, "learn": learn}


def main(*argv: str) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("config")
    parser.add_argument("output")
    parser.add_argument("inputs", nargs="+")
    asked = parser.parse_args(argv or None)
    COMMANDS[asked.command](SparkSession.builder.getOrCreate(), config.read_parameters(asked.config), asked.output, asked.inputs)
    return 0


if __name__ == "__main__":
    main()
