"""TIFF stacks as rows, a page each.

Files are read by Spark's binary source, so any store it knows serves; the pages of a file are parsed where
the file lands. Baseline grey-scale pages: uncompressed strips of integers or floats in either byte order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# Tags and field types of the format.
WIDTH, LENGTH, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 270, 273, 277, 279, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PAGES = "path string, page int, shape array<int>, dtype string, description string, data array<double>"


def directories(body: bytes) -> Iterator[dict[int, tuple]]:
    """Tag values of each page."""
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None or struct.unpack(order + "H", body[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", body[4:8])[0]
    while at:
        count = struct.unpack_from(order + "H", body, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", body, at + 2 + 12 * k)
            if kind in TYPES:
                size = n * struct.calcsize(TYPES[kind])
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", body, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", body, place)
        tags[0] = (order,)
        yield tags
        at = struct.unpack_from(order + "I", body, at + 2 + 12 * count)[0]


def page_array(body: bytes, tags: dict[int, tuple]) -> np.ndarray:
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only uncompressed pages of one sample are read")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{tags[0][0]}{kind}{tags.get(BITS, (1,))[0] // 8}")
    raw = b"".join(body[a : a + n] for a, n in zip(tags[OFFSETS], tags[STRIP_BYTES]))
    return np.frombuffer(raw, dtype).reshape(tags[LENGTH][0], tags[WIDTH][0])


def _pages(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for n, tags in enumerate(directories(body)):
                text = b"".join(tags.get(DESCRIPTION, ())).rstrip(b"\0").decode("utf-8", "replace")
                image = page_array(body, tags)
                row = [[path], [n], [list(image.shape)], [image.dtype.newbyteorder("=").name], [text], [image.ravel().astype(float).tolist() if with_data else None]]
                types = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["path", "page", "shape", "dtype", "description", "data"])


def read_pages(spark: SparkSession, *paths: str, with_data: bool = True) -> DataFrame:
    """A row for each page of each file; without data for shapes and descriptions alone."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(lambda b: _pages(b, with_data), PAGES)


def convert(spark: SparkSession, *paths: str, channel: int = 0, z_index: int = 0, pages_to_channel: int = 1, depth: int = 1) -> DataFrame:
    """Frames (t, shape, data, path, description) of all files, in the order of their paths, one channel and depth.

    The pages of a file run over time, then depth, then channel. Offsets are running sums over one row a file.
    """
    if not 0 <= channel < pages_to_channel or not 0 <= z_index < depth:
        raise ValueError("no such channel or depth")
    group = pages_to_channel * depth
    pages = read_pages(spark, *paths)
    counts = pages.groupBy("path").agg(F.count("*").alias("n"))
    starts = counts.select("path", ((F.sum("n").over(W.orderBy("path")) - F.col("n")) / group).cast("bigint").alias("start"))
    wanted = pages.filter(F.col("page") % group == z_index * pages_to_channel + channel)
    return wanted.join(starts, "path").select((F.col("start") + F.expr(f"page div {group}")).alias("t"), "shape", "data", "path", "description")


def write_pages(path: str, images: list[np.ndarray], descriptions: list[str] | None = None) -> None:
    """A little-endian file of uncompressed pages, for exchange and tests."""
    out, chain = bytearray(b"II*\0\0\0\0\0"), 4
    for k, image in enumerate(images):
        text = ((descriptions or [""] * len(images))[k]).encode() + b"\0"
        text = text.ljust(5, b"\0")
        raw, data_at = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes(), len(out)
        out += raw
        text_at = len(out)
        out += text + b"\0" * (len(out + text) % 2)
        fields = [
            (WIDTH, 4, 1, image.shape[1]), (LENGTH, 4, 1, image.shape[0]), (BITS, 3, 1, image.dtype.itemsize * 8), (COMPRESSION, 3, 1, 1), (DESCRIPTION, 2, len(text), text_at),
            (OFFSETS, 4, 1, data_at), (SAMPLES, 3, 1, 1), (STRIP_BYTES, 4, 1, len(raw)), (SAMPLE_FORMAT, 3, 1, {"u": 1, "i": 2, "f": 3}[image.dtype.kind]),
        ]
        out[chain : chain + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        chain = len(out)
        out += b"\0\0\0\0"
    with open(path, "wb") as file:
        file.write(out)
