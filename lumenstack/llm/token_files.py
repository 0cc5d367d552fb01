"""Token ids in Parquet files that can be read selectively.

A file holds documents in ascending order of their id: columns doc_id, n_tokens and ids, a list column
whose pages are delta packed (or dictionary coded), in row groups and pages of set size with page
indexes. A reader of counts alone reads no ids; a range of documents reads only the row groups and pages
that hold it.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

#: A run of white space with the letters that follow, if punctuation or white space comes next, or with all that follows up to
#: the next white space. A piece of the pre-tokenizer never crosses the end of such a stretch, so a text's ids are those of its
#: stretches in turn. Python counts 1C to 1F as white space, the tokenizer doesn't.
STRETCH = re.compile(r"(?:[^\S\x1c-\x1f])*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?|%\s]|$)|(?:\S|[\x1c-\x1f])+)|\s+")
#: Stretches whose ids a worker remembers in each of two generations, and text bytes of a file.
MOST_HELD, FILE_BYTES = 550_000, 48_000_000
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """A tokenizer as its file sets it up, and the ids of the stretches it met of late, kept by a worker from task to task.

    Byte-level tokenizers without a prefix space are asked piece by piece, which spares them the offsets; others, and
    stretches that hold a special token, are encoded by the tokenizer as they are. Where a special token could cross a
    stretch or takes white space with it, whole texts are.
    """

    def __init__(self, definition: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        before = parts.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not parts.get("normalizer")
        added = parts.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"][0].isalpha() or re.search(r"\s", t["content"]) for t in added)
        self.pieces, self.model = regex.compile(pattern).findall, self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.space = self.letters[32]
        self.young, self.old = _Remembered(self), {}

    def encoded(self, stretch: str) -> bytes:
        if not self.by_piece or any(t in stretch for t in self.special):
            return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()
        spaced = stretch[0] == " "
        if (stretch[1:] if spaced else stretch).isalpha():  # one piece, as most are
            piece = stretch.encode().decode("latin1").translate(self.letters) if not stretch.isascii() else self.space + stretch[1:] if spaced else stretch
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = [t.id for p in self.pieces(stretch) for t in self.model.tokenize(p.encode().decode("latin1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        if len(self.young) > MOST_HELD:
            self.young, self.old = _Remembered(self), self.young
            self.old.encoder = None
        at = self.young.__getitem__
        return [b"".join(map(at, STRETCH.findall(t))) for t in texts]


class _Remembered(dict):
    """Stretches to their ids; what it lacks comes from the generation before or from the tokenizer."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, stretch: str) -> bytes:
        found = self.encoder.old.get(stretch)
        if found is None:
            found = self.encoder.encoded(stretch)
        self[stretch] = found
        return found


def _encoded(batches: Iterator[pa.RecordBatch], shared, end_id: int) -> Iterator[pa.RecordBatch]:
    definition, pattern = shared.value
    if definition not in _ENCODERS:
        _ENCODERS[definition] = Encoder(definition, pattern)
    end = struct.pack("<I", end_id)
    for batch in batches:
        for first in range(0, len(batch), 500):
            part = batch.slice(first, 500)
            bodies = [b + end for b in _ENCODERS[definition].texts(part.column("text").fill_null("").to_numpy(zero_copy_only=False).tolist())]
            counts = [len(b) // 4 for b in bodies]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), pa.array(np.frombuffer(b"".join(bodies), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("file"), pa.array(counts, pa.int64()), ids], names=["doc_id", "file", "n_tokens", "ids"])


def write_tokens(
    docs: DataFrame,
    definition: str,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    dictionary: bool = False,
) -> None:
    """Write the ids of each text by the tokenizer whose JSON is given (pattern: that of its byte-level pre-tokenizer), end_id after each, below path: files by ascending id, named in their column `file`.

    Ids are those of Tokenizer.encode(text, add_special_tokens=False): the string of a special token in a text is that token,
    if the definition doesn't say otherwise. Null texts have the end id alone; texts may be of any length. Null ids come first; repeated ids follow each other, by their text. An empty
    table leaves files without rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((definition, pattern))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    files = (source.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // FILE_BYTES + 1
    dealt = source.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows = dealt.withColumn("file", F.spark_partition_id()).mapInArrow(
        lambda batches: _encoded(batches, shared, end_id), "doc_id bigint, file int, n_tokens bigint, ids array<int>"
    )
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",  # integers that have no dictionary are delta packed
        "parquet.enable.dictionary": str(dictionary).lower(),
        "compression": "zstd",
    }
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, n_tokens, ids."""
    return spark.read.schema("doc_id bigint, file int, n_tokens bigint, ids array<int>").parquet(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    sums = tokens.select("doc_id", "file", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id bigint, file int, n_tokens bigint, ids_crc32 bigint"
    )
    files = tokens.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    in_file = W.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = sums.withColumn("upto", F.sum("n_tokens").over(in_file)).join(before, "file")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy().astype(np.int64)
        flat = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "file", "n_tokens", "ids_crc32"])
