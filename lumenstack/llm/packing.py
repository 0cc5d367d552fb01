"""Packing token ids into sequences of a fixed length with few gaps.

Documents are encoded where they are read and leave a row for each piece. Pieces are dealt into groups of bounded size, and
each group is packed on its own: from the longest piece down, each goes to the open sequence that leaves the sum of the squared
counts of open sequences by gap smallest, the tightest of equals; a new sequence is opened only where none has room. Even counts
keep all gaps in stock for what is still to come, so that a group of some thousand pieces needs about one sequence more than
its tokens fill.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenstack.llm.components import stored
from lumenstack.llm.textbatch import by_bytes, tidy
from lumenstack.llm.token_files import _ENCODERS, Encoder

#: Text bytes of a batch that is encoded at a time, and pieces of a group on average.
BATCH_BYTES, GROUP_PIECES = 4 << 20, 8192


def pieces(
    docs: DataFrame,
    definition: str,
    capacity: int = 2048,
    pattern: str = public_tokenizers.PATTERN,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place[, ids]: each text's ids by the tokenizer whose JSON is given, end_id after
    them, in pieces of at most the capacity.

    A document that fits is one piece. A longer one is cut into full pieces, of which the first may be shorter. place numbers
    the rows of a task, so that equal rows differ. Null and empty texts have the end id alone; null and repeated ids stay as they are; texts
    may be of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast((definition, pattern))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, pattern = shared.value
        if definition not in _ENCODERS:
            _ENCODERS[definition] = Encoder(definition, pattern)
        place, end = 0, struct.pack("<I", end_id)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            bodies = _ENCODERS[definition].texts(batch.column("text").fill_null("").to_pylist())
            rows, cut, sums, kept = [], [], [], []
            for row, body in enumerate(bodies):
                ids = memoryview(body + end)
                n = len(ids) // 4
                first = n - (n - 1) // capacity * capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for a, b in zip(bounds, bounds[1:]):
                    rows.append(row)
                    cut.append((len(rows), a, b))
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
                    if with_ids:
                        kept.append(np.frombuffer(ids[4 * a : 4 * b], "<i4"))
            at = np.array(rows, np.int64)
            spans = np.array(cut, np.int64).reshape(-1, 3)
            opened = np.searchsorted(at, at, "left")
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(at)),
                "piece": pa.array((np.arange(len(at)) - opened).astype(np.int32)),
                "start": pa.array(spans[:, 1]),
                "length": pa.array(spans[:, 2] - spans[:, 1]),
                "ids_crc32": pa.array(sums, pa.int64()),
                "place": pa.array(np.arange(place, place + len(at))),
            }
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            place += len(at)
            yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint" + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, which come in the order in which they are placed; none exceeds the capacity.

    With n[g] open sequences of gap g, a piece of length s that goes from gap g to g - s changes the sum of squares
    by 2 (n[g - s] - n[g]) + 2, or by 1 - 2 n[g] if it fills the gap.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    counts, open_by_gap, made = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0
    for k, s in enumerate(lengths.tolist()):
        left = np.flatnonzero(counts[s:])
        if len(left):
            change = np.where(left > 0, 2 * counts[left] + 2, 1) - 2 * counts[left + s]
            rest = int(left[np.argmin(change)])  # of equals the least gap that stays
            which = open_by_gap[rest + s].pop()
            counts[rest + s] -= 1
        else:
            which, rest = made, capacity - s
            made += 1
        sequence[k], offset[k] = which, capacity - rest - s
        if rest:
            counts[rest] += 1
            open_by_gap[rest].append(which)
    return sequence, offset


def pack(rows: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with their sequence_id and offset: the offsets of a sequence are gapless from 0.

    rows: as pieces() gives them, of length 1 to the capacity; other columns are kept. They are read twice, so write them first.
    A group's pieces come from all over the table by a hash that tells equal rows apart, so no id or text can fill one.
    """
    groups = rows.count() // group_pieces + 1
    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "place", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("place", "ascending")])
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        first = table.column("pack_group")[0].as_py() << 32 if len(table) else 0
        out = table.drop_columns(["pack_group"])
        return out.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, definition: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids] of all documents. An empty table gives no rows."""
    cut = pieces(docs, definition, capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col)
    return pack(stored(docs.sparkSession, cut, "pieces"), capacity).drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, offsets, ids: each packed sequence as one row, of pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return whole.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), F.flatten("p.ids").alias("ids"))
