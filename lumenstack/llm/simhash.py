"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are cut in blocks of bits; two that differ in at most `radius` bits agree on all blocks but
`radius` of them, so rows meet under the values of every choice of the other blocks. Where they meet,
their remaining bits are stored as vertical planes, a machine word holding one bit of 64 fingerprints.
A query is compared with whole words at a time: carry-save counters add up the differing planes, and a
run of words is abandoned as soon as all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenstack.llm.components import Forest, connected_components, stored
from lumenstack.llm.textbatch import byte_buffer, with_columns

BITS, SEED = 64, 42
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 of each run of `words` words of a text whose words are parted by single spaces; of all of it if it has fewer."""
    if not text:
        return []
    ends = [i for i, c in enumerate(text) if c == 32] if len(text) < 64 else np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    starts, stops = [0, *(e + 1 for e in ends)], [*ends, len(text)]
    hashed = xxhash.xxh64_intdigest
    return [hashed(text[a:b], SEED) for a, b in zip(starts, stops[words - 1 :])] or [hashed(text, SEED)]


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run hashes[ends[i]:ends[i + 1]], the word whose bits are set in over half of the run; empty runs give zero."""
    sizes = np.diff(ends)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # fields of 16 bits count up to 65535, so longer runs are summed in pieces
    piece = 60_000
    cuts = np.concatenate([np.arange(ends[i], ends[i + 1], piece) for i in full]) if sizes.max() > piece else ends[:-1][full]
    owner = np.searchsorted(ends[:-1][full], cuts, "right") - 1
    field = np.uint64(0x0001000100010001)
    for low in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(low)) & field, cuts)
        for k in range(4):
            count = np.bincount(owner, (sums >> np.uint64(16 * k)) & np.uint64(0xFFFF), len(full))
            out[full] |= (2 * count > sizes[full]).astype(np.uint64) << np.uint64(low + 16 * k)
    return out


def normal_words(text: bytes) -> bytes:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    return b" ".join(text.lower().split())  # bytes: both act on ASCII only, and split() on 0x20 and 0x09 to 0x0D


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, unless named) and fp, the fingerprint as a long. Null, empty and blank texts have fingerprint zero."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    return source.mapInArrow(lambda batches: _fingerprints(batches, keep, words), f"{fields}, fp bigint")


def _fingerprints(batches: Iterator[pa.RecordBatch], keep: list[str], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, ends = byte_buffer(batch.column("__text"))
        found, parts, size, runs = [], [], 0, [0]
        for i in range(len(batch)):
            parts.append(np.array(shingle_hashes(normal_words(flat[ends[i] : ends[i + 1]].tobytes()), words), np.uint64))
            size += len(parts[-1])
            runs.append(size)
            if size > 500_000 or i == len(batch) - 1:
                found.append(majority_bits(np.concatenate(parts), np.array(runs)))
                parts, size, runs = [], 0, [0]
        yield with_columns(batch, keep, fp=pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: plane b, word w, bit i is bit b of value 64 w + i; the last word is filled with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # word, value, bit
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(BITS, -1, 8).copy().view(np.uint64)[:, :, 0]


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int, block: int = 64, check_every: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, value) numbers of the values whose distance is at most the radius, by blocks of words.

    The counters are bit-sliced: a carry-save adder adds a plane of differences to `levels` planes of sums
    and a sticky overflow. After every few planes, queries for which the whole block has overflowed leave.
    """
    levels = max(1, radius.bit_length())
    # differences are counted from the top: a counter that starts at 2^levels - 1 - radius overflows beyond the radius
    start = (1 << levels) - 1 - radius
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    for first in range(0, planes.shape[1], block):
        part = planes[:, first : first + block]
        alive = np.arange(len(queries))
        sums = [np.full((len(queries), part.shape[1]), everything if start >> k & 1 else np.uint64(0), np.uint64) for k in range(levels)]
        over = np.zeros((len(queries), part.shape[1]), np.uint64)
        for b in range(BITS):
            carry = part[b][None] ^ np.where((queries[alive] >> np.uint64(b)) & np.uint64(1), everything, np.uint64(0))[:, None]
            for k in range(levels):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if b % check_every == check_every - 1:
                near = (over != everything).any(axis=1)
                if not near.all():
                    alive, over, sums = alive[near], over[near], [s[near] for s in sums]
                    if not len(alive):
                        break
        if len(alive):
            bits = np.unpackbits((~over).view(np.uint8).reshape(len(alive), -1), axis=1, bitorder="little")
            q, v = np.nonzero(bits)
            yield alive[q], first * 64 + v


def wide_fingerprints(hashes: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """[runs, words]: fingerprints of 64 * words bits of the runs hashes[ends[i]:ends[i + 1]], each word from the hashes mixed anew; empty runs give zeros."""
    out = np.zeros((len(ends) - 1, words), np.uint64)
    for k in range(words):
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        out[:, k] = majority_bits(mixed ^ (mixed >> np.uint64(31)), ends)
    return out


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs a[i], b[i] of fingerprints [n, words], whether they differ in at most `radius` bits.

    64 pairs share a machine word: planes of differing bits are added up by carry-save counters as in within_radius.
    """
    levels = max(1, radius.bit_length())
    start, blocks = (1 << levels) - 1 - radius, -(-len(a) // 64)
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    sums = [np.full(blocks, everything if start >> k & 1 else np.uint64(0), np.uint64) for k in range(levels)]
    over = np.zeros(blocks, np.uint64)
    for word in (a ^ b).T:
        for carry in bit_planes(word):
            for k in range(levels):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _forest(values: np.ndarray, ids: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the ids of what shares a bucket and lies within the radius: a spanning forest, not all pairs."""
    forest, a, b = Forest(len(values)), [], []
    planes = bit_planes(values)
    for first in range(0, len(values), 256):
        for q, v in within_radius(values[first : first + 256], planes, radius):
            q = q + first
            ordered = (q < v) & (v < len(values))
            q, v = q[ordered], v[ordered]
            meet = bucket[q] == bucket[v]
            x, y = forest.join(q[meet], v[meet])
            a += x
            b += y
    return ids[np.array(a, int)], ids[np.array(b, int)]


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket; a bucket may run over several."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray):
        same = bucket[1:] == bucket[:-1]
        met = np.r_[False, same] | np.r_[same, False]  # a row alone in its bucket has no pair
        bucket, fp, node = bucket[met], fp[met], node[met]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        cuts, found = [0], []
        for stop in [*starts[1:].tolist(), len(bucket)]:  # small buckets are compared together, large ones alone
            if stop - cuts[-1] >= 256 or stop == len(bucket):
                found.append(_forest(fp[cuts[-1] : stop], node[cuts[-1] : stop], bucket[cuts[-1] : stop], radius))
                cuts.append(stop)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        if not len(batch):
            continue
        bucket, fp, node = (batch.column(k).to_numpy() for k in ("bucket", "fp", "node"))
        held.append((bucket, fp.view(np.uint64), node))
        bucket, fp, node = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(bucket, bucket[-1], "left"))
        if last:
            yield from flush(bucket[:last], fp[:last], node[:last])
        held = [(bucket[last:], fp[last:], node[last:])]
    if held:
        yield from flush(*held[0])


def link_edges(prints: DataFrame, radius: int = 2, blocks: int = 5) -> DataFrame:
    """Edges (a, b) that connect the rows (fp, node) of distinct fingerprints within the radius of each other.

    Rows meet under each choice of `blocks - radius` blocks of bits: with 5 blocks and radius 2 under 10 keys of
    38 or 39 bits, so that unrelated fingerprints hardly ever meet.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than blocks")
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in choice) for choice in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for n, m in enumerate(signed)])
    met = prints.select("fp", "node", F.explode(keys).alias("key")).select(F.xxhash64("key.n", "key.part").alias("bucket"), "fp", "node")
    # a key seen once has no pair; what meets by chance of the hash is compared in full all the same
    shared = met.repartition("bucket").sortWithinPartitions("bucket")
    return shared.mapInArrow(lambda batches: _edges(batches, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (16 hex digits), component_id (least id reachable by links).

    Equal fingerprints count as one class before any comparison, so a large group of copies is one row. Null
    texts have fingerprint zero. Null ids take no part as names: such a row carries the component of its
    class, or null if no row of the class has an id. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    prints = fingerprints(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "text", words, ["doc_id"])
    prints = stored(spark, prints, "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter(F.col("node").isNotNull())
    found = connected_components(link_edges(classes, radius))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")

