"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank is its place among its
source's rows, between 0 and 1. Sorting all rows by that fraction spreads each source evenly over the
order, so any contiguous cut has the mixture of the whole, and cuts of equal length are the shards.

No window holds a whole source: rows are dealt into buckets of the shuffle key (and later of the
fraction), ranked inside a bucket, and the counts of the buckets before give the offset.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

#: Rows aimed at in a bucket, and the most buckets: the offsets of the buckets pass through one task.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 1 << 16


def interleave_shards(
    docs: DataFrame, n_shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, source, shard, slot.

    Shards differ by one row at most; slot counts from 0 in each. A null text has size 1 and the checksum
    of the empty text; null sources are a source of their own; a null id shuffles like an empty one.
    Repeated rows each get their own slot: ties of id go by checksum, then size. An empty table gives an
    empty one. Other columns of docs are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    buckets = min(MOST_BUCKETS, max(1, math.ceil(docs.count() / BUCKET_ROWS)))
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(number, F.lit("")))).alias("h"),
    ).withColumn("bucket", F.expr(f"shiftright(cast(conv(substr(h, 1, 8), 16, 10) as bigint) * {buckets}, 32)"))

    of_stratum = W.partitionBy("stratum")
    starts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n")).select(
        "stratum",
        "bucket",
        (F.sum("n").over(of_stratum.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(of_stratum).alias("in_stratum"),
    )
    in_bucket = W.partitionBy("stratum", "bucket").orderBy("h", F.asc_nulls_first("doc_id"), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_bucket) - 1).join(starts, ["stratum", "bucket"])
    spread = ranked.withColumn("fraction", (2.0 * (F.col("before") + F.col("rank")) + 1) / (2.0 * F.col("in_stratum")))
    spread = spread.withColumn("part", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))

    parts = spread.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("earlier"), F.sum("n").over(W.partitionBy()).alias("total"))
    place = F.col("earlier") + F.row_number().over(W.partitionBy("part").orderBy("fraction", "stratum")) - 1
    placed = spread.join(parts, "part").withColumn("place", place).withColumn("shard", F.expr(f"cast(place * {n_shards} div total as int)"))
    start = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - start).cast("bigint").alias("slot"))
