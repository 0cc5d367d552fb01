"""Connected components over an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own is set only where none is, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"


def stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The rows as written to the shared folder, so that what follows never computes them again."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Forest:
    """Disjoint sets of row numbers inside a task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Those of the pairs that joined two sets: all that connectivity needs."""
        apart = self.parent[a] != self.parent[b]
        a, b = a[apart], b[apart]
        _, once = np.unique(self.parent[a] * len(self.parent) + self.parent[b], return_index=True)
        kept: tuple[list[int], list[int]] = ([], [])
        for x, y in zip(a[once].tolist(), b[once].tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                kept[0].append(x)
                kept[1].append(y)
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return kept


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches, itself included.

    Nodes are long integers; edges with a null end, loops and repeats are ignored. Each round moves every
    edge towards its local minimum, so the number of rounds grows with the logarithm of the longest chain,
    and no node's neighbours are gathered: minima are aggregates, and joins on a hub can be split.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct().checkpoint()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes to the least node around u
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        moved = small.filter("u <> v").distinct().checkpoint()
        same = moved.count() == links.count() and moved.exceptAll(links).isEmpty()
        links = moved
        if same:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
