"""Pairs of vectors and of masks, and mappings between two sets.

vectors: id BIGINT, v ARRAY<DOUBLE>. A product of two sets makes every pair, so its work is the product of their sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenstack.operators.blocks import block_pairs, mask_blocks, overlaps, products_above, vector_blocks
from lumenstack.operators.renorm import vector_norm


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix_reduced_op(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], keep: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(i, j, value) of op over all pairs of two vector sets; keep(i, j, value) says which pairs are wanted.

    All pairs of two sets are what this operator is for; keep is applied where a pair is made.
    """
    left = a.select(F.col("id").alias("i"), F.col("v").alias("__a"))
    right = b.select(F.col("id").alias("j"), F.col("v").alias("__b"))
    pairs = left.crossJoin(right).select("i", "j", op(F.col("__a"), F.col("__b")).alias("value"))
    return pairs if keep is None else pairs.filter(keep(F.col("i"), F.col("j"), F.col("value")))


def dot_product(a: DataFrame, b: DataFrame) -> DataFrame:
    return matrix_reduced_op(a, b, dot)


def dot_product_normalized(a: DataFrame, b: DataFrame, ord: float = 2, keep=None) -> DataFrame:
    """Dot over both norms, computed once a vector; NaN for vectors of norm zero."""

    def normed(df: DataFrame) -> DataFrame:
        return df.select("id", F.struct("v", vector_norm(F.col("v"), ord).alias("n")).alias("v"))

    def op(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(dot(x["v"], y["v"]), x["n"] * y["n"]), F.lit(float("nan")))

    return matrix_reduced_op(normed(a), normed(b), op, keep)


def products_over(a: DataFrame, b: DataFrame | None, above: float, ord: float = 2) -> DataFrame:
    """The rows of dot_product_normalized whose value is above a bar, or NaN (which Spark and SQL order above all numbers), made by blocks.

    Without b the pairs of different ids of a, each once, i < j. Vectors without an id take no part; those that are null, hold a null or differ in length give NaN.
    """
    packed = [None if df is None else vector_blocks(df.select("id", "v", vector_norm(F.col("v"), ord).alias("n"))) for df in (a, b)]
    once = b is None
    return block_pairs(*packed, lambda x, y, same: products_above(x, y, same, above, once), "i bigint, j bigint, value double")


def dot_product_partially_normalized(a: DataFrame, b: DataFrame, ord: float = 2) -> DataFrame:
    """(i, j, over_i, over_j): the dot over the norm of each."""
    na, nb = (df.select(F.col("id").alias(k), vector_norm(F.col("v"), ord).alias(f"n{k}")) for df, k in ((a, "i"), (b, "j")))
    nan = F.lit(float("nan"))
    joined = dot_product(a, b).join(na, "i").join(nb, "j")
    return joined.select("i", "j", F.coalesce(F.try_divide("value", "ni"), nan).alias("over_i"), F.coalesce(F.try_divide("value", "nj"), nan).alias("over_j"))


def masks_overlap(a: DataFrame, b: DataFrame | None, key_a: str = "i", key_b: str = "j", position: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(i, j, intersection, union, overlap) of the masks that share a pixel: rows are true pixels, keys and positions integers. Made by blocks of masks.

    Pairs without a common pixel have overlap 0 and are left out; their union is the sum of the areas. Without b the pairs of
    different masks of a, each once, the lesser key first.
    """
    names, axes, once = [key_a, key_b, "intersection", "union", "overlap"], len(position), b is None
    packed = [mask_blocks(a, key_a, position), None if b is None else mask_blocks(b, key_b, position)]
    return block_pairs(*packed, lambda x, y, same: overlaps(x, y, same, once, axes, names), f"`{key_a}` bigint, `{key_b}` bigint, intersection bigint, `union` bigint, overlap double")


def threshold_array(column: str, threshold: float, include_below: bool = True, is_closed: bool = True) -> Column:
    """A predicate: at most, below, at least or above the threshold."""
    value = F.col(column)
    if include_below:
        return value <= threshold if is_closed else value < threshold
    return value >= threshold if is_closed else value > threshold


def unique_mapping(edges: DataFrame) -> DataFrame:
    """Edges (i, j) whose i and j have no other edge: counts by each end, joined back only for ends that occur once."""
    once_i = edges.groupBy("i").agg(F.count("*").alias("n"), F.first("j").alias("j")).filter("n = 1").select("i", "j")
    once_j = edges.groupBy("j").agg(F.count("*").alias("n")).filter("n = 1").select("j")
    return once_i.join(once_j, "j", "left_semi").select("i", "j")


def threshold_metric(metric: DataFrame, threshold: float, include_below: bool = True, is_closed: bool = True) -> DataFrame:
    return unique_mapping(metric.filter(threshold_array("value", threshold, include_below, is_closed)).select("i", "j"))


def compute_mapping_matches(edges: DataFrame, n_i: int, n_j: int) -> DataFrame:
    """One row: matched, unmatched of the first set, unmatched of the second."""
    matched = unique_mapping(edges).agg(F.count("*").alias("matched"))
    return matched.select("matched", (F.lit(n_i) - F.col("matched")).alias("only_i"), (F.lit(n_j) - F.col("matched")).alias("only_j"))


def compute_mapping_relevance(edges: DataFrame, n_i: int, n_j: int) -> DataFrame:
    """One row: recall and precision, the matched over the size of each set."""
    m = compute_mapping_matches(edges, n_i, n_j)
    return m.select(F.try_divide("matched", F.lit(n_i)).alias("recall"), F.try_divide("matched", F.lit(n_j)).alias("precision"))


def all_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j) of equal vectors: an equi-join, as only equal pairs are true."""
    return a.select(F.col("id").alias("i"), "v").join(b.select(F.col("id").alias("j"), "v"), "v").select("i", "j")


def lagged(df: DataFrame, column: str, n: int, partition: list[str], order: list[str]) -> DataFrame:
    """Columns l1 .. l(n-1): the values one to n-1 rows ahead."""
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumns({f"l{k}": F.lead(column, k).over(w) for k in range(1, n)})
