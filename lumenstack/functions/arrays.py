"""Array functions as column expressions, and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def get_quantiles(probs: int | float | list[float]) -> list[float]:
    """Probabilities from a count of equal parts, a single one, or a list; each must lie between 0 and 1."""
    if isinstance(probs, int) and not isinstance(probs, bool):
        found = [k / (probs + 1) for k in range(1, probs + 1)]
    else:
        found = [float(p) for p in (probs if isinstance(probs, (list, tuple)) else [probs])]
    if not all(0 < p < 1 for p in found):
        raise ValueError("probabilities must lie between 0 and 1")
    return found


def quantile(df: DataFrame, column: str, probs: int | float | list[float], by: list[str] | None = None) -> DataFrame:
    """Hazen quantiles by group: column q and its value. Nulls and NaN are left out; a single value is every quantile.

    The value of position n p + 1/2 among the n sorted values, interpolated. Ranks come from counts of distinct
    values, so a group is never gathered: only running sums over its distinct values are ordered.
    """
    by = by or []
    probs = get_quantiles(probs)
    counts = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"__hi": F.sum("__c").over(upto), "__n": F.sum("__c").over(W.partitionBy(*by))})
    wanted = ranked.withColumn("q", F.explode(F.array(*[F.lit(p) for p in probs])))
    place = F.col("__n") * F.col("q") + 0.5
    low = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(F.col("__n") - 1, F.lit(1)))
    share = F.least(F.greatest(place - low, F.lit(0.0)), F.lit(1.0))
    first, last = F.col("__hi") - F.col("__c") + 1, F.col("__hi")
    has_low, has_high = (first <= low) & (low <= last), (first <= F.least(low + 1, F.col("__n"))) & (F.least(low + 1, F.col("__n")) <= last)
    part = F.when(has_low, F.col("__v") * (1 - share)).otherwise(0.0) + F.when(has_high, F.col("__v") * share).otherwise(0.0)
    return wanted.filter(has_low | has_high).groupBy(*by, "q").agg(F.sum(part).alias(column))


def index_axis_at_pos(data: Column, shape: tuple[int, ...], axis: int, pos: int) -> Column:
    """The flattened slice of a flattened array at a position of an axis; positions may count from the end."""
    axis, pos = axis % len(shape), pos % shape[axis % len(shape)]
    inner = math.prod(shape[axis + 1 :])
    outer = math.prod(shape[:axis])
    starts = [o * shape[axis] * inner + pos * inner for o in range(outer)]
    return F.flatten(F.array(*[F.slice(data, s + 1, inner) for s in starts]))


def add_singleton_axis_beginning(data: Column) -> Column:
    return F.array(data)


def add_singleton_axis_end(data: Column) -> Column:
    return F.transform(data, lambda x: F.array(x))


def squish(data: Column) -> Column:
    """Two levels of nesting as one."""
    return F.flatten(data)


def unsquish(data: Column, width: int) -> Column:
    """A flat array as rows of the given width."""
    rows = F.floor(F.size(data) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(rows - 1, F.lit(0))), lambda r: F.slice(data, r * width + 1, F.lit(width)))


def _extreme(data: Column, largest: bool, skip_nan: bool) -> Column:
    """struct(value, index) of least or largest magnitude, the first of equals; NaN wins unless skipped."""
    numbered = F.transform(data, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    if skip_nan:
        numbered = F.filter(numbered, lambda s: ~F.isnan(s["value"]))

    def better(a: Column, s: Column) -> Column:
        beats = F.abs(s["value"]) > F.abs(a["value"]) if largest else F.abs(s["value"]) < F.abs(a["value"])
        return F.when(~F.isnan(a["value"]) & (F.isnan(s["value"]) | (beats & ~F.isnan(s["value"]))), s).otherwise(a)

    return F.when(F.size(numbered) > 0, F.aggregate(F.slice(numbered, 2, F.greatest(F.size(numbered) - 1, F.lit(0))), numbered[0], better))


def min_abs(data: Column) -> Column:
    return _extreme(data, False, False)


def max_abs(data: Column) -> Column:
    return _extreme(data, True, False)


def nanmin_abs(data: Column) -> Column:
    return _extreme(data, False, True)


def nanmax_abs(data: Column) -> Column:
    return _extreme(data, True, True)


def contains(data: Column, to_contain: list) -> Column:
    """Membership of each element."""
    return F.transform(data, lambda x: x.isin(*to_contain) if to_contain else F.lit(False))


def index_array_to_bool_array(indices: Column, size: int) -> Column:
    """A mask of the given size, true at the indices."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(indices, i))


def expand_arange(start: int, stop: int, step: int = 1, reps_before: int = 1, reps_after: int = 1) -> Column:
    """A range whose elements repeat reps_after times each, the whole reps_before times."""
    each = F.array(*[F.lit(v) for v in range(start, stop, step)]) if range(start, stop, step) else F.array().cast("array<int>")
    once = F.flatten(F.transform(each, lambda v: F.array_repeat(v, reps_after)))
    return F.flatten(F.array_repeat(once, reps_before))


def line_filter(shape: tuple[int, ...], dim: int = -1) -> list[tuple[int, ...]]:
    """Offsets of a line along an axis, for half sizes of each axis."""
    dim %= len(shape)
    return [tuple(k if a == dim else 0 for a in range(len(shape))) for k in range(-shape[dim], shape[dim] + 1)]


def symmetric_line_filter(size: int, ndims: int = 2, dim: int = -1) -> list[tuple[int, ...]]:
    return line_filter((size,) * ndims, dim)


def tagging_reorder(df: DataFrame, from_order: str, to_order: str) -> DataFrame:
    """Axis columns named by single letters, put in another order; axes that are missing get index 0."""
    if sorted(set(to_order)) != sorted(to_order):
        raise ValueError("an axis is named twice")
    rest = [c for c in df.columns if c not in from_order]
    return df.select(*[F.col(a) if a in from_order else F.lit(0).cast("bigint").alias(a) for a in to_order], *rest)
