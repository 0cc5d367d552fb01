"""Named tables below a path: recorders of intermediate results, and masked stacks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class Recorder:
    """Tables by name. Storing an empty one is an error; an existing name is one too, unless overwriting."""

    def __init__(self, spark: SparkSession, root: str, overwrite: bool = False):
        self.spark, self.root, self.overwrite = spark, root.rstrip("/"), overwrite

    def __bool__(self) -> bool:
        return True

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def group(self, key: str) -> "Recorder":
        return type(self)(self.spark, self.path(key), self.overwrite)

    def get(self, key: str, default: DataFrame | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(key))
        except AnalysisException:
            return default

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str) -> DataFrame:
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key: str, value: DataFrame) -> None:
        if value.isEmpty():
            raise ValueError(f"{key} has no rows")
        value.write.mode("overwrite" if self.overwrite else "error").parquet(self.path(key))


class EnumeratedRecorder(Recorder):
    """Each table stored under a name is kept, numbered; reading gives the last."""

    def __setitem__(self, key: str, value: DataFrame) -> None:
        if value.isEmpty():
            raise ValueError(f"{key} has no rows")
        last = self.get(key)
        n = 0 if last is None else last.agg(F.max("__n")).first()[0] + 1
        value.withColumn("__n", F.lit(n)).write.mode("append").partitionBy("__n").parquet(self.path(key))

    def __getitem__(self, key: str) -> DataFrame:
        everything = super().__getitem__(key)
        n = everything.agg(F.max("__n")).first()[0]
        return everything.filter(F.col("__n") == n).drop("__n")


class NullRecorder:
    """Takes everything, keeps nothing."""

    def __bool__(self) -> bool:
        return False

    def group(self, key: str) -> "NullRecorder":
        return self

    def get(self, key: str, default=None):
        return default

    def __contains__(self, key: str) -> bool:
        return False

    def __getitem__(self, key: str):
        raise KeyError(key)

    def __setitem__(self, key: str, value: DataFrame) -> None:
        if value.isEmpty():
            raise ValueError(f"{key} has no rows")


def recorder(spark: SparkSession, root: str | None, enable: bool = True, overwrite: bool = False, enumerated: bool = False):
    if not enable or root is None:
        return NullRecorder()
    return (EnumeratedRecorder if enumerated else Recorder)(spark, root, overwrite)


def write_masked(pixels: DataFrame, path: str, fill_value: float, overwrite: bool = False) -> None:
    """Pixels with `masked`, by blocks of time, with their fill value in a column that compresses to nothing."""
    blocked = pixels.withColumns({"fill_value": F.lit(float(fill_value)), "t_block": F.expr("t div 1000")})
    blocked.write.mode("overwrite" if overwrite else "error").partitionBy("t_block").parquet(path)


def read_masked(spark: SparkSession, path: str, t: tuple[int, int] | None = None, filled: bool = False) -> DataFrame:
    """Pixels of a range of times, which prunes blocks and row groups; filled puts the fill value where masked."""
    rows = spark.read.parquet(path)
    if t is not None:
        rows = rows.filter(F.col("t_block").between(t[0] // 1000, (t[1] - 1) // 1000) & (F.col("t") >= t[0]) & (F.col("t") < t[1]))
    value = F.when(F.col("masked"), F.col("fill_value")).otherwise(F.col("v")) if filled else F.col("v")
    return rows.select("t", "y", "x", value.alias("v"), "masked")


def assign(pixels: DataFrame, update: DataFrame) -> DataFrame:
    """Pixels with those of an update in place of their own."""
    return pixels.join(update, ["t", "y", "x"], "left_anti").unionByName(update.select(pixels.columns))


def resized(pixels: DataFrame, before: tuple[int, int, int], after: tuple[int, int, int]) -> DataFrame:
    """The pixels (t, y, x, v, masked) of a stack whose sizes change: those outside the new sizes go, new ones are 0 and not masked.

    Only new pixels are made, as up to three boxes of them: later times, then further rows, then further columns of what was there.
    """
    kept = pixels
    for axis, n in zip(("t", "y", "x"), after):
        kept = kept.filter(F.col(axis) < n)
    spark = pixels.sparkSession
    for axis in range(3):
        low = [before[k] if k == axis else 0 for k in range(3)]
        high = [min(before[k], after[k]) if k < axis else after[k] for k in range(3)]
        sizes = [max(0, b - a) for a, b in zip(low, high)]
        cells = spark.range(sizes[0] * sizes[1] * sizes[2])
        if sizes[0] * sizes[1] * sizes[2]:
            at = {"t": F.expr(f"id div {sizes[1] * sizes[2]}"), "y": F.expr(f"id div {sizes[2]} % {sizes[1]}"), "x": F.expr(f"id % {sizes[2]}")}
            new = cells.select(*[(c + start).cast("bigint").alias(a) for (a, c), start in zip(at.items(), low)], F.lit(0.0).alias("v"), F.lit(False).alias("masked"))
            kept = kept.unionByName(new)
    return kept
