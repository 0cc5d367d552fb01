"""Physical forms of an image sequence, and conversions.

frames: t BIGINT, shape ARRAY<INT>, data ARRAY<DOUBLE>, a row per frame, pixels in C order.
pixels: t, y, x BIGINT, v DOUBLE [, masked BOOLEAN], a row per pixel: for windows, joins and aggregates.
planes: t, z BIGINT, shape, data: a volume's frames, a row per plane, where a volume is too large for one row.
Volumes have three sizes in shape, and z before y and x in the other forms.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PIXELS = "t bigint, y bigint, x bigint, v double"
FRAMES = "t bigint, shape array<int>, data array<double>"


def frames(df: DataFrame, shape: tuple[int, ...], time_col: str = "t", data_col: str = "data") -> DataFrame:
    """The frame form of rows that hold a flattened image each."""
    return df.select(F.col(time_col).cast("bigint").alias("t"), F.array(*[F.lit(int(n)) for n in shape]).alias("shape"), F.col(data_col).cast("array<double>").alias("data"))


def axes(ndim: int) -> tuple[str, ...]:
    """Names of the axes of an image, the slowest first: (y, x) or (z, y, x)."""
    if not 1 <= ndim <= 3:
        raise ValueError("images have one to three axes")
    return ("z", "y", "x")[-ndim:]


def axes_of(pixels: DataFrame) -> tuple[str, ...]:
    """The image axes among the columns of a pixel form."""
    return tuple(a for a in ("z", "y", "x") if a in pixels.columns)


def places(index: str, sizes: list[str]) -> list[Column]:
    """The coordinates, slowest first, of an index in C order; index and sizes are SQL."""
    steps = [" * ".join(sizes[k + 1 :]) for k in range(len(sizes))]
    return [F.expr(f"cast({index} div ({step}) as bigint) % cast({n} as bigint)" if step else f"cast({index} as bigint) % cast({n} as bigint)") for n, step in zip(sizes, steps)]


def flat_index(names: tuple[str, ...], shape: tuple[int, ...], of=F.col) -> Column:
    """The index in C order of coordinates; `of` makes the column of an axis."""
    at = of(names[0])
    for name, n in zip(names[1:], shape[1:]):
        at = at * int(n) + of(name)
    return at.cast("bigint")


def to_pixels(stack: DataFrame, ndim: int = 2) -> DataFrame:
    """Pixel form of frames of so many dimensions; other columns of the frames are kept."""
    others = [c for c in stack.columns if c not in ("shape", "data")]
    cells = stack.select(*others, F.col("shape").alias("__shape"), F.posexplode("data").alias("__i", "v"))
    named = [c.alias(a) for a, c in zip(axes(ndim), places("__i", [f"__shape[{k}]" for k in range(ndim)]))]
    return cells.select(*others, *named, "v")


def to_frames(pixels: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Frame form of pixels, which must be complete."""
    cells = F.sort_array(F.collect_list(F.struct(flat_index(axes(len(shape)), shape).alias("i"), "v")))
    return pixels.groupBy("t").agg(F.transform(cells, lambda c: c["v"]).alias("data")).select("t", F.array(*[F.lit(int(n)) for n in shape]).alias("shape"), "data")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows with a column more: their place, from 0, in the order of the columns, which should tell rows apart.

    Rows are dealt out by ranges and numbered there; what is known of all ranges at once is their sizes.
    """
    dealt = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    before, total = [], 0
    for row in dealt.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        before.append((row.p, total))
        total += row["count"]
    starts = df.sparkSession.createDataFrame(before, "__p bigint, __before bigint")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__before") + inside).drop("__at", "__p", "__before")


def neuron_schema() -> T.StructType:
    """A component: its mask, contour and image, flattened, with its size, peak and moments."""
    reals, flags = T.ArrayType(T.DoubleType()), T.ArrayType(T.BooleanType())
    return T.StructType(
        [
            T.StructField("neuron", T.LongType()),
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("mask", flags),
            T.StructField("contour", flags),
            T.StructField("image", reals),
            T.StructField("area", T.DoubleType()),
            T.StructField("max_F", T.DoubleType()),
            T.StructField("gaussian_mean", reals),
            T.StructField("gaussian_cov", T.ArrayType(reals)),
            T.StructField("centroid", reals),
        ]
    )


def offsets(df: DataFrame, name: str, values: list) -> DataFrame:
    """Each row once for each value: a literal table exploded in place, so nothing is joined."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. One of our own is set only in local mode; a cluster must name one that all its machines share."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the cluster's checkpoint folder: what follows more than once isn't computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Written:
    """A table in the checkpoint folder. Loops keep their state in one: a checkpoint's size is still reckoned from the plan that made it, and
    where each round joins what the last one left, that number outgrows all memory."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path, self.context = f"{shared_folder(spark).rstrip('/')}/table-{os.urandom(8).hex()}", spark.sparkContext
        df.write.parquet(self.path)
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        """Delete the table, which nothing may read from now on."""
        path = self.context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.context._jsc.hadoopConfiguration()).delete(path, True)
