"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned onto principal axes (fitted on a bounded sample; any orthonormal axes keep
distances). A cosine of at least s is a distance of at most eps = sqrt(2 - 2 s), so linked vectors lie in
the same or adjacent cells of a grid of width eps on the leading axes. Sorted by their cells, vectors form
sequences; a join of two sequences halves the longer one, again and again, skips halves whose boxes are
further apart than eps, and compares what is left by the cosine itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenstack.llm.components import Forest, connected_components, stored

#: Leading axes of the grid, of which the first two deal the rows out, and the rows at which halving ends.
AXES, DEALT, LEAF = 6, 2, 64
#: Room for rounding in tests that only exclude: the cosine itself decides.
SLACK = 1e-6


def usable(vector_col: str) -> Column:
    """False for null vectors and those with null or non-finite components, or all zero."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """[dims, AXES] orthonormal columns, by falling variance."""
    if not len(vectors):
        return np.zeros((0, AXES))
    _, _, axes = np.linalg.svd(vectors - vectors.mean(axis=0), full_matrices=True)
    return axes[:AXES].T


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines between two blocks, in double precision."""
    return unit(a) @ unit(b).T


def _placed(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    """Rows with their grid cell; a copy goes to each adjacent cell of the dealing axes on one side, to meet the rows there."""
    steps = [(i, j) for i in (0, 1) for j in (-1, 0, 1) if (i, j) > (0, -1)]  # the cell itself and half of its neighbours
    for batch in batches:
        lists = batch.column("v")
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        starts = np.r_[0, np.cumsum(sizes)]
        label, node, copies = (batch.column(k).to_numpy() for k in ("label", "node", "copies"))
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            v = flat[starts[rows][:, None] + np.arange(dims)]
            along = unit(v) @ axes[int(dims)] if int(dims) in axes else np.zeros((len(v), AXES))
            cell = np.floor((along + 2) / eps).astype(np.int64)
            for n, (i, j) in enumerate(steps):
                columns = [label[rows], np.full(len(rows), dims), cell[:, 0] + i, (cell[:, 1] if cell.shape[1] > 1 else 0 * cell[:, 0]) + j]
                arrays = [pa.array(x, pa.int64()) for x in (*columns, np.full(len(rows), int(n > 0)), node[rows], copies[rows])]
                yield pa.RecordBatch.from_arrays([*arrays, lists.take(pa.array(rows)), pa.array(along.tolist(), pa.list_(pa.float64()))], names=_PLACED)


_PLACED = ["label", "dims", "c0", "c1", "guest", "node", "copies", "v", "along"]


def ego_join(a: tuple, b: tuple, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of two sequences (along, v) in grid order that may be within eps, as blocks of row numbers."""
    stack = [(0, len(a[0]), 0, len(b[0]))]
    while stack:
        i, j, k, m = stack.pop()
        if j <= i or m <= k or same and m <= i:
            continue
        x, y = a[0][i:j], b[0][k:m]
        gap = np.maximum(0, np.maximum(y.min(axis=0) - x.max(axis=0), x.min(axis=0) - y.max(axis=0)))
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield np.arange(i, j), np.arange(k, m)
        elif j - i >= m - k:
            half = (i + j) // 2
            stack += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            stack += [(i, j, k, half), (i, j, half, m)]


def _links(batches: Iterator[pa.RecordBatch], least: float, eps: float) -> Iterator[pa.RecordBatch]:
    """The links of each cell: among its own rows, and between them and its guests. Batches come sorted by cell."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([table.column(k).to_numpy() for k in _PLACED[:4]], axis=1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for i, j in zip(np.r_[0, ends[:-1]], ends) if len(ends) else []:
            yield from _cell_links(table.slice(i, j - i).combine_chunks(), least, eps)
        held = table.slice(ends[-1] if len(ends) else 0).combine_chunks()
    if held is not None:
        yield from _cell_links(held, least, eps)


def _cell_links(table: pa.Table, least: float, eps: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, linked): with b, edges that connect what is linked; without, how many other rows the class a is linked to."""
    guest, node, copies = (table.column(k).to_numpy() for k in ("guest", "node", "copies"))
    if len(node) < 2 or guest.all():
        return
    dims = int(table.column("dims")[0].as_py())
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(node), dims)
    along = table.column("along").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    order = np.lexsort([*np.floor((along[:, ::-1] + 2) / eps).T, guest])
    node, copies, v, along = node[order], copies[order], v[order], along[order]
    own = int((guest == 0).sum())
    mine = (along[:own], v[:own])
    forest, edges, linked = Forest(len(node)), ([], []), np.zeros(len(node), np.int64)
    for rows, others, offset, same in ((mine, mine, 0, True), (mine, (along[own:], v[own:]), own, False)):
        for r, c in ego_join(rows, others, eps, same):
            close = cosines(rows[1][r], others[1][c]) >= least
            if same:
                close &= r[:, None] < c[None]
            linked[r] += close @ copies[c + offset]
            linked[c + offset] += copies[r] @ close
            x, y = np.nonzero(close)
            for found, kept in zip(edges, forest.join(r[x], c[y] + offset)):
                found += kept
    some = np.flatnonzero(linked)
    a, b = np.r_[node[some], node[np.array(edges[0], int)]], [None] * len(some) + node[np.array(edges[1], int)].tolist()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(np.r_[linked[some], np.zeros(len(edges[0]), int)])], names=["a", "b", "linked"])


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = 4096
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked directly), component_id, kept (vec_id = component_id).

    Rows link if their labels are equal and not null and their cosine is at least `least`; vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different lengths, link with nothing. Equal
    vectors of a label count as one class in the join, whatever their number. The axes are fitted on `sample`
    vectors. A row whose id is null counts where an equal vector has an id, and its component is then named by that one; without such a vector it
    links with nothing (n_links 0, no component). It is never kept.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) or 1e-3
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("joins", F.col("label").isNotNull() & usable("v")).withColumn("digest", F.when(F.col("joins"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))
    classes = rows.filter("joins").groupBy("digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("node"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(spark, classes, "vectors").filter(F.col("node").isNotNull())
    by_size: dict[int, list] = {}
    for r in classes.select("v").orderBy(F.xxhash64("digest")).limit(sample).collect():
        by_size.setdefault(len(r.v), []).append(r.v)
    axes = {dims: principal_axes(unit(np.array(found))) for dims, found in by_size.items()}
    fields = "label bigint, dims bigint, c0 bigint, c1 bigint, guest bigint, node bigint, copies bigint, v array<double>, along array<double>"
    placed = classes.select("label", "node", "copies", "v").mapInArrow(lambda batches: _placed(batches, axes, eps), fields)
    cells = placed.repartition("label", "dims", "c0", "c1").sortWithinPartitions("label", "dims", "c0", "c1")
    links = stored(spark, cells.mapInArrow(lambda batches: _links(batches, least, eps), "a bigint, b bigint, linked bigint"), "links")
    linked = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    found = connected_components(links.filter(F.col("b").isNotNull()))
    about = classes.select("digest", "node", "copies").join(linked, "node", "left").join(found, "node", "left").select(
        "digest", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    result = rows.select("vec_id", "digest").join(about, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
