"""Dictionary learning: frames as sparse, non-negative mixtures of a few atoms.

The atoms are small and live on the driver; the frames never leave the executors. A round codes every
frame against the atoms of its stack (non-negative lasso by accelerated proximal gradient, in numpy over Arrow
batches), adds up the statistics A = sum a a' and B = sum x a' per partition, sums those in two steps, a row for each atom, and updates the atoms from
their totals by block coordinates. Many stacks of one frame size learn in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def sparse_codes(x: np.ndarray, atoms: np.ndarray, penalty: float, positive: bool = True, tolerance: float = 1e-7) -> np.ndarray:
    """[frames, atoms] that minimise |x - a atoms|^2 / 2 + penalty |a|_1, until no code moves by more than the tolerance of the largest.

    The momentum starts anew for a frame whose steps turn against it.
    """
    gram, target = atoms @ atoms.T, x @ atoms.T
    rate = 1 / max(np.linalg.norm(gram, 2), 1e-12)
    a = y = np.zeros_like(target)
    momentum = np.ones((len(x), 1))
    while True:
        new = y - rate * (y @ gram - target)
        new = np.maximum(new - rate * penalty, 0) if positive else np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        moved = new - a
        if not a.size or np.abs(moved).max() <= tolerance * max(np.abs(new).max(), 1e-12):
            return new
        momentum = np.where(((y - new) * moved).sum(1, keepdims=True) > 0, 1.0, momentum)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, a, momentum = new + (momentum - 1) / following * moved, new, following


def _statistics(batches: Iterator[pa.RecordBatch], atoms: np.ndarray, penalty: float, positive: bool) -> Iterator[pa.RecordBatch]:
    """A row for each stack that the partition holds and each of its atoms: the atom's row of A and of B."""
    _, k, d = atoms.shape
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        x = batch.column("data").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), d)
        stacks = batch.column("stack").to_numpy()
        for s in np.unique(stacks).tolist():
            own = x[stacks == s]
            codes = sparse_codes(own, atoms[s], penalty, positive)
            sums[s] = sums.get(s, 0) + np.concatenate([codes.T @ codes, codes.T @ own], axis=1)
    for s, total in sums.items():
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * (k + d)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([s] * k, pa.int64()), pa.array(np.arange(k)), lists], names=["stack", "k", "sums"])


def _added(table: pa.Table) -> pa.Table:
    """The sums of a group of rows of one atom."""
    lists = table.column("sums").combine_chunks()
    total = lists.flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
    return pa.table({"stack": table.column("stack").slice(0, 1), "k": table.column("k").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})


def initial_atoms(frames: DataFrame, n_components: int, seed: int = 42, stacks: int = 1) -> np.ndarray:
    """[stacks, n_components, pixels]: frames of each stack chosen by a seeded hash, repeated if there are too few."""
    first = F.min_by(F.struct("data"), F.struct(F.xxhash64("t", F.lit(seed)), "t"))
    if stacks == 1:
        rows = {0: [r.data for r in frames.select("t", "data").orderBy(F.xxhash64("t", F.lit(seed)), "t").limit(n_components).collect()]}
    else:
        buckets = F.pmod(F.xxhash64("t", F.lit(seed + 1)), F.lit(n_components))
        rows = {}
        for r in frames.groupBy("stack", buckets.alias("b")).agg(first.alias("f")).collect():  # an atom each
            rows.setdefault(r.stack, []).append(r.f.data)
    if not all(rows.get(s) for s in range(stacks)):
        raise ValueError("no frames")
    return np.array([[rows[s][k % len(rows[s])] for k in range(n_components)] for s in range(stacks)], float)


def generate_dictionaries(
    frames: DataFrame, n_components: int, penalty: float = 0.2, n_iter: int = 20, positive_codes: bool = True, positive_atoms: bool = True, initial: np.ndarray | None = None, seed: int = 42, stacks: int = 1
) -> np.ndarray:
    """[stacks, n_components, pixels] atoms of norm at most 1. Frames of several stacks say in a column `stack`, from 0, to which they belong."""
    atoms = initial_atoms(frames, n_components, seed, stacks) if initial is None else np.array(initial, float)
    if atoms.shape[1] != n_components:
        raise ValueError("the initial dictionary must have n_components atoms")
    atoms = _projected(atoms, positive_atoms)
    _, k, d = atoms.shape
    data = frames.select(F.col("stack").cast("bigint").alias("stack") if "stack" in frames.columns else F.lit(0).cast("bigint").alias("stack"), "data")
    schema = "stack bigint, k bigint, sums array<double>"
    for _ in range(n_iter):
        fixed = atoms.copy()
        parts = data.mapInArrow(lambda b, fixed=fixed: _statistics(b, fixed, penalty, positive_codes), schema)
        some = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("stack", "k", "part").applyInArrow(_added, schema)
        totals = np.zeros((len(atoms), k, k + d))
        for row in some.groupBy("stack", "k").applyInArrow(_added, schema).toLocalIterator():  # a row for each atom
            totals[row.stack, row.k] = row.sums
        for own, total in zip(atoms, totals):
            a, b = total[:, :k], total[:, k:]
            for j in range(k):
                if a[j, j] > 1e-12:
                    own[j] = _projected(own[j] + (b[j] - a[j] @ own) / a[j, j], positive_atoms)
    return atoms


def generate_dictionary(frames: DataFrame, n_components: int, initial: np.ndarray | None = None, **options) -> np.ndarray:
    """[n_components, pixels] atoms of one stack."""
    first = None if initial is None else np.array(initial, float)[None]
    if first is not None and first.shape[1] != n_components:
        raise ValueError("the initial dictionary must have n_components atoms")
    return generate_dictionaries(frames.drop("stack"), n_components, initial=first, **options)[0]


def _projected(atoms: np.ndarray, positive: bool) -> np.ndarray:
    atoms = np.maximum(atoms, 0) if positive else atoms
    return atoms / np.maximum(np.linalg.norm(atoms, axis=-1, keepdims=True), 1.0)
