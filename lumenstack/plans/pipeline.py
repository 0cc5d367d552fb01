"""From a configuration to a plan: preprocessing, dictionary, postprocessing, with stages that can be resumed, whole or in blocks."""

from __future__ import annotations

import logging
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lumenstack import model
from lumenstack.operators import dictionary, filters, neurons, renorm, segmentation, traces
from lumenstack.sources.store import NullRecorder

STAGES = ("preprocessing", "dictionary", "postprocessing")
log = logging.getLogger(__name__)


def _options(parameters: dict, known: dict[str, str], where: str) -> dict:
    for name in parameters.keys() - known.keys():
        log.warning("%s: unknown parameter %s", where, name)
    return {known[k]: v for k, v in parameters.items() if k in known}


def preprocess_data(frames: DataFrame, shape: tuple[int, ...], length: int, parameters: dict) -> DataFrame:
    """Frames after the steps whose keys are present: zeroed lines, background, wavelet; normalisation always.

    t counts the frames of stacks of the given length one after another: t div length is the stack. Stacks don't touch each other.
    """
    names = model.axes(len(shape))
    sizes = {"t": length, **dict(zip(names, shape))}
    pixels = None

    def by_stack() -> DataFrame:
        flat = model.to_pixels(frames, len(shape)) if pixels is None else pixels
        return flat.withColumns({"stack": F.expr(f"t div {length}"), "t": F.col("t") % length})

    def joined(flat: DataFrame) -> DataFrame:
        return flat.withColumn("t", F.col("stack") * length + F.col("t")).drop("stack")

    if "remove_zeroed_lines" in parameters:
        given = parameters["remove_zeroed_lines"]
        pixels = segmentation.fill_zeroed_regions(model.to_pixels(frames, len(shape)), shape, given["erosion_shape"], given.get("dilation_shape"))
    if "extract_f0" in parameters:
        known = {
            "bias": "bias", "half_window_size": "half_window_size", "which_quantile": "which_quantile",
            "temporal_smoothing_gaussian_filter_stdev": "temporal_stdev", "spatial_smoothing_gaussian_filter_stdev": "spatial_stdev",
            "temporal_smoothing_gaussian_filter_window_size": "window_size",
            "spatial_smoothing_gaussian_filter_window_size": "spatial_window_size",
        }
        options = _options(parameters["extract_f0"], known, "extract_f0")
        pixels = joined(traces.extract_f0(by_stack(), by=["stack"], sizes=sizes, **options))
    if "wavelet.transform" in parameters:
        scale = parameters["wavelet.transform"]["scale"]
        scales = dict(zip(("t", *names), scale)) if isinstance(scale, list) else {a: scale for a in ("t", *names)}
        pixels = joined(filters.wavelet_transform(by_stack(), scales, sizes))
    stack = frames if pixels is None else model.to_frames(pixels, shape)
    return renorm.normalize_data(stack, parameters.get("normalize_data", {}).get("renormalized_images", {}).get("ord", 2))


def generate_dictionary(frames: DataFrame, shape: tuple[int, ...], parameters: dict, length: int | None = None, stacks: int = 1) -> DataFrame:
    """Atoms as frames, those of a stack after those of the one before. Of two solvers' parameter sets the one that names n_components wins."""
    if "sklearn.decomposition.dict_learning_online" in parameters:
        known = {"n_components": "n_components", "n_iter": "n_iter", "alpha": "penalty"}
        options = _options(parameters["sklearn.decomposition.dict_learning_online"], known | {"batch_size": "", "n_jobs": ""}, "dictionary")
    else:
        known = {"K": "n_components", "iter": "n_iter", "lambda1": "penalty", "posAlpha": "positive_codes", "posD": "positive_atoms"}
        options = _options(parameters["spams.trainDL"], known | {k: "" for k in ("gamma1", "gamma2", "numThreads", "batchsize", "lambda2", "clean", "mode", "modeD")}, "dictionary")
    options.pop("", None)
    options["n_iter"] = int(options.get("n_iter", 20))
    told = frames.withColumn("stack", F.expr(f"t div {length}")) if stacks > 1 else frames
    atoms = dictionary.generate_dictionaries(told, stacks=stacks, **options)
    rows = [(k, list(shape), atom.tolist()) for k, atom in enumerate(atoms.reshape(-1, atoms.shape[-1]))]
    return frames.sparkSession.createDataFrame(rows, model.FRAMES)


def postprocess_data(atoms: DataFrame, shape: tuple[int, ...], parameters: dict, components: int | None = None) -> DataFrame:
    """Neurons of all atoms, those of one atom after another merged into what was found before; with components, apart for every so many atoms (column `stack`)."""
    p = parameters["wavelet_denoising"]
    found = segmentation.wavelet_denoising(
        model.to_pixels(atoms, len(shape)),
        shape,
        wavelet_scale=p["wavelet.transform"]["scale"],
        significance_threshold=p["estimate_noise"]["significance_threshold"],
        noise_threshold=p["significant_mask"]["noise_threshold"],
        accepted_region_shape_constraints=p.get("accepted_region_shape_constraints", {}),
        accepted_neuron_shape_constraints=p.get("accepted_neuron_shape_constraints", {}),
        percentage_pixels_below_max=p["remove_low_intensity_local_maxima"]["percentage_pixels_below_max"],
        min_local_max_distance=p["remove_too_close_local_maxima"]["min_local_max_distance"],
    )
    if components is None:
        return _merge(found, shape, parameters, step="t")
    told = found.withColumns({"stack": F.expr(f"t div {components}"), "atom": F.col("t") % components})
    return _merge(told, shape, parameters, step="atom", apart="stack")


def _merge(found: DataFrame, shape: tuple[int, ...], parameters: dict, **order) -> DataFrame:
    m = parameters["merge_neuron_sets"]
    fraction = m["fuse_neurons"]["fraction_mean_neuron_max_threshold"]
    return neurons.merge_neuron_sets(found, shape, m["alignment_min_threshold"], m["overlap_min_threshold"], fraction, **order)


def generate_neurons(frames: DataFrame, shape: tuple[int, ...], length: int, parameters: dict, store=None) -> DataFrame:
    """The stages in turn. run_stage "" takes what the store has of earlier runs; "all" computes everything; a name ends there."""
    store = NullRecorder() if store is None else store
    stage = parameters.get("run_stage", "all")
    steps = {
        "preprocessing": lambda x: preprocess_data(x, shape, length, parameters["preprocess_data"]),
        "dictionary": lambda x: generate_dictionary(x, shape, parameters["generate_dictionary"]),
        "postprocessing": lambda x: postprocess_data(x, shape, parameters["postprocess_data"]),
    }
    current = frames
    for name in STAGES:
        kept = store.get(name) if stage == "" else None
        if kept is None:
            kept = steps[name](current)
            if store:
                store[name] = kept
                kept = store[name]
            elif name == "preprocessing":
                kept = model.cut(kept)  # the dictionary reads it again and again
        current = kept
        if stage == name:
            break
    return current


def blocks(shape: tuple[int, ...], num_blocks: tuple[int, ...], half_border: tuple[int, ...]) -> list[dict]:
    """Even blocks of a frame: index, own range and range with border, of each axis."""
    out = []
    cuts = [np.linspace(0, n, k + 1).round().astype(int) for n, k in zip(shape, num_blocks)]
    for at in product(*map(range, num_blocks)):
        own = [(int(c[k]), int(c[k + 1])) for c, k in zip(cuts, at)]
        out.append({"block": len(out), "own": own, "with_border": [(max(0, a - b), min(n, e + b)) for (a, e), b, n in zip(own, half_border, shape)]})
    return out


def block_table(extent: tuple[int, ...], block_shape=None, num_blocks=None, half_window=None, half_border=None) -> list[dict]:
    """Blocks of a stack over time and space: for each, by axis, its `own` and its `windowed` range, in the stack's coordinates.

    A border of half_border is left out at each end. Of an axis either the length of blocks or their number is given (the other -1, or both, if
    they agree); with neither, one block spans it. A number must divide the axis; the last block of a given length may be
    shorter. Windows reach half_window (half a block by default) to each side, as far as the border.
    """
    n = len(extent)
    block_shape, num_blocks, half_border = (list(v) if v is not None else [d] * n for v, d in ((block_shape, -1), (num_blocks, -1), (half_border, 0)))
    ranges = []
    for k in range(n):
        pared = extent[k] - 2 * half_border[k]
        if pared <= 0:
            raise ValueError(f"the border takes all of axis {k}")
        size, count = block_shape[k], num_blocks[k]
        if size == count == -1:
            size, count = pared, 1
        elif size == -1:
            if pared % count:
                raise ValueError(f"{count} blocks don't divide axis {k} of {pared}")
            size = pared // count
        elif count == -1:
            count = -(-pared // size)
        elif count != -(-pared // size):
            raise ValueError(f"blocks of {size} are not {count} on axis {k} of {pared}")
        half = size // 2 if half_window is None else half_window[k]
        axis = []
        for i in range(count):
            low, high = i * size, min((i + 1) * size, pared)
            axis.append([(a + half_border[k], e + half_border[k]) for a, e in ((low, high), (max(0, low - half), min(pared, (i + 1) * size + half)))])
        ranges.append(axis)
    return [{"block": b, "own": [r[0] for r in chosen], "windowed": [r[1] for r in chosen]} for b, chosen in enumerate(product(*ranges))]


def cut_blocks(frames: DataFrame, shape: tuple[int, ...], windows: list[list[tuple[int, int]]]) -> DataFrame:
    """Frames of blocks of one size, cut out of the stack's frames where they lie: t counts block after block.

    windows: the range of each block on each axis, time first.
    """
    length, *sizes = [e - a for a, e in windows[0]]
    starts = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(int(a)).alias(f"a{i}") for i, (a, _) in enumerate(w)]) for k, w in enumerate(windows)])
    held = frames.withColumn("b", F.explode(F.filter(starts, lambda b: (F.col("t") >= b["a0"]) & (F.col("t") < b["a0"] + length))))

    def rows(axis: int, before):
        """The flattened part of the block below an index of the axes before."""
        at = before * shape[axis - 1] + F.col(f"b.a{axis}")
        if axis == len(shape):
            return F.slice("data", (at + 1).cast("int"), sizes[-1])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(sizes[axis - 1] - 1)), lambda i: rows(axis + 1, at + i)))

    t = F.col("b.k") * length + F.col("t") - F.col("b.a0")
    return held.select(t.cast("bigint").alias("t"), F.array(*[F.lit(int(n)) for n in sizes]).alias("shape"), rows(1, F.lit(0)).alias("data"))


def generate_neurons_blocks(
    frames: DataFrame, shape: tuple[int, ...], length: int, parameters: dict, block_shape=None, num_blocks=None, half_window=None, half_border=None
) -> DataFrame:
    """Neurons of a stack learned in blocks over time and space, each with a window around it, and merged over their borders.

    See block_table for the blocks; all axes are given, time first. Blocks with windows of one size are stacks of one plan, so there are
    at most three plans an axis, however many blocks. Of a block those neurons count that have more than half of their pixels in the block itself; in the
    coordinates of the stack they are merged into what earlier blocks found. t counts from 0.
    """
    table = block_table((length, *shape), block_shape, num_blocks, half_window, half_border)
    if "extract_f0" in parameters["preprocess_data"] and half_window is not None and parameters["preprocess_data"]["extract_f0"]["half_window_size"] > half_window[0]:
        raise ValueError("the window of the background reaches further than the blocks' windows in time")
    kinds: dict[tuple, list[dict]] = {}
    for b in table:
        kinds.setdefault(tuple(e - a for a, e in b["windowed"]), []).append(b)
    names = model.axes(len(shape))
    found = None
    for (frames_each, *sizes), own in kinds.items():
        sizes = tuple(sizes)
        part = model.cut(preprocess_data(cut_blocks(frames, shape, [b["windowed"] for b in own]), sizes, frames_each, parameters["preprocess_data"]))
        atoms = generate_dictionary(part, sizes, parameters["generate_dictionary"], frames_each, len(own))
        components = atoms.count() // len(own)
        part = postprocess_data(atoms, sizes, parameters["postprocess_data"], components)
        rows = [(k, b["block"], *(a for r in (b["windowed"][1:], b["own"][1:]) for a, _ in r), *(e for _, e in b["own"][1:])) for k, b in enumerate(own)]
        places = frames.sparkSession.createDataFrame(rows, ", ".join(["stack bigint, block bigint", *(f"{p}_{a} bigint" for p in ("at", "from", "to") for a in names)]))
        moved = part.join(F.broadcast(places), "stack").withColumn("pixels", F.transform("pixels", lambda p: F.struct(*[(p[a] + F.col(f"at_{a}")).alias(a) for a in names], p["v"].alias("v"))))

        def inside(p):
            held = F.lit(True)
            for a in names:
                held = held & (p[a] >= F.col(f"from_{a}")) & (p[a] < F.col(f"to_{a}"))
            return held

        mostly = F.size(F.filter("pixels", inside)) > 0.5 * F.size("pixels")
        moved = moved.filter(mostly).select("block", "neuron", "pixels")
        found = moved if found is None else found.unionByName(moved)
    return _merge(found, shape, parameters["postprocess_data"], step="block")
