"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of the text's bytes, A-Z in lower case. Its value is its
log-count ratio, log((p + a) / |p|) - log((q + a) / |q|) over texts labelled 1 and 0; a logistic
regression over these values weighs them. Only n-grams whose ratio stands out of its sampling error
are kept, so that long texts do not drown in noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenstack.llm.textbatch import byte_buffer, with_columns

ORDERS, BITS = (3, 4, 5, 6), 20
#: The multiplier and mixer of the n-gram hash: any odd numbers serve.
STEP, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@dataclass
class NgramClassifier:
    """index: the kept features' number by hash, -1 elsewhere. weights: log-count ratio times learned weight."""

    index: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        doc, feature = kept_features(flat, ends, self.index)
        z = np.bincount(doc, self.weights[feature], len(ends) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def hashes(flat: np.ndarray, order: int) -> np.ndarray:
    """A hash of BITS bits of each run of `order` bytes; runs of different order hash apart."""
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint32) + np.uint32(1)
    n = max(0, len(flat) - order + 1)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = h * STEP + low[k : k + n]
    h ^= h >> np.uint32(15)
    h *= MIX
    return h >> np.uint32(32 - BITS)


def kept_features(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each kept feature that a text has, once each; n-grams never cross texts."""
    found, width = [np.zeros(0, np.int64)], max(1, int(index.max()) + 1)
    for order in ORDERS:
        feature = index[hashes(flat, order)]
        at = np.flatnonzero(feature >= 0)
        doc = np.searchsorted(ends, at, "right") - 1
        inside = at + order <= ends[doc + 1]
        found.append(np.unique(doc[inside] * width + feature[at[inside]]))
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


def train(texts: list[bytes], labels: list[int], smoothing=1.0, least_docs=5, stand_out=4.0, most_features=1 << 15, penalty=1e-3, steps=300) -> NgramClassifier:
    y = np.array(labels, float)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    counts = np.zeros((2, 1 << BITS))
    for k in range(0, len(texts), 500):  # in slices, so that the arrays stay small
        part = ends[k : k + 501]
        flat = np.frombuffer(b"".join(texts[k : k + 500]), np.uint8)
        for order in ORDERS:
            h = hashes(flat, order).astype(np.int64)
            doc = np.searchsorted(part - part[0], np.arange(len(h)), "right") - 1
            pairs = np.unique((doc << BITS | h)[np.arange(len(h)) + order <= (part - part[0])[doc + 1]])
            for label in (0, 1):
                counts[label] += np.bincount(pairs[y[k + (pairs >> BITS)] == label] & ((1 << BITS) - 1), minlength=1 << BITS)
    q, p = counts
    n_texts = np.array([(y == 0).sum(), (y == 1).sum()], float)
    ratio = np.log((p + smoothing) / (n_texts[1] + 2 * smoothing)) - np.log((q + smoothing) / (n_texts[0] + 2 * smoothing))
    deviation = np.sqrt(1 / (p + smoothing) + 1 / (q + smoothing))
    strength = np.where(p + q >= least_docs, np.abs(ratio) / deviation, 0)
    best = np.argsort(-strength, kind="stable")[:most_features]
    best = best[strength[best] >= stand_out]
    index = np.full(1 << BITS, -1, np.int32)
    index[best] = np.arange(len(best))
    r = ratio[best]
    doc, feature = kept_features(np.frombuffer(b"".join(texts), np.uint8), ends, index)
    weights, bias, step = np.ones(len(best)), float(np.log((n_texts[1] + 1) / (n_texts[0] + 1))), 0
    first, second = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for step in range(1, steps + 1):  # Adam over all texts: the logistic loss, held towards the plain ratios
        z = np.bincount(doc, (r * weights)[feature], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / max(1, len(y))
        g = np.append(r * np.bincount(feature, error[doc], len(best)) + penalty * weights, error.sum())
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return NgramClassifier(index, r * weights, bias)


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = 2000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **training
) -> NgramClassifier | None:
    """Train on at most per_label whole texts of each label, the first by a seeded hash of their id.

    The sample is drawn from the labels alone, in slices of the hash so that no task ranks a whole label, and is
    small enough to broadcast: only its texts leave the documents. Null texts count as empty, null ids and
    labels are left out; without both labels there is no model (None).
    """
    slices = 16
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col, F.lit(seed)).alias("h")
    )
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("label", F.pmod("h", F.lit(slices))).orderBy("h", "id")))
    chosen = F.broadcast(rows.filter(F.col("nth") <= max(1, per_label // slices)).drop("nth"))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, "id")
    sample = sorted((r.h, r.label, r.text) for r in found.select("h", "label", "text").collect())
    if len({label for _, label, _ in sample}) < 2:
        return None
    return train([t.encode() for _, _, t in sample], [label for _, label, _ in sample], **training)


def score(docs: DataFrame, model: NgramClassifier | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, unless named), score (0 to 1) and predicted (1 from 0.5 on).

    Null texts score as empty ones: by the bias alone; without a model all score 0. Columns of docs named
    score or predicted give way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    return source.mapInArrow(lambda batches: _score(batches, model, keep), f"{fields}, score double, predicted int")


def _score(batches: Iterator[pa.RecordBatch], model: NgramClassifier | None, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, ends = byte_buffer(batch.column("__text"))
        value = np.zeros(len(batch))
        first = 0
        while model is not None and first < len(batch):  # by about 2 MB of text
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + 2_000_000, "right")) - 1)
            value[first:last] = model.scores(flat[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            first = last
        yield with_columns(batch, keep, score=pa.array(value), predicted=pa.array((value >= 0.5).astype(np.int32)))
