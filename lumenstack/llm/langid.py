"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
largest response, and a softmax turns those into probabilities. The network is trained in numpy on a
bounded sample of labelled text and applied to every window of every whole text; a document's
probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenstack.llm.textbatch import by_bytes, byte_buffer, spare, tidy, with_columns

UNDETERMINED = "und"
PAD = 256
#: Windows that go through the network at once, so that its intermediate arrays stay in cache.
AT_ONCE = 32


@dataclass
class ByteConvNet:
    """langs: the class names. embed: a row for each byte and padding. filters: a column for each filter, zero beyond its width."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int = 256

    @property
    def reach(self) -> int:
        return self.filters.shape[0] // self.embed.shape[1]

    def stacked(self, ids: np.ndarray) -> np.ndarray:
        """[windows, positions, reach * dims]: each position with the bytes that follow it."""
        x = self.embed[ids]
        n = ids.shape[1] - self.reach + 1
        return np.concatenate([x[:, k : k + n] for k in range(self.reach)], axis=2)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        x = self.stacked(ids)
        return (x.reshape(-1, x.shape[2]) @ self.filters).reshape(x.shape[0], x.shape[1], -1).max(axis=1) + self.bias

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """[windows, langs] for windows of byte ids, padded by PAD."""
        parts = [np.zeros((0, len(self.langs)))]
        for k in range(0, len(ids), AT_ONCE):
            parts.append(softmax(np.maximum(self.pooled(ids[k : k + AT_ONCE]), 0) @ self.out + self.out_bias))
        return np.concatenate(parts)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(flat: np.ndarray, ends: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat padded, start, length, document) of the windows that cover each text from first to last byte."""
    sizes = np.diff(ends)
    counts = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = ends[:-1][doc] + nth * window
    return np.concatenate([flat.astype(np.int16), np.full(window + reach, PAD, np.int16)]), start, np.minimum(window, ends[1:][doc] - start), doc


def window_ids(padded: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, reach: int) -> np.ndarray:
    at = np.arange(window + reach - 1)
    ids = padded[start[:, None] + at]
    ids[at >= length[:, None]] = PAD
    return ids


def train(texts: list[bytes], labels: list[str], widths=(2, 3, 4), per_width=16, dims=8, window=256, epochs=8, batch=64, rate=4e-3, seed=7) -> ByteConvNet:
    """Adam on the cross-entropy of windows; every window has its text's label. Half of the windows are cut short at random, as short texts are."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    reach, n_filters = max(widths), per_width * len(widths)
    net = ByteConvNet(
        langs,
        rng.normal(0, 0.5, (257, dims)).astype(np.float32),
        rng.normal(0, 0.2, (reach * dims, n_filters)).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
        window,
    )
    net.embed[PAD] = 0
    mask = np.zeros_like(net.filters)
    for k, w in enumerate(widths):
        mask[: w * dims, k * per_width : (k + 1) * per_width] = 1
    net.filters *= mask
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    padded, start, length, doc = cut_windows(np.frombuffer(b"".join(texts), np.uint8), ends, window, reach)
    truth = np.array([langs.index(x) for x in labels])[doc] if len(doc) else np.zeros(0, int)
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(start))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            cut = np.where(rng.random(len(some)) < 0.5, length[some], rng.integers(1, length[some] + 1))
            ids = window_ids(padded, start[some], cut, window, reach)
            x = net.stacked(ids)
            raw = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(*x.shape[:2], -1)
            best = raw.argmax(axis=1)
            pooled = np.take_along_axis(raw, best[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            error = softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(some)), truth[some]] -= 1
            error /= len(some)
            back = (error @ net.out.T) * (pooled > 0)
            seen = x[np.arange(len(some))[:, None], best]
            to_filters = np.einsum("bf,bfd->df", back, seen) * mask
            to_seen = back[:, :, None] * net.filters.T[None]
            to_embed = np.zeros_like(net.embed)
            places = best[:, :, None] + np.arange(reach)
            np.add.at(to_embed, ids[np.arange(len(some))[:, None, None], places], to_seen.reshape(len(some), n_filters, reach, dims))
            to_embed[PAD] = 0
            step += 1
            pace = rate * min(1.0, 2 * (1 - epoch / epochs))
            for p, g, m, v in zip(params, [to_embed, to_filters, back.sum(0), hidden.T @ error, error.sum(0)], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def passages(docs: DataFrame, per_lang: int, chars: int, seed: int, text_col: str, lang_col: str, id_col: str) -> list[tuple[str, int, str]]:
    """(language, hash, passage) of at most per_lang texts of each language, the first by a seeded hash.

    Languages are ranked in slices of the hash, so that no task gets the whole of a common one; a rare one gives
    what its slices have.
    """
    slices = 16
    place = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.greatest(F.char_length(text_col) - chars + 1, F.lit(1)))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    ranked = labelled.select(
        F.col(lang_col).alias("label"),
        F.substring(F.col(text_col), (place + 1).cast("int"), F.lit(chars)).alias("passage"),
        F.xxhash64(id_col, F.lit(seed + 1)).alias("h"),
    ).withColumn("nth", F.row_number().over(W.partitionBy("label", F.pmod("h", F.lit(slices))).orderBy("h", "passage")))
    return sorted((r.label, r.h, r.passage) for r in ranked.filter(F.col("nth") <= max(1, per_lang // slices)).collect())


def fit(docs: DataFrame, per_lang: int = 1000, chars: int = 768, seed: int = 42, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **training) -> ByteConvNet | None:
    """Train on at most per_lang texts of each language (the first by a seeded hash), a passage of at most chars characters each.

    Rows whose language or text is null, or whose text has no letter, are left out; without any row left there is no model
    (None).
    """
    rows = passages(docs, per_lang, chars, seed, text_col, lang_col, id_col)
    model = train([r[2].encode() for r in rows], [r[0] for r in rows], **training) if rows else None
    spare()
    return model


def bar(scores: np.ndarray, right: np.ndarray) -> float:
    """The score up to which rejection is most often right more than it is wrong; 0 if that is within twice the deviation of chance."""
    order = np.argsort(scores, kind="stable")
    scores, right = scores[order], right[order]
    gain = np.where(np.r_[scores[1:] != scores[:-1], True][: len(scores)], np.cumsum(np.where(right, -1, 1)), -len(scores))
    k = int(gain.argmax()) if len(gain) else 0
    return float(scores[k]) if len(gain) and gain[k] >= 2 * np.sqrt(k + 1) else 0.0


def fit_bar(docs: DataFrame, model: ByteConvNet, per_lang: int = 1000, chars: int = 768, seed: int = 1042, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> float:
    """The score up to which the model's predictions are not to be trusted, from another sample than fit's (they share texts where there are few)."""
    rows = passages(docs, per_lang, chars, seed, text_col, lang_col, id_col)
    if not rows:
        return 0.0
    names, scores = classify(model, pa.array([r[2] for r in rows], pa.string()))
    return bar(scores, names == np.array([r[0] for r in rows], object))


def classify(model: ByteConvNet, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text by the mean of its windows."""
    flat, ends = byte_buffer(texts)
    padded, start, length, doc = cut_windows(flat, ends, model.window, model.reach)
    total = np.zeros((len(texts), len(model.langs)))
    for k in range(0, len(start), 4096):
        some = slice(k, k + 4096)
        p = model.probabilities(window_ids(padded, start[some], length[some], model.window, model.reach))
        for c in range(p.shape[1]):
            total[:, c] += np.bincount(doc[some], p[:, c] * length[some], len(texts))
    mean = total / np.maximum(np.diff(ends), 1)[:, None]
    best = mean.argmax(axis=1)
    return np.array(model.langs, object)[best], np.clip(mean[np.arange(len(texts)), best], 0, 1)


def predict(docs: DataFrame, model: ByteConvNet | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, unless named), lang_pred and score.

    Null texts and texts without a letter, and every text without a model, are undetermined with score 0.
    Columns of docs that are named lang_pred or score give way. Empty tables stay empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*keep, F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(lambda batches: _predict(batches, model, keep), f"{fields}, lang_pred string, score double")


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: ByteConvNet | None, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__text", 4_000_000):
        letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
        names, score = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
        if model is not None and letters.any():
            best, found = classify(model, batch.column("__text"))
            names[letters], score[letters] = best[letters], found[letters]
        yield with_columns(batch, keep, lang_pred=pa.array(names, pa.string()), score=pa.array(score))
