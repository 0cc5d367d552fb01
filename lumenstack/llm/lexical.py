"""Ranked lexical search: the best documents for each item by the weighted terms they share.

Documents are read once and leave, in a table, their postings: the item terms they hold and how often. Counts over the whole
table give the weights. Then each task searches its own documents in blocks: short lists are summed into accumulators, which stand as one more
list, with a bound, beside the long ones; windows of documents are taken in order, and lists whose bounds cannot lift a document to the present
k-th score are only looked up for documents that the others left over. A task gives its best for each item, and the best of those are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenstack.llm.components import stored
from lumenstack.llm.textbatch import by_bytes, tidy

#: A term: letters and digits of ASCII and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to themselves, capitals to small letters, what separates terms to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Text bytes of a batch, postings of a block, documents of a window, and bytes of item terms that are sought at a time.
BATCH_BYTES, BLOCK_POSTINGS, WINDOW, SLICE_BYTES = 2 << 20, 2_000_000, 2048, 8 << 20
#: Lists of at most one document in so many are short.
SHORT_SHARE = 16


def _terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, term: once each. Rows of one id are one item."""
    folded = F.translate(F.col(text_col), UPPER, LOWER)
    return items.select(F.col(item_col).cast("bigint").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), 0))).alias("term")).distinct()


def _postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs of the documents that have a term: terms of the vocabulary by their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: k for k, t in enumerate(shared.value)}
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            counts, found, owners = [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()):
                words = text.translate(FOLD).split()
                counts.append(len(words))
                ids = [known[w] for w in words if w in known]
                found += ids
                owners.append(len(ids))
            n, size = np.array(counts, np.int64), max(len(known), 1)
            keys, tfs = np.unique(np.repeat(np.arange(len(n)), owners) * size + np.array(found, np.int64), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t))) for v, t in ((keys % size, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Best:
    """The k best (score, id) so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.unnamed = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must score at least to come in."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        all_three = [np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed))]
        order = np.lexsort((all_three[1], all_three[2], -all_three[0]))[: self.k]
        self.scores, self.ids, self.unnamed = (x[order] for x in all_three)


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of several lists added up, by ascending document."""
    if len(lists) == 1:
        return lists[0]
    docs, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[first], np.add.reduceat(scores, first)


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, unnamed: np.ndarray, best: Best, window: int = WINDOW, short: int | None = None) -> None:
    """Take the documents of a block into best. lists: (documents by number, ascending; scores) of each term of an item."""
    short = n_docs // SHORT_SHARE if short is None else short
    brief = [x for x in lists if len(x[0]) <= short]
    sources = [x for x in lists if len(x[0]) > short] + ([accumulated(brief)] if brief else [])
    sources = sorted(((int(scores.max()), docs, scores) for docs, scores in sources), key=lambda x: x[0])
    reach = np.cumsum([0] + [bound for bound, _, _ in sources]).tolist()  # of the sources before each
    for low in range(0, n_docs, window):
        least = best.least
        leading = max(k for k in range(len(sources) + 1) if reach[k] < least)  # sources before it can't reach the least score together
        if leading == len(sources):
            return
        spans = [np.searchsorted(docs, (low, low + window)) for _, docs, _ in sources]
        open_lists = [(docs[a:b], scores[a:b]) for (_, docs, scores), (a, b) in zip(sources[leading:], spans[leading:]) if a < b]
        if not open_lists:
            continue
        docs, scores = accumulated(open_lists)
        for k in range(leading - 1, -1, -1):
            hopeful = scores + reach[k + 1] >= least
            docs, scores = docs[hopeful], scores[hopeful]
            a, b = spans[k]
            if not len(docs) or a == b:
                continue
            listed, added = sources[k][1][a:b], sources[k][2][a:b]
            at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
            scores = scores + np.where(listed[at] == docs, added[at], 0)
        good = scores >= least
        if good.any():
            best.add(scores[good], ids[docs[good]], unnamed[docs[good]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0; equal scores by ascending doc_id.

    With N documents that have a term, L terms in them, n in one of them, df documents that hold a term and tf times that
    one does: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 100 - b + b n N div L, and the score adds up w * (10^9 tf div (1000 tf + 8 m)) over
    the item's terms, once each, in 64-bit integers.

    Rows of one item_id (of no id, too) are one item; each row of documents counts as a document, null ids rank after others of
    equal score. Null and empty texts hold no terms. Items are sought in slices, so that what is broadcast of them is bounded.
    """
    spark = docs.sparkSession
    terms = stored(spark, _terms(items, item_col, "text"), "item-terms")
    slices = (terms.agg(F.sum(F.octet_length("term") + 8).alias("n")).first().n or 0) // SLICE_BYTES + 1
    found = None
    for s in range(slices):
        part = terms if slices == 1 else terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s)
        rows = _search(docs, part, k, b, id_col, text_col)
        found = rows if found is None else found.unionByName(rows)
    return found


def _search(docs: DataFrame, terms: DataFrame, k: int, b: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    wanted: dict[int | None, list[bytes]] = {}
    for row in terms.collect():  # of one slice
        wanted.setdefault(row.item_id, []).append(row.term.encode())
    vocabulary = sorted({t for ts in wanted.values() for t in ts})
    number = {t: k for k, t in enumerate(vocabulary)}
    postings = stored(spark, _postings(docs, vocabulary, id_col, text_col), "postings")
    total = postings.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    held = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the slice
    weights = [math.floor(1000 * math.log((2 * total.n + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))]
    shared = spark.sparkContext.broadcast(([(i, [number[t] for t in ts]) for i, ts in wanted.items()], np.array(weights, np.int64), total.n, total.l or 1))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, n_all, n_terms = shared.value
        best = [Best(k) for _ in asked]
        for block in _blocks(batches):
            block = block.combine_chunks()
            lists = block.column("terms").combine_chunks()
            flat = lists.flatten().to_numpy()
            tfs = block.column("tfs").combine_chunks().flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            m = 100 - b + b * block.column("n").to_numpy() * n_all // n_terms
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            docs_of, ids = owner[order], block.column("doc_id")
            scores = weight[flat[order]] * (1_000_000_000 * tfs[order] // (1000 * tfs[order] + 8 * m[docs_of]))
            ends = np.searchsorted(flat[order], np.arange(len(weight) + 1))
            unnamed, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
            for (_, own), top in zip(asked, best):
                spans = [(ends[t], ends[t + 1]) for t in own if ends[t] < ends[t + 1]]
                search_block([(docs_of[x:y], scores[x:y]) for x, y in spans], len(sizes), ids, unnamed, top)
        part = TaskContext.get().partitionId() % 256
        for (item, _), top in zip(asked, best):
            if n := len(top.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(top.ids, mask=top.unnamed), pa.array(top.scores)], names=["item_id", "part", "doc_id", "score"]
                )

    near = postings.mapInArrow(run, "item_id bigint, part int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = near.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
