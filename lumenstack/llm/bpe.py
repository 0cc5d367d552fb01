"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Distinct words travel as rows of their own, ahead of the documents that hold them, which name their words by number. A
fold over a word's bytes merges the adjacent pair of least rank, again and again; pairs are found in a constant rank map.
Decoding concatenates the binary pieces of the ids. Words of a bounded sample of the documents are folded once for all
tasks, all others once a task; what a task holds is bounded and nothing is shuffled but the sample's words.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenstack.llm.textbatch import by_bytes, byte_buffer, spare, tidy

#: A run of white space with what follows it up to the next one. No piece of the pattern crosses the start of such a
#: run, so a text's pieces are those of its stretches. Python counts 1C to 1F as white space, the pattern doesn't.
STRETCH = re.compile(r"(?:[^\S\x1c-\x1f])*(?:\S|[\x1c-\x1f])+|\s+")
#: Stretches that a task remembers, words after which it begins a new generation, and the bytes of the longest word that
#: is folded (the fold's work grows with the square of the length; longer ones are merged with a heap).
MOST_HELD, MOST_WORDS, LONGEST_FOLDED = 200_000, 250_000, 255
#: Text of a task, text of the sample whose words all tasks share, and the longest text of that sample.
TASK_BYTES, COMMON_BYTES, LONGEST_SAMPLED = 48_000_000, 24_000_000, 1 << 20
#: Bytes of words' numbers that are put together at once, and bytes of text that are cut between two looks at the bounds.
AT_ONCE, CUT_AT_ONCE = 1_000_000, 1_000_000
#: A cell of the fold holds the rank of the pair that begins at a symbol, the symbol's place in the word, and its id.
ID_BITS, PLACE_BITS = 20, 8
NO_RANK = 1 << ID_BITS
WORD, DOCUMENT = 0, 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the rank of their concatenation, for every way to part a token in two tokens."""
    return {
        (ranks[token[:k]], ranks[token[k:]]): rank
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    }


class Vocabulary:
    """Ranks and pattern, and their constants for Spark expressions."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if not set(bytes([b]) for b in range(256)) <= ranks.keys() or max(ranks.values()) >= NO_RANK:
            raise ValueError(f"every byte needs a token, and ranks must be below 2^{ID_BITS}")
        self.ranks, self.pattern = ranks, pattern
        pairs = pair_ranks(ranks)
        self.slots = 1 << max(8, len(pairs).bit_length() - 2)
        left, right = np.array(list(pairs), np.int64).reshape(-1, 2).T
        made, slot = np.array(list(pairs.values()), np.int64), left * 40503 + right & self.slots - 1
        order = np.argsort(slot, kind="stable")
        starts = np.searchsorted(slot[order], np.arange(self.slots + 1)).astype(np.int32)
        self.pair_slots = pa.MapArray.from_arrays(pa.array(starts), pa.array((left << ID_BITS | right)[order]), pa.array(made[order]))
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        self.hex_pieces = pa.array(pieces)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([pairs.get((a, b), NO_RANK) for a in self.byte_ids.tolist() for b in self.byte_ids.tolist()], np.int64)
        #: tokens that their own bytes do not fold to; as words they are one id all the same
        self.whole = {token.hex().upper(): rank for token, rank in ranks.items() if merged_by_heap(token, ranks) != [rank]}

    def constants(self, spark: SparkSession) -> DataFrame:
        """One row. rank_map, array<map<bigint,bigint>>: in the slot of a pair, pairs to the ranks of what they make. pieces,
        array<string>: the tokens by id, in hexadecimal.

        Spark looks maps up from end to end, so one map of all pairs is dealt into many small ones.
        """
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (self.pair_slots, self.hex_pieces)]
        return spark.createDataFrame(pa.table(whole, names=["rank_map", "pieces"]))

    def cells(self, words: list[bytes]) -> pa.ListArray:
        """The fold's first cells of each word: its bytes' ids, their places, and the ranks of the pairs they begin."""
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(ends[:-1].astype(np.int64), np.diff(ends))
        rank = np.full(len(flat), NO_RANK, np.int64)
        rank[:-1] = self.byte_pairs[flat[:-1] << 8 | flat[1:]]
        rank[ends[1:][np.diff(ends) > 0] - 1] = NO_RANK
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rank << ID_BITS + PLACE_BITS | place << ID_BITS | self.byte_ids[flat]))


def _written(values: pa.Array, kind: str) -> Column:
    """An array as a literal, folded before the job runs; JSON's maps have strings for keys."""
    rows = [dict(x) if isinstance(x, list) else x for x in values.to_pylist()]
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), kind)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def encoded(word: Column, cells: Column, vocabulary: Vocabulary, rank_map: Column | None = None) -> Column:
    """array<bigint>, the ids of a word, given with its first cells, of which there is one at least. rank_map: where the
    vocabulary's is, or else it is written into the plan."""
    mask, place = F.lit((1 << ID_BITS) - 1), F.lit((1 << PLACE_BITS) - 1 << ID_BITS)
    lone = F.lit(NO_RANK << ID_BITS + PLACE_BITS)  # cells from here on begin no pair

    def fold(table: Column) -> Column:
        def cell(left: Column, right: Column, at: Column) -> Column:
            slot = F.get(table, (left * 40503 + right).bitwiseAND(F.lit(vocabulary.slots - 1)).cast("int"))
            pair = F.shiftleft(left, ID_BITS).bitwiseOR(right)
            rank = F.element_at(slot, pair.cast("string") if rank_map is None else pair)
            return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)), ID_BITS + PLACE_BITS).bitwiseOR(at).bitwiseOR(left)

        def merge(now: Column, least: Column) -> Column:
            def at(k: Column) -> Column:  # the pair is at k and k + 1, counted from 1
                joined = F.shiftright(least, ID_BITS + PLACE_BITS)  # the id of a token is its rank
                before = F.get(now, k - 2)
                new = cell(joined, F.get(now, k + 1).bitwiseAND(mask), least.bitwiseAND(place))
                rest = F.slice(now, k + 2, F.size(now))
                first = F.flatten(F.array(F.array(new), rest))
                pair = F.array(cell(before.bitwiseAND(mask), joined, before.bitwiseAND(place)), new)
                return F.when(k == 1, first).otherwise(F.flatten(F.array(F.slice(now, F.lit(1), k - 2), pair, rest)))

            return F.when(least < lone, _let(F.array_position(now, least).cast("int"), at)).otherwise(now)

        merged = F.aggregate(F.array_repeat(F.lit(0), F.size(cells) - 1), cells, lambda now, _: _let(F.array_min(now), lambda least: merge(now, least)))
        return F.transform(merged, lambda x: x.bitwiseAND(mask))

    folded = _let(_written(vocabulary.pair_slots, "array<map<string,bigint>>") if rank_map is None else rank_map, fold)
    if vocabulary.whole:
        whole = F.element_at(F.from_json(F.lit(json.dumps(vocabulary.whole)), "map<string,bigint>"), F.hex(word))
        folded = F.when(whole.isNotNull(), F.array(whole)).otherwise(folded)
    return folded


def decoded(ids: Column, vocabulary: Vocabulary, pieces: Column | None = None) -> Column:
    """binary: the pieces of the ids, concatenated. pieces: where the vocabulary's are, or else they are written into the plan."""
    table = _written(vocabulary.hex_pieces, "array<string>") if pieces is None else pieces
    return F.unhex(_let(table, lambda held: F.concat_ws("", F.transform(ids, lambda i: F.get(held, i.cast("int"))))))


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word, in time that grows little faster than its length."""
    n = len(word)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))

    def rank(i: int) -> int | None:
        return ranks.get(word[i : stop[after[i]]]) if after[i] < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapify(heap)
    gone = [False] * n
    while heap:
        r, i, end = heappop(heap)
        if gone[i] or after[i] >= n or stop[after[i]] != end or rank(i) != r:
            continue
        j = after[i]
        gone[j], stop[i], after[i] = True, stop[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (new := rank(k)) is not None:
                heappush(heap, (new, k, stop[after[k]]))
    return [ranks[word[i : stop[i]]] for i in range(n) if not gone[i]]


_ROWS = "kind int, generation int, number bigint, word binary, cells array<bigint>, merged array<bigint>, refs binary"


def _rows(kind: int, generation: int, numbers, words: list[bytes] | None = None, refs: list[bytes] | None = None, vocabulary: Vocabulary | None = None) -> pa.RecordBatch:
    """Words by their number with their first cells, or their ids if they are too long for the fold; or documents by doc_id."""
    n = len(numbers)
    if words is None:
        cells = merged = pa.nulls(n, pa.list_(pa.int64()))
    else:
        long = [w if len(w) > LONGEST_FOLDED else None for w in words]
        cells = vocabulary.cells([b"" if w else words[k] for k, w in enumerate(long)])
        merged = pa.array([merged_by_heap(w, vocabulary.ranks) if w else None for w in long], pa.list_(pa.int64()))
    columns = [pa.array([kind] * n, pa.int32()), pa.array([generation] * n, pa.int32()), numbers, pa.array(words or [None] * n, pa.binary()), cells, merged, pa.array(refs or [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "generation", "number", "word", "cells", "merged", "refs"])


def _word_rows(words: list[str], first: int, generation: int, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(words), 10_000):
        part = [w.encode() for w in words[k : k + 10_000]]
        yield _rows(WORD, generation, pa.array(range(first + k, first + k + len(part)), pa.int64()), words=part, vocabulary=vocabulary)


@tidy
def _sample_words(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Distinct words of a task's sampled texts."""
    pieces = regex.compile(shared.value.pattern).findall
    words: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words.update(pieces(text))
    yield pa.RecordBatch.from_arrays([pa.array([w for w in words if len(w.encode()) <= LONGEST_FOLDED], pa.string())], names=["word"])


def _cells_of(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield from _word_rows(words, 0, 0, shared.value)


class _References(dict):
    """Stretches to the numbers of their words; a word that nobody knows gets the next number of its own."""

    def __init__(self, pieces, known: dict[str, int], own: dict[str, int]):
        self.pieces, self.known, self.own = pieces, known, own

    def __missing__(self, stretch: str) -> bytes:
        known, own, numbers = self.known, self.own, []
        for w in self.pieces(stretch):
            number = known.get(w)
            numbers.append(own.setdefault(w, len(own)) + len(known) if number is None else number)
        found = self[stretch] = np.array(numbers, np.int32).tobytes() if len(numbers) > 1 else numbers[0].to_bytes(4, "little")
        return found


@tidy
def _with_words(batches: Iterator[pa.RecordBatch], shared, common, most_words: int | None = None, most_held: int | None = None) -> Iterator[pa.RecordBatch]:
    """Documents as they come, as the numbers of their words, each batch after the words it is the first to need.

    Common words have the first numbers; a generation numbers its own words after them. The bounds are MOST_WORDS and
    MOST_HELD unless given.
    """
    most_words, most_held = most_words or MOST_WORDS, most_held or MOST_HELD
    vocabulary, known = shared.value, common.value.numbers()
    pieces = regex.compile(vocabulary.pattern).findall
    own: dict[str, int] = {}
    refs_of = _References(pieces, known, own)
    generation = 0
    for batch in batches:
        for part in by_bytes([batch], "text", CUT_AT_ONCE):
            ids, texts = part.column("doc_id"), part.column("text").fill_null("").to_pylist()
            del part
            if len(own) > most_words:
                own.clear()
                refs_of.clear()
                generation += 1
            elif len(refs_of) > most_held:
                refs_of.clear()
            held, at = len(own), refs_of.__getitem__
            bodies = [b"".join(map(at, STRETCH.findall(text))) for text in texts]
            fresh = list(own)[held:] if len(own) > held else []
            yield from _word_rows(fresh, len(known) + held, generation, vocabulary)
            del texts, fresh
            yield _rows(DOCUMENT, generation, ids, refs=bodies)
            del ids, bodies
        del batch  # before the next one is read
        spare()


class CommonWords:
    """The words that all tasks know, as a table (word, ids, decoded) that travels without its index."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __reduce__(self):
        return CommonWords, (self.table,)

    def numbers(self) -> dict[str, int]:
        """Made anew for each task: a worker that next puts documents together shall not keep it."""
        words = self.table.column("word")
        return {w.as_py().decode(): k for k, w in enumerate(words)}


class _Words:
    """What the words of a generation are: their ids, the ids' text with a comma after each, and their bytes."""

    def __init__(self, common: pa.Table):
        self.parts = [[self._text(common.column("ids").combine_chunks())], [common.column("ids").combine_chunks()], [common.column("decoded").combine_chunks().cast(pa.large_binary())]]
        self.known = len(common)
        self.clear()

    @staticmethod
    def _text(ids: pa.ListArray) -> pa.Array:
        words = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string())), ",")
        return pc.binary_join_element_wise(words, "", ",").cast(pa.large_binary())

    def clear(self) -> None:
        self.held = [part[:1] for part in self.parts]
        self.n = self.known

    def add(self, numbers: np.ndarray, ids: pa.ListArray, plain: pa.Array) -> None:
        if (numbers != np.arange(self.n, self.n + len(numbers))).any() or ids.null_count or plain.null_count:
            raise ValueError("words came out of turn or without ids")
        ids = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py()), ids.flatten().cast(pa.int32()))
        for held, new in zip(self.held, (self._text(ids), ids, plain.cast(pa.large_binary()))):
            held.append(new)
        self.n += len(numbers)

    def joined(self) -> list[pa.Array]:
        self.held = [[pa.concat_arrays(part)] if len(part) > 1 else part for part in self.held]
        return [part[0] for part in self.held]


def _taken(values: pa.Array, refs: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(bytes, ends) of the values at refs, one after the other."""
    found = values.take(refs)
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    return memoryview(found.buffers()[2] or b""), ends


@tidy
def _assembled(batches: Iterator[pa.RecordBatch], common, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents as the concatenation of their words' ids and bytes."""
    words, generation = _Words(common.value.table.select(["ids", "decoded"])), None
    for batch in batches:
        kind, age = batch.column("kind").to_numpy(), batch.column("generation").to_numpy()
        cuts = np.flatnonzero(np.diff(age) | np.diff(kind)) + 1  # words come before the documents that need them
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            rows = batch.slice(first, last - first)
            if len(rows) and age[first] != generation:
                words.clear()
                generation = age[first]
            if len(rows) and kind[first] == WORD:
                words.add(rows.column("number").to_numpy(), rows.column("ids"), rows.column("decoded"))
            elif len(rows):
                for part in by_bytes([rows.select(["number", "refs"])], "refs", AT_ONCE):
                    yield _put_together(part.column("number"), *byte_buffer(part.column("refs")), words, with_ids)
                    del part
        del batch, rows, kind, age  # before the next one is read
        spare()


def _put_together(doc_ids: pa.Array, flat: np.ndarray, ends: np.ndarray, words: _Words, with_ids: bool) -> pa.RecordBatch:
    """Documents from the bytes of their words' numbers, four each, and the ends of the documents among them."""
    texts, ids, plain = words.joined()
    at, refs = ends // 4, np.frombuffer(flat, np.int32)
    if len(refs) and refs.max() >= words.n:
        raise ValueError("a document names a word that did not come")
    refs = pa.array(refs)
    text, text_ends = _taken(texts, refs)
    bytes_, byte_ends = _taken(plain, refs)
    counts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).take(refs).to_numpy())]).astype(np.int64)[at]
    digests = [[hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(text_ends[at[:-1]].tolist(), text_ends[at[1:]].tolist())]]
    digests.append([hashlib.sha256(bytes_[a:b]).hexdigest() for a, b in zip(byte_ends[at[:-1]].tolist(), byte_ends[at[1:]].tolist())])
    columns = [doc_ids, pa.array(np.diff(counts)), *(pa.array(d, pa.string()) for d in digests)]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), ids.take(refs).flatten()))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def _folded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of _ROWS with the ids and the decoded bytes of words.

    The vocabulary comes by scalar subqueries: the text of a literal, megabytes, would be kept in the driver with each plan
    and each change of it. They may not stand in lambdas, so they are columns that Spark puts in their place; as each is used
    once, no row ever holds them.
    """
    constants = vocabulary.constants(rows.sparkSession)
    given = rows.withColumns({f"__{c}": constants.select(c).scalar() for c in constants.columns})
    ids = F.coalesce(F.col("merged"), encoded(F.col("word"), F.col("cells"), vocabulary, F.col("__rank_map"))).cast("array<int>")
    both = _let(ids, lambda x: F.struct(x.alias("ids"), decoded(x, vocabulary, F.col("__pieces")).alias("decoded")))
    return given.select(*rows.columns, F.when(F.col("kind") == WORD, both).alias("__both")).select(*rows.columns, "__both.ids", "__both.decoded")


def _in_turn(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows after a shuffle, those of a task in one partition, in order, and generations told apart by their task too."""
    at = F.col("__at")  # the task, then the row in it
    task = F.shiftright(at, 33)
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("generation", F.shiftleft(task, 32).bitwiseOR(F.col("generation")))
    return rows.repartitionById(tasks, task.cast("int")).sortWithinPartitions(at).drop("__at")


def common_words(docs: DataFrame, shared, total: int, common_bytes: int = COMMON_BYTES) -> pa.Table:
    """word, ids and decoded of the distinct words of about common_bytes of the texts, chosen by a hash of them."""
    share = min(1.0, common_bytes / max(1, total))
    chosen = docs.filter((F.octet_length("text") <= LONGEST_SAMPLED) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))))
    words = chosen.select("text").mapInArrow(lambda batches: _sample_words(batches, shared), "word string").distinct()
    rows = words.mapInArrow(lambda batches: _cells_of(batches, shared), _ROWS)
    return _folded(rows, shared.value).select("word", "ids", "decoded").toArrow().combine_chunks()


def encode_decode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    common_bytes: int = COMMON_BYTES, most_words: int | None = None, most_held: int | None = None, apart: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    bytes decoded from the ids), and the ids themselves if asked for.

    Null texts are empty: no tokens, the digests of nothing. Null ids stay null, ids that are no numbers are an error;
    repeated rows give a row each. Empty tables give an empty result. Other columns are not read. Special tokens are not
    known: their strings are ordinary text. Smaller bounds on the sample of common words and on what a task remembers
    take less of a worker's memory and more time; the rows are the same. So does apart: documents as numbers of words
    pass through a shuffle before they are put together, so no task has two Python workers at a time.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)  # bounded by the vocabulary
    spare()  # what building the vocabulary, or a step before, left in the driver
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    common = context.broadcast(CommonWords(common_words(source, shared, total, common_bytes)))  # bounded by the sample's bytes
    spare()
    # the more text a task has, the rarer its new words: a stretch of documents of TASK_BYTES each
    tasks = total // TASK_BYTES + 1
    rows = source.coalesce(tasks).mapInArrow(lambda batches: _with_words(batches, shared, common, most_words, most_held), _ROWS)
    rows = _folded(rows, vocabulary).select("kind", "generation", "number", "refs", "ids", "decoded")
    if apart:
        rows = _in_turn(rows, tasks)
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda batches: _assembled(batches, common, with_ids), fields)
