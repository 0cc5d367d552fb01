"""Tokens of two tokenizers over the same bytes, aligned.

Both tokenizers cut a text into pieces that follow each other without a gap. All tokens of a batch, sorted by where they start,
fall into groups where a start reaches the greatest end so far: there, and only there, tokens of both sides end together. Inside a group
tokens are linked by their overlaps, of which a relation keeps some.

Which pairs of ids may be linked is known from the vocabularies: where two tokens end together, the bytes of one end with the
bytes of the other. So counts of pairs are arrays of a length that no corpus changes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from lumenstack.llm.components import stored
from lumenstack.llm.textbatch import by_bytes, tidy
from lumenstack.llm.token_files import Encoder

#: Text bytes of a batch that is aligned at a time, and stretches whose ids a worker remembers in each of two generations.
BATCH_BYTES, MOST_HELD = 1 << 20, 250_000
SPACE = "▁"
#: A run of white space with the letters that follow, if punctuation or white space comes next, or with all up to the next white space; a carriage
#: return after a word, which pieces of b may hold, goes on with what follows. Pieces of a never cross the end of such a stretch. Python
#: counts 1C to 1F as white space, the tokenizers don't.
STRETCH = re.compile(r"(?:[^\S\x1c-\x1f])*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?|%]|[^\S\r]|$)|(?:\S|[\x1c-\x1f]|\r\s*)+)|\s+")
CROSSING = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?|%]|(?:\S|[\x1c-\x1f])[^\S\x1c-\x1f\r]|.[\x1c-\x1f]|\n")
_WORKERS: dict[str, "Tokens"] = {}


def level_bytes() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, the bytes of their tokens, and the ids of the stretches they met of late.

    a: a byte-level BPE (JSON), b: a sentencepiece model with byte fallback; strings of special tokens are plain text for both. A text's tokens are those
    of its stretches where no piece of b's vocabulary goes on over the end of one; otherwise b is asked for whole texts.
    """

    def __init__(self, definition: str, pattern: str, model: bytes):
        self.a = Encoder(definition, pattern)
        self.a.special, self.a.whole = [], False
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = level_bytes()
        names = json.loads(definition)["model"]["vocab"] | {t["content"]: t["id"] for t in json.loads(definition).get("added_tokens") or []}
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes_a[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        plain = [p.replace(SPACE, " ") for k, p in enumerate(pieces) if not self.b.is_byte(k)]
        self.by_stretch = not any(CROSSING.search(p) for p in plain)
        self.lead = self.b.encode("\n")
        self.young, self.old, self.odd = {}, {}, set()

    def encoded(self, stretch: str) -> tuple[bytes, bytes]:
        ids = self.b.encode("\n" + stretch)
        if ids[: len(self.lead)] != self.lead:
            raise ValueError(f"{stretch!r} is not encoded apart from what comes before it")
        ids = ids[len(self.lead) :]
        own = self.a.encoded(stretch)
        raw = stretch.encode()
        if b"".join(map(self.bytes_b.__getitem__, ids)) != raw or b"".join(map(self.bytes_a.__getitem__, np.frombuffer(own, "<u4").tolist())) != raw:
            self.odd.add(stretch)
        return own, struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a space and the text, as bytes, by either; none if the text is empty or either gives other bytes than these."""
        if not text:
            return b"", b""
        if not self.by_stretch:
            return self._whole(text)
        if len(self.young) > MOST_HELD:
            self.young, self.old = {}, {s: ids for s, ids in self.young.items() if s not in self.odd}
            self.odd.clear()
        young, old, found = self.young, self.old, []
        stretches = STRETCH.findall(" " + text)
        for s in stretches:
            ids = young.get(s)
            if ids is None:
                ids = young[s] = old.get(s) or self.encoded(s)
            found.append(ids)
        if self.odd and not self.odd.isdisjoint(stretches):
            return self._whole(text)
        return b"".join([x[0] for x in found]), b"".join([x[1] for x in found])

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        raw, ids = b" " + text.encode(), self.b.encode(text)
        own = b"".join(map(self.a.encoded, STRETCH.findall(" " + text)))
        same = b"".join(map(self.bytes_b.__getitem__, ids)) == raw and b"".join(map(self.bytes_a.__getitem__, np.frombuffer(own, "<u4").tolist())) == raw
        return (own, struct.pack(f"<{len(ids)}I", *ids)) if same else (b"", b"")

    def pairs(self, relation: str) -> np.ndarray:
        """All pairs a * (ids of b) + b, ascending, of tokens whose bytes allow the relation: for `end` one ends with the other, for `equal` they are equal."""
        by_a, by_b = {}, {}
        for ids, tokens in ((by_a, self.bytes_a), (by_b, self.bytes_b)):
            for k, t in enumerate(tokens):
                ids.setdefault(t, []).append(k)
        made = set()
        for t, own in by_a.items():
            for cut in range(len(t)) if relation == "end" else range(1):
                made.update(i * len(self.bytes_b) + j for j in by_b.get(t[cut:], ()) for i in own)
        for t, own in by_b.items() if relation == "end" else ():
            for cut in range(1, len(t)):
                made.update(i * len(self.bytes_b) + j for i in by_a.get(t[cut:], ()) for j in own)
        return np.array(sorted(made), np.int64)


def coalesced(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, from 0, given where tokens end; a token starts where the one before ends."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.concatenate([ends_a, ends_b])
    starts = np.concatenate([[0], ends_a[:-1], [0], ends_b[:-1]])
    side = np.repeat([0, 1], [len(ends_a), len(ends_b)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.concatenate([[0], (starts[order][1:] >= reached[:-1]).astype(np.int64)])
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(opens)
    return group[: len(ends_a)], group[len(ends_a) :]


def linked(ends_a: np.ndarray, ends_b: np.ndarray, relation: str) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the tokens that overlap, which are always of one group, and end together (`end`) or also start together (`equal`)."""
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]).astype(np.int64) for e in (ends_a, ends_b))
    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    n = high - low
    i = np.repeat(np.arange(len(ends_a)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    good = ends_a[i] == ends_b[j]
    if relation == "equal":
        good &= starts_a[i] == starts_b[j]
    return i[good], j[good]


#: What align() can give of a document, in this order.
COLUMNS = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "a_ids": "array<int>", "b_ids": "array<int>", "a_groups": "array<int>",
    "b_groups": "array<int>", "link_a": "array<int>", "link_b": "array<int>", "pairs": "array<int>", "groups_sha256": "string",
}


def align(
    docs: DataFrame, definition: str, model: bytes, relation: str = "end", keep: tuple[str, ...] = ("a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b"),
    pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and what of COLUMNS is to be kept of each document, whose text, after a space, is encoded by both tokenizers.

    a_ids, b_ids: the tokens; a_groups, b_groups: the group of each; link_a, link_b: the places of linked tokens; pairs:
    their ids, as places in Tokens.pairs(relation); groups_sha256: of the groups as `a1,a2|b1;a3|b2`, ids in decimals. Null and
    empty texts, and those that either tokenizer gives back as other bytes, have no tokens and a groups_sha256 of ''. Rows are not
    moved; repeated and null ids stay; texts may be of any length, and a text's tokens are held at once.
    """
    if relation not in ("end", "equal"):
        raise ValueError("relation must be 'end' or 'equal'")
    shared = docs.sparkSession.sparkContext.broadcast((definition, pattern, model))
    names = [c for c in COLUMNS if c in keep]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker(*shared.value)
        known = tokens.pairs(relation) if "pairs" in names else None
        length_a, length_b = (np.array([len(t) for t in x], np.int64) for x in (tokens.bytes_a, tokens.bytes_b))
        decimals = [b"%d%c" % (k, c) for n, cs in ((len(length_a), b",|"), (len(length_b), b",;")) for k in range(n) for c in cs]
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            both = [tokens.text(t) for t in batch.column("text").fill_null("").to_pylist()]
            a, b = (np.frombuffer(b"".join(x[k] for x in both), "<u4").astype(np.int64) for k in (0, 1))
            of_a, of_b = (np.cumsum([0] + [len(x[k]) // 4 for x in both]) for k in (0, 1))
            ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
            group_a, group_b = coalesced(ends_a, ends_b)
            i, j = linked(ends_a, ends_b, relation)
            upto = np.searchsorted(i, of_a)
            some = np.diff(of_a) > 0
            groups = np.zeros(len(both), np.int64)
            groups[some] = group_a[of_a[1:][some] - 1] - group_a[of_a[:-1][some]] + 1
            made = {"n_a": np.diff(of_a), "n_b": np.diff(of_b), "n_groups": groups, "n_links": np.diff(upto)}
            made = {c: pa.array(v) for c, v in made.items()}
            first = np.zeros(len(both), np.int64)
            first[some] = group_a[of_a[:-1][some]]
            lists = {
                "a_ids": lambda: (of_a, a), "b_ids": lambda: (of_b, b),
                "a_groups": lambda: (of_a, group_a - np.repeat(first, np.diff(of_a))), "b_groups": lambda: (of_b, group_b - np.repeat(first, np.diff(of_b))),
                "link_a": lambda: (upto, i - np.repeat(of_a[:-1], np.diff(upto))), "link_b": lambda: (upto, j - np.repeat(of_b[:-1], np.diff(upto))),
                "pairs": lambda: (upto, np.searchsorted(known, a[i] * len(length_b) + b[j])),
            }
            for c in names:
                if c in lists:
                    ends, values = lists[c]()
                    made[c] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
            if "groups_sha256" in names:
                made["groups_sha256"] = pa.array(_hashed(a, b, group_a, group_b, of_a, of_b, decimals, 2 * len(length_a)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made[c] for c in names)], names=["doc_id", *names])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} {COLUMNS[c]}" for c in names))


def worker(definition: str, pattern: str, model: bytes) -> Tokens:
    """The tokenizers of this process, kept from task to task."""
    key = definition + pattern + hashlib.sha256(model).hexdigest()
    if key not in _WORKERS:
        _WORKERS[key] = Tokens(definition, pattern, model)
    return _WORKERS[key]


def _hashed(a, b, group_a, group_b, of_a, of_b, decimals: list[bytes], apart: int) -> list[str]:
    """SHA-256 of each document's groups, as text; '' without tokens."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + last_a
    codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = apart + 2 * b + last_b
    written = codes.tolist()
    ends = (of_a + of_b).tolist()
    text = decimals.__getitem__
    return [hashlib.sha256(b"".join(map(text, written[x:y]))[:-1]).hexdigest() if x < y else "" for x, y in zip(ends, ends[1:])]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold each pair. Each task adds up what it reads; a pair is a place in Tokens.pairs()."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(batch.column("pairs").flatten().to_numpy(), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair].astype(np.int64))], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, tokens: Tokens, relation: str = "end") -> DataFrame:
    """The aligned documents (with their pairs) and n_best, the links whose pair is the most frequent of its b id, ties included, and count_sum, over links the corpus-wide count of their pair.

    aligned is read twice, so write it first. The counts that are broadcast have an entry for each pair that the vocabularies allow.
    """
    spark, known = aligned.sparkSession, tokens.pairs(relation)
    counts = np.zeros(len(known), np.int64)
    for row in pair_counts(aligned).toLocalIterator():
        counts[row.pair] = row.n
    most = np.zeros(len(tokens.bytes_b), np.int64)
    np.maximum.at(most, known % len(most), counts)
    shared = spark.sparkContext.broadcast((counts, (counts == most[known % len(most)]).astype(np.int64)))
    kept = [c for c in aligned.columns if c != "pairs"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs") + ", n_best bigint, count_sum bigint"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            at, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends]) for x in shared.value[::-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def align_and_score(docs: DataFrame, definition: str, model: bytes, relation: str = "end", pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each document."""
    digest = ("n_a", "n_b", "n_groups", "n_links", "pairs", "groups_sha256")
    aligned = stored(docs.sparkSession, align(docs, definition, model, relation, digest, pattern, id_col, text_col), "aligned")
    return scored(aligned, worker(definition, pattern, model), relation)
