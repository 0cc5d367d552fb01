"""Exact substring deduplication by suffix sorting.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id.

Sorting every suffix of a corpus moves far more than the corpus, so suffixes are first dealt out by
minimizers: of the GRAM-byte grams of a window, the one of least hash. Equal windows have equal
minimizers. (1) Runs of windows with one minimizer tell which minimizers occur in two documents or more;
in the same pass, content-defined chunks settle passages that an earlier document has byte for byte.
(2) What is left sends its bytes to its minimizer's task, which sorts the suffixes there by their first
`length` bytes: multikey quicksort to a shallow depth, then a blind trie for each group that still
shares its prefix. Equal neighbours in that order show which windows an earlier document has.
(3) Each document drops the union of its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenstack.llm.components import stored
from lumenstack.llm.textbatch import by_bytes, byte_buffer, tidy

GRAM = 20
#: Mean and least length of the chunks; bytes per task's slice of a batch; bytes after which the shallow sort ends.
CHUNK, LEAST_CHUNK, SLICE, SHALLOW = 256, 64, 2_000_000, 16
#: Contexts that a task compares before it sends them, and text whose entries make a bucket.
SEEN, BUCKET_BYTES = 150_000, 11_000_000
#: A minimizer is common from this many documents on, or from a 2^16th of all runs: so there are at most 2^16 of them.
COMMON, MOST_COMMON = 10_000, 1 << 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_at_each_byte(flat: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number: numbers compare as the bytes do. Zeros follow the end."""
    padded = np.concatenate([flat, np.zeros(16, np.uint8)])
    words = np.empty(-(-len(flat) // 8) * 8, np.uint64)
    for k in range(8):
        words[k::8] = padded[k : k + len(words)].view(">u8")
    return words[: len(flat)]


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on (meaningless where fewer are left)."""
    n = len(words)
    h = words ^ (words >> np.uint64(29))
    h *= _A
    mixed = words ^ (words >> np.uint64(32))  # of the bytes 8 to 15
    mixed *= _B
    h[: max(0, n - 8)] ^= mixed[8:]
    np.multiply(words, _C, out=mixed)  # of the bytes 12 to 19
    h ^= h >> np.uint64(31)
    h[: max(0, n - 12)] ^= mixed[12:]
    h *= _B
    h ^= h >> np.uint64(33)
    return h


def window_runs(grams: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, minimizer) of each run of consecutive windows of a document with one minimizer.

    grams: the hash of the gram at each byte of the texts, which end at `ends`.
    """
    n = len(grams) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    least, span, have = grams, length - GRAM + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[span - have : span - have + n])
    change = least[1:] != least[:-1]
    fits = np.ones(n + 1, bool)  # a window that begins in the last length - 1 bytes of a text doesn't fit
    for a, b in zip(np.maximum(ends[1:] - length + 1, ends[:-1]).tolist(), ends[1:].tolist()):
        fits[min(a, n) : min(b, n)] = False
    starts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)]
    change[starts - 1] = True
    change |= fits[1:n] != fits[: n - 1]
    first = np.flatnonzero(np.r_[True, change])
    size = np.diff(np.r_[first, n])
    some = fits[first]
    first, size = first[some], size[some]
    return np.searchsorted(ends, first, "right") - 1, first, size, least[first]


def chunk_spans(grams: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, stop) of the chunks of a text; each overlaps the next by length - 1, so that every window lies in one.

    grams: the hashes of the text's grams. Cuts lie where a gram's hash says so, at least LEAST_CHUNK apart.
    """
    n = len(grams)
    cuts = [0]
    for m in np.flatnonzero(grams[: max(0, n - GRAM + 1)] % np.uint64(CHUNK) == 0).tolist():
        if m - cuts[-1] >= LEAST_CHUNK:
            cuts.append(m)
    return [(a, min(n, b + length - 1)) for a, b in zip(cuts, [*cuts[1:], n]) if a + length <= n]


#: Kinds of entries. RUN: windows with one minimizer. HEAD: a minimizer of several documents of a slice, whose number is its
#: size. KNOWN: a run already known to be shared. CHUNK: a chunk, by the 128-bit hash of its bytes (hash and more).
RUN, HEAD, KNOWN, CHUNK_OF, DONE, COMMON_RUN = range(6)


def packed_rows(rows: pa.RecordBatch) -> bytes:
    """A batch as a compressed stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpacked_rows(body: bytes) -> pa.RecordBatch:
    """The batch of a compressed stream."""
    return pa.ipc.open_stream(pa.BufferReader(body)).read_next_batch()


def places(doc: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document, so that what is known of it can meet it; equal texts are spread by their ids."""
    mixed = (doc.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(7))) * _A
    return ((mixed ^ (mixed >> np.uint64(29))) * _B >> np.uint64(20)).astype(np.int64) % groups


def _by_place(rows: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Groups and the packed rows for them."""
    place = places(doc, key, groups)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1, append=groups))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(place[order[a]]), packed_rows(rows.take(pa.array(order[a:b])))


@tidy
def _packed_documents(batches: Iterator[pa.RecordBatch], doc: str, key: str, groups: int) -> Iterator[pa.RecordBatch]:
    """Documents packed by their group; a null id counts as 0 here."""
    for batch in batches:
        for part in by_bytes([batch], "__text", 32 * SLICE):
            found = list(_by_place(part, part.column(doc).fill_null(0).to_numpy(), part.column(key).to_numpy(), groups))
            yield _bodies(found)


def _bodies(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["bucket", "body"])


class Entries:
    """Entries as arrays of one length: kind, hash, more of the hash, doc (its id), key (of its text), start and size."""

    FIELDS = {"kind": np.int8, "hash": np.uint64, "more": np.uint64, "doc": np.int64, "key": np.int64, "start": np.int32, "size": np.int32}

    def __init__(self, **columns: np.ndarray):
        self.columns = {name: np.asarray(columns[name]).astype(kind, copy=False) for name, kind in self.FIELDS.items()}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.columns["kind"])

    def take(self, rows: np.ndarray) -> "Entries":
        return Entries(**{name: values[rows] for name, values in self.columns.items()})

    @staticmethod
    def joined(parts: list["Entries"]) -> "Entries":
        return Entries(**{name: np.concatenate([p.columns[name] for p in parts]) if parts else [] for name in Entries.FIELDS})

    def packed(self) -> bytes:
        """Documents in a table of their own, starts as steps, hashes in halves: little is left to compress but their lower halves."""
        pair = np.stack([self.doc, self.key], axis=1)
        new = np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)] if len(self) else np.zeros(0, bool)
        nth, step = (np.cumsum(new) - 1).astype(np.int32), np.diff(self.start, prepend=np.int32(0))
        halves = (self.hash >> np.uint64(32)).astype(np.uint32), self.hash.astype(np.uint32)
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (self.kind, *halves, self.more, nth, step, self.size)], names=["kind", "high", "low", "more", "nth", "step", "size"])
        docs = pa.RecordBatch.from_arrays([pa.array(x) for x in (self.doc[new], self.key[new])], names=["doc", "key"])
        return packed_rows(docs) + packed_rows(rows)

    @staticmethod
    def unpacked(body: bytes) -> "Entries":
        source = pa.BufferReader(body)
        docs, rows = (pa.ipc.open_stream(source).read_all() for _ in range(2))
        nth = rows.column("nth").to_numpy()
        start = np.cumsum(rows.column("step").to_numpy(), dtype=np.int32)
        columns = {k: rows.column(k).to_numpy() for k in ("kind", "more", "size")}
        columns["hash"] = rows.column("high").to_numpy().astype(np.uint64) << np.uint64(32) | rows.column("low").to_numpy()
        return Entries(doc=docs.column("doc").to_numpy()[nth], key=docs.column("key").to_numpy()[nth], start=start, **columns)


def _dealt(entries: Entries, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, entries.take(order[cuts[b] : cuts[b + 1]]).packed()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    flat, ends = byte_buffer(batch.column("__text"))
    ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        yield flat[ends[first] : ends[last]], ends[first : last + 1] - ends[first], ids[first:last], keys[first:last]
        first = last


@tidy
def _entries(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed entries by bucket: the runs and chunks of each slice of documents.

    A minimizer of several documents of the slice goes to its bucket once, as a head; their own runs, already known
    to be shared, go anywhere. So no bucket gets a common minimizer from every document.
    """
    for batch in batches:
        for flat, ends, ids, keys in _slices(batch):
            grams = gram_hashes(words_at_each_byte(flat))
            doc, first, size, least = window_runs(grams, ends, length)
            least = least % np.uint64(buckets) << np.uint64(32) | least >> np.uint64(32)  # its bucket and 32 more bits
            order = np.argsort(least)
            new = np.r_[True, least[order][1:] != least[order][:-1]] if len(order) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            several = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else order
            pairs = np.unique(np.stack([group[several], ids[doc[order[several]]]], axis=1), axis=0) if len(several) else np.zeros((0, 2), np.int64)
            docs = np.bincount(pairs[:, 0], minlength=int(new.sum()))
            many = np.zeros(len(order), bool)
            many[order] = docs[group] > 1
            heads = order[np.flatnonzero(new)[docs > 1]]
            runs = Entries(kind=np.where(many, KNOWN, RUN), hash=least, more=np.zeros(len(least)), doc=ids[doc], key=keys[doc], start=first - ends[doc], size=size)
            head = Entries(kind=np.full(len(heads), HEAD), hash=least[heads], more=np.zeros(len(heads)), doc=ids[doc[heads]], key=keys[doc[heads]], start=np.zeros(len(heads)), size=docs[docs > 1])
            spans = [(d, a, b) for d in np.flatnonzero(np.diff(ends) >= length).tolist() for a, b in chunk_spans(grams[ends[d] : ends[d + 1]], length)]
            text = flat.tobytes()
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[ends[d] + a : ends[d] + b]) for d, a, b in spans]), np.uint64).reshape(-1, 2)
            d, a, b = (np.array(x, np.int64) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
            chunks = Entries(kind=np.full(len(d), CHUNK_OF), hash=hashes[:, 0], more=hashes[:, 1], doc=ids[d], key=keys[d], start=a, size=b - a)
            packed = Entries.joined([runs, head, chunks])
            home = np.where(packed.kind == CHUNK_OF, packed.hash % np.uint64(buckets), packed.hash >> np.uint64(32)).astype(np.int64)
            yield _bodies(list(_dealt(packed, np.where(packed.kind == KNOWN, np.arange(len(packed)) // 1000 % buckets, home), buckets)))


_SHARED = "bucket bigint, hash bigint, body binary"


@tidy
def _shared(batches: Iterator[pa.RecordBatch], common: int, groups: int) -> Iterator[pa.RecordBatch]:
    """For each bucket: packed, by the group of their document, the runs whose minimizer several documents have and the
    chunks that an earlier document has (DONE); and the hashes of minimizers of many documents, in rows of their own."""
    held: list[Entries] = []
    current = None
    for batch in batches:
        for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
            if bucket != current and held:
                whole, held = Entries.joined(held), []
                yield _bucket_shared(whole, common, groups)
                del whole
            current = bucket
            held.append(Entries.unpacked(body))
    if held:
        whole, held = Entries.joined(held), []
        yield _bucket_shared(whole, common, groups)


def _bucket_shared(entries: Entries, common: int, groups: int) -> pa.RecordBatch:
    settled = entries.take(np.flatnonzero(entries.kind == KNOWN))
    kept, hot = [settled], []
    for of_chunks in (False, True):
        part = entries.take(np.flatnonzero((entries.kind == CHUNK_OF) if of_chunks else (entries.kind == RUN) | (entries.kind == HEAD)))
        order = np.lexsort([part.more, part.hash]) if of_chunks else np.argsort(part.hash)
        differs = (part.hash[order][1:] != part.hash[order][:-1]) | (part.more[order][1:] != part.more[order][:-1])
        new = np.r_[True, differs] if len(order) else np.zeros(0, bool)
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        if not len(heads):
            continue
        doc = part.doc[order]
        least, most = np.minimum.reduceat(doc, heads)[group], np.maximum.reduceat(doc, heads)[group]
        if of_chunks:
            late = np.sort(order[doc > least])
            found = part.take(late)
            found.columns |= {"kind": np.full(len(late), DONE, np.int8), "hash": np.zeros(len(late), np.uint64), "more": np.zeros(len(late), np.uint64)}
        else:
            is_head = part.kind[order] == HEAD
            docs = np.bincount(group, np.where(is_head, part.size[order], 1), len(heads))
            with_head = np.bincount(group, is_head, len(heads)) > 0
            found = part.take(np.sort(order[~is_head & ((least != most) | with_head[group])]))
            hot = part.hash[order[heads]][docs >= common].view(np.int64).tolist()
        kept.append(found)
    found = Entries.joined(kept)
    dealt = list(_dealt(found, places(found.doc, found.key, groups), groups))
    columns = [[x[0] for x in dealt] + [None] * len(hot), [None] * len(dealt) + hot, [x[1] for x in dealt] + [None] * len(hot)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "hash", "body"])


_SUFFIXES = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("body", pa.binary())])


@tidy
def _contexts(batches: Iterator[pa.RecordBatch], length: int, common: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that chunks have not settled, by minimizer; windows of common minimizers by their own hash.

    Rows come by group: packed entries first, then packed documents. A context that several documents share goes out
    once, for the least of them, as far as SEEN of them are held. Rows without bytes are settled spans.
    """
    group, packed, of_doc = None, [], None
    seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    out: list[tuple] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = out + [(part, *at, len(body), body) for (part, body), at in seen.items()]
        out.clear()
        seen.clear()
        for k in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 20_000]), _SUFFIXES)], schema=_SUFFIXES)

    for batch in batches:
        for bucket, body, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "docs"))):
            if bucket != group:
                group, packed, of_doc = bucket, [], None
            if body is not None:
                packed.append(Entries.unpacked(body))
                continue
            if of_doc is None:
                of_doc = _by_document(Entries.joined(packed))
                packed = []
            rows = unpacked_rows(docs)
            flat, ends = byte_buffer(rows.column("__text"))
            for r, (doc, key) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("key").to_pylist())):
                found = of_doc.get((doc, key))
                if found is None:
                    continue
                start, size, least, left, right = _unsettled(found, length)
                out += [(key, doc, key, a, b - a, None) for a, b in zip(left.tolist(), right.tolist())]
                text = flat[ends[r] : ends[r + 1]].tobytes() if len(start) else b""
                for s, n, h in zip(start.tolist(), size.tolist(), least.view(np.int64).tolist()):
                    pieces = [(h, s, text[s : s + n + length - 1])]
                    if h in common:
                        pieces = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), s + k, w) for k in range(n) for w in (text[s + k : s + k + length],)]
                    for part, at, piece in pieces:
                        other = seen.get((part, piece))
                        if other is None or other[0] > doc:
                            seen[part, piece] = (doc, key, at)
                            if other is not None:
                                out.append((key, *other, len(piece), None))
                        elif other[0] < doc:
                            out.append((key, doc, key, at, len(piece), None))
                        else:  # the same document again: its windows fare alike, but each place needs its span
                            out.append((part, doc, key, at, len(piece), piece))
                if len(seen) + len(out) >= SEEN:
                    yield from flushed()
    yield from flushed()


def _by_document(entries: Entries) -> dict[tuple[int, int], Entries]:
    order = np.lexsort([entries.start, entries.key, entries.doc])
    entries = entries.take(order)
    new = np.flatnonzero(np.r_[True, (entries.doc[1:] != entries.doc[:-1]) | (entries.key[1:] != entries.key[:-1])]) if len(entries) else order
    return {(int(entries.doc[a]), int(entries.key[a])): entries.take(np.arange(a, b)) for a, b in zip(new, np.r_[new[1:], len(entries)])}


def _unsettled(entries: Entries, length: int) -> tuple[np.ndarray, ...]:
    """(start, size, minimizer) of a document's runs outside its settled chunks, and those chunks' starts and stops."""
    done = entries.take(np.flatnonzero(entries.kind == DONE))
    runs = entries.take(np.flatnonzero(entries.kind != DONE))
    left = done.start.astype(np.int64)
    right = np.maximum.accumulate(left + done.size)
    low, high = runs.start.astype(np.int64), runs.start.astype(np.int64) + runs.size
    if len(left):
        for _ in range(2):  # windows of settled chunks are cut from both ends of a run
            at = np.searchsorted(left, low, "right") - 1
            low = np.where((at >= 0) & (low + length <= right[at]), np.minimum(high, right[at] - length + 1), low)
            at = np.searchsorted(left, high - 1, "right") - 1
            high = np.where((at >= 0) & (high - 1 + length <= right[at]), np.maximum(low, np.minimum(high, left[at])), high)
    some = low < high
    return low[some], (high - low)[some], runs.hash[some], left, left + done.size


def shallow_sort(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes `at` inside each group, to `depth` bytes, 8 bytes being a character.

    All segments take a step at once: each splits at its pivot in less, equal and greater; the equal part goes
    on with the next character. Returns the order, and for each place in it the number of its tied segment.
    """
    order = np.argsort(group, kind="stable")
    segment = group[order]
    segment = np.cumsum(np.r_[True, segment[1:] != segment[:-1]]) - 1 if len(order) else segment
    level = np.zeros(len(order), np.int64)
    active = np.arange(len(order))
    while True:
        sizes = np.bincount(segment, minlength=int(segment[-1]) + 1 if len(segment) else 0)
        active = active[(sizes[segment[active]] > 1) & (level[active] * 8 < depth)]
        if not len(active):
            return order, segment
        seg = segment[active]
        head = np.r_[True, seg[1:] != seg[:-1]]
        first = np.flatnonzero(head)
        count = np.diff(np.r_[first, len(active)])
        nth = np.cumsum(head) - 1
        char = words[np.minimum(at[order[active]] + 8 * level[active], len(words) - 1)]
        pivot = char[first + count // 2][nth]
        side = np.where(char < pivot, 0, np.where(char == pivot, 1, 2))
        place = np.argsort(nth * 3 + side, kind="stable")
        order[active], level[active] = order[active][place], (level[active] + (side == 1))[place]
        split = (nth * 3 + side)[place]
        starts = np.zeros(len(order), bool)
        starts[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])] = True
        starts[active[np.flatnonzero(np.r_[True, split[1:] != split[:-1]])]] = True
        segment = np.cumsum(starts) - 1


class BlindTrie:
    """Strings of one length, told apart by the bytes at which they branch; a string is compared in full once, with one leaf."""

    __slots__ = ("root", "width")

    def __init__(self, width: int):
        self.root, self.width = None, width

    def add(self, value: bytes, item: int) -> None:
        if self.root is None:
            self.root = (value, [item])
            return
        node = self.root
        while isinstance(node, list):  # an inner node: [depth, {byte: child}]
            node = node[1].get(value[node[0]]) or next(iter(node[1].values()))
        differs = int.from_bytes(node[0]) ^ int.from_bytes(value)
        if not differs:
            node[1].append(item)
            return
        depth = self.width - (differs.bit_length() + 7) // 8
        old = node[0][depth]
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][value[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][value[depth]] = (value, [item])
            return
        split = [depth, {old: node, value[depth]: (value, [item])}]
        if parent is None:
            self.root = split
        else:
            parent[1][value[parent[0]]] = split

    def in_order(self) -> Iterator[tuple[bytes, list[int]]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node is not None:
                yield node


def deep_sort(text: bytes, at: np.ndarray, width: int) -> Iterator[list[int]]:
    """The numbers of the suffixes `at`, in the order of their first `width` bytes, equal ones together."""
    trie = BlindTrie(width)
    for item, p in enumerate(at.tolist()):
        trie.add(text[p : p + width], item)
    for _, items in trie.in_order():
        yield items


def earlier_windows(body: np.ndarray, ends: np.ndarray, part: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows that a context of the same part has from a smaller document.

    Context i is body[ends[i]:ends[i + 1]]. Only parts with several contexts are sorted.
    """
    windows = np.diff(ends) - length + 1
    owner = np.repeat(np.arange(len(doc)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = ends[owner] + nth
    words = words_at_each_byte(body)
    # windows whose hash occurs once in their part equal none: they stay out of the sort
    mixed = part[owner].astype(np.uint64) * _C
    for k in [*range(0, length - 7, 8), length - 8]:
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _A + words[at + k]
    mixed ^= mixed >> np.uint64(29)
    by_hash = np.argsort(mixed)
    same = mixed[by_hash][1:] == mixed[by_hash][:-1]
    again = np.sort(by_hash[np.r_[False, same] | np.r_[same, False]])
    owner, nth, at = owner[again], nth[again], at[again]
    order, segment = shallow_sort(words, at, part[owner])
    text, found = body.tobytes(), []
    cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[cuts, len(segment)])
    if not len(cuts):
        return owner[:0], nth[:0]
    docs, group = doc[owner[order]], np.repeat(np.arange(len(cuts)), sizes)
    least, most = np.minimum.reduceat(docs, cuts), np.maximum.reduceat(docs, cuts)
    # a tied group whose suffixes all equal its first is in order as it is; the others need a trie
    place = at[order]
    equal = np.ones(len(place), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal &= words[place + k] == words[place[cuts][group] + k]
    uniform = np.logical_and.reduceat(equal, cuts)
    found.append(order[uniform[group] & (docs > least[group])])
    for i in np.flatnonzero((sizes > 1) & (least != most) & ~uniform).tolist():
        tied = order[cuts[i] : cuts[i] + sizes[i]]
        owners = doc[owner[tied]]
        for items in deep_sort(text, at[tied], length):
            if len(items) > 1:
                who = owners[items]
                found.append(tied[np.array(items)[who > who.min()]])
    hit = np.concatenate(found) if found else np.zeros(0, np.int64)
    return owner[hit], nth[hit]


_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])


@tidy
def _spans(batches: Iterator[pa.RecordBatch], length: int, groups: int, enough: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Spans to drop, packed by the group of their document, from contexts that come sorted by part; contexts without bytes are spans already."""
    held: list[pa.RecordBatch] = []
    size = 0

    def sent(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        with_bytes = rows.column("body").is_valid()
        done = rows.filter(pc.invert(with_bytes)).select(_SPANS.names).to_batches()
        found = pa.Table.from_batches([_part_spans(rows.filter(with_bytes), length), *done], schema=_SPANS).combine_chunks()
        return _bodies([x for b in found.to_batches() for x in _by_place(b, b.column("doc_id").to_numpy(), b.column("key").to_numpy(), groups)])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= enough:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            last = int(np.searchsorted(part, part[-1], "left")) if (part[1:] >= part[:-1]).all() else 0
            if last:
                yield sent(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield sent(pa.Table.from_batches(held))


def _part_spans(table: pa.Table, length: int) -> pa.RecordBatch:
    table = table.combine_chunks()
    doc, key, start = (table.column(k).to_numpy() for k in ("doc_id", "key", "start"))
    body, ends = byte_buffer(table.column("body").combine_chunks())
    part = table.column("part").to_numpy()
    size = np.diff(ends)
    _, group, count = np.unique(part, return_inverse=True, return_counts=True)
    by_part = np.argsort(group, kind="stable")
    heads = np.cumsum(count) - count
    mixed = np.minimum.reduceat(doc[by_part], heads) != np.maximum.reduceat(doc[by_part], heads) if len(heads) else np.zeros(0, bool)
    rows = np.flatnonzero(mixed[group])
    if not len(rows):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SPANS], schema=_SPANS)
    pick = np.repeat(ends[rows] - np.r_[0, np.cumsum(size[rows])[:-1]], size[rows]) + np.arange(size[rows].sum())
    context, window = earlier_windows(body[pick], np.r_[0, np.cumsum(size[rows])], group[rows], doc[rows], length)
    order = np.lexsort([window, context])
    context, window = rows[context[order]], window[order]
    new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1)]) if len(context) else np.zeros(0, np.int64)
    stop = np.r_[new[1:], len(context)] - 1 if len(new) else new
    c = context[new]
    columns = [doc[c], key[c], (start[c] + window[new]).astype(np.int32), (window[stop] - window[new] + length).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_SPANS)


@tidy
def _dropped(batches: Iterator[pa.RecordBatch], keep: list[str], texts: bool) -> Iterator[pa.RecordBatch]:
    """Each document without its spans. Rows come by group: packed spans first, then packed documents."""
    group, packed, spans, cuts = None, [], None, {}
    for batch in batches:
        for bucket, body, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "docs"))):
            if bucket != group:
                group, packed, spans = bucket, [], None
            if body is not None:
                packed.append(unpacked_rows(body))
                continue
            if spans is None:
                spans = pa.Table.from_batches(packed, schema=_SPANS)
                doc, key, *spans = (spans.column(c).to_numpy() for c in _SPANS.names)
                order = np.lexsort([key, doc])
                doc, key, spans, packed = doc[order], key[order], [x[order].astype(np.int64) for x in spans], []
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else order
                cuts = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(new.tolist(), np.r_[new[1:], len(doc)].tolist())}
            rows = unpacked_rows(docs)
            for part in by_bytes([rows], "__text", 4 * SLICE):
                yield _without(part, cuts, *spans, keep, texts)


def _without(batch: pa.RecordBatch, cuts: dict[tuple[int, int], tuple[int, int]], start: np.ndarray, size: np.ndarray, keep: list[str], texts: bool) -> pa.RecordBatch:
    flat, ends = byte_buffer(batch.column("__text"))
    removed, spans, digests, kept = [], [], [], []
    for d, at in enumerate(zip(batch.column("__id").to_pylist(), batch.column("__key").to_pylist())):
        text = flat[ends[d] : ends[d + 1]]
        a, b = cuts.get(at, (0, 0))
        if b > a:
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, start[a:b], 1)
            np.add.at(change, start[a:b] + size[a:b], -1)
            gone = np.cumsum(change[:-1]) > 0
            text = text[~gone]
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
        else:
            removed.append(0)
            spans.append(0)
        rest = text.tobytes()
        digests.append(hashlib.sha256(rest).hexdigest())
        if texts:
            kept.append(rest)
    sizes = np.diff(ends)
    arrays = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if texts:
        arrays += [pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]
        names += ["kept", "kept_text"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """The kept columns of docs (the id, unless named), n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256;
    with texts also kept (binary, the remaining bytes) and kept_text (the whole characters among them).

    Texts are UTF-8 bytes; null texts are empty; matches never cross rows. Rows whose id is null neither lose
    bytes nor count as earlier. Rows of one id are one document in this sense: they never lose bytes to each
    other. Empty tables give an empty result.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("key"), F.col(text_col).alias("__text"))
    long = source.filter(F.col("doc_id").isNotNull() & (F.octet_length("__text") >= length))
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    # what a task holds of a bucket or a group stays bounded as the corpus grows
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)
    common = max(COMMON, total // 16 // MOST_COMMON)
    bodies = "bucket bigint, body binary"
    packed = long.mapInArrow(lambda batches: _entries(batches, length, buckets), bodies)
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = stored(spark, dealt.mapInArrow(lambda batches: _shared(batches, common, buckets), _SHARED), "shared")
    everywhere = frozenset(r.hash for r in shared.filter(F.col("hash").isNotNull()).select("hash").collect())  # at most MOST_COMMON by the rule above

    def met(known: DataFrame, asked: DataFrame, doc: str, by: str) -> DataFrame:
        """What is known of documents ahead of the documents, by group."""
        asked = asked.mapInArrow(lambda batches: _packed_documents(batches, doc, by, buckets), bodies)
        both = known.select("bucket", "body", F.lit(None).cast("binary").alias("docs")).unionByName(
            asked.select("bucket", F.lit(None).cast("binary").alias("body"), F.col("body").alias("docs"))
        )
        return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("body").isNull())

    replies = met(shared.filter(F.col("body").isNotNull()), long, "doc_id", "key")
    contexts = replies.mapInArrow(lambda batches: _contexts(batches, length, everywhere), "part bigint, doc_id bigint, key bigint, start int, size int, body binary")
    sorted_parts = contexts.repartition(buckets, "part").sortWithinPartitions("part")
    spans = sorted_parts.mapInArrow(lambda batches: _spans(batches, length, buckets), bodies)
    left = docs.select(*keep, F.col(text_col).alias("__text"), F.col(id_col).cast("bigint").alias("__id"), key.alias("__key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    fields += ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, kept_text string" * texts
    return met(spans, left, "__id", "__key").mapInArrow(lambda batches: _dropped(batches, keep, texts), fields)
