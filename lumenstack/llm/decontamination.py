"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; windows of the words that result are hashed and
joined with those of the benchmark. Along one alignment of a document and an item most slots must agree:
a value of the item always stands where the same value of the document stands. So a question with
other numbers and names is caught, and a chance mixture isn't.

Documents' windows are first held against a bit table of fixed size made of the benchmark's hashes, so
only what may match enters the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenstack.llm.textbatch import tidy

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?:][\"'”’)\]]*$")
# Words for small numbers and common units.
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg ton tons pound pounds ounce ounces l ml liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur kmh mph".split()
)
LITERAL, NUMBER, CAPITAL, UNIT = 0, 1, 2, 3
#: Bits of the table that documents' windows are held against: 2 MB, whatever the benchmark's size.
TABLE_BITS = 1 << 24
#: The share of slots that must follow one map; by how many words the shift of an alignment may move from one window to the next.
AGREEING, DRIFT = 0.75, 8
MOST_HELD, SLICE_CHARS = 1_000_000, 4_000_000


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Lexicon:
    """What the stretches between white space hold: for each its tokens, for each token its hash, kind and surface."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.first, self.count = [], []
        self.hashes, self.kinds, self.ends, self.surfaces = [], [], [], []

    def add(self, stretch: str) -> int:
        self.first.append(len(self.hashes))
        tokens = list(TOKEN.finditer(stretch))
        self.count.append(len(tokens))
        for k, t in enumerate(tokens):
            word = t.group()
            low = word.lower()
            rest = stretch[t.end() : tokens[k + 1].start() if k + 1 < len(tokens) else None]
            kind = NUMBER if word[0].isdigit() or low in NUMBER_WORDS else UNIT if low in UNITS else CAPITAL if word[0].isupper() else LITERAL
            self.hashes.append(_hash(low))
            self.kinds.append(kind)
            self.ends.append(bool(SENTENCE_END.search(rest)) if rest else False)
            self.surfaces.append(low)
        self.number[stretch] = len(self.count) - 1
        return len(self.count) - 1

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers of all texts in turn, the tokens before each text)."""
        if len(self.number) > MOST_HELD:
            self.__init__()
        known, add, runs, found = self.number, self.add, [0], []
        for text in texts:
            found += [known[s] if s in known else add(s) for s in text.split()]
            runs.append(len(found))
        stretch = np.array(found, np.int64)
        count = np.array(self.count, np.int64)[stretch] if len(stretch) else stretch
        before = np.r_[0, np.cumsum(count)]
        tokens = np.repeat((np.array(self.first, np.int64)[stretch] if len(stretch) else stretch) - before[:-1], count) + np.arange(before[-1])
        return tokens, before[np.array(runs)]


def template_windows(lexicon: Lexicon, texts: list[str], window: int, least_literals: int, least_named: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of two readings: (hash, text, unit) of each window with enough literal words, then the units and what they hold.

    A unit is a literal word, a unit word, or a run of numbers or names inside a sentence. The first reading takes a
    sentence's first word literally; the second takes a capital one as a name, and has only the windows with such a word.
    """
    tokens, runs = lexicon.tokens(texts)
    kind = np.array(lexicon.kinds, np.int8)[tokens] if len(tokens) else np.zeros(0, np.int8)
    ends = np.array(lexicon.ends, bool)[tokens] if len(tokens) else np.zeros(0, bool)
    opens = np.r_[True, ends[:-1]] if len(tokens) else ends
    opens[runs[:-1][runs[:-1] < len(tokens)]] = True
    after_number = np.r_[False, kind[:-1] == NUMBER] & ~opens if len(tokens) else opens
    opener = (kind == CAPITAL) & opens
    plain = np.where((kind == NUMBER) | ((kind == CAPITAL) & ~opens) | ((kind == UNIT) & after_number), kind, LITERAL).astype(np.int8)
    hashes = np.array(lexicon.hashes, np.uint64)[tokens] if len(tokens) else np.zeros(0, np.uint64)
    for named in (False, True):
        slot = np.where(opener, np.int8(CAPITAL), plain) if named else plain
        goes_on = np.r_[False, (slot[1:] == slot[:-1]) & ((slot[1:] == NUMBER) | (slot[1:] == CAPITAL))] & ~opens if len(slot) else opens
        starts = np.flatnonzero(~goes_on)
        slot = slot[starts]
        h = hashes[starts]
        for is_kind, placeholder in ((NUMBER, "<number>"), (CAPITAL, "<name>"), (UNIT, "<unit>")):
            h[slot == is_kind] = _hash(placeholder)
        n = max(0, len(h) - window + 1)
        literals = np.r_[0, np.cumsum(slot == LITERAL)]
        text = np.searchsorted(runs, starts[:n], "right") - 1
        fits = (starts[window - 1 : window - 1 + n] < runs[text + 1]) & (literals[window : window + n] - literals[:n] >= (least_named if named else least_literals))
        if named:
            opened = np.r_[0, np.cumsum(opener[starts])]
            fits &= opened[window : window + n] > opened[:n]
        at = np.flatnonzero(fits)
        total = np.zeros(len(at), np.uint64)
        for k in range(window):
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield total, text[at], at, np.r_[starts, len(tokens)], slot, runs, tokens, opener


_SLOTS = "slots array<struct<at: int, value: string, opens: boolean>>"
_SLOT = pa.struct([("at", pa.int32()), ("value", pa.string()), ("opens", pa.bool_())])
_WINDOWS = f"id bigint, h bigint, at int, n int, {_SLOTS}"


@tidy
def _windows(batches: Iterator[pa.RecordBatch], window: int, least_literals: int, least_named: int, table) -> Iterator[pa.RecordBatch]:
    """at: the window's first word; n: the first words of the text's windows, counted for items only."""
    lexicon = Lexicon()
    bits = None if table is None else np.frombuffer(table.value, np.uint64)
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("text").to_pylist()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_CHARS):
                size += len(texts[last])
                last += 1
            readings = template_windows(lexicon, texts[first:last], window, least_literals, least_named)
            count = np.zeros(last - first, np.int64)
            if bits is None:
                readings = list(readings)
                words = np.unique(np.concatenate([r[3][r[2]] for r in readings]))
                count = np.bincount(np.searchsorted(readings[0][5], words, "right") - 1, minlength=last - first)
            for h, text, at, starts, slot, runs, tokens, opener in readings:
                if bits is not None:
                    place = h & np.uint64(TABLE_BITS - 1)
                    some = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    h, text, at = h[some], text[some], at[some]
                surfaces = lexicon.surfaces
                slots = [
                    [
                        {"at": int(starts[u] - runs[t]), "value": " ".join(surfaces[w] for w in tokens[starts[u] : starts[u + 1]]), "opens": bool(opener[starts[u]])}
                        for u in range(q, q + window)
                        if slot[u] != LITERAL
                    ]
                    for q, t in zip(at.tolist(), text.tolist())
                ]
                begins = (starts[at] - runs[text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + text]), pa.array(h.view(np.int64)), pa.array(begins), pa.array(count[text].astype(np.int32)), pa.array(slots, pa.list_(_SLOT))],
                    names=["id", "h", "at", "n", "slots"],
                )
            first = last


def _bit_table(hashes: DataFrame) -> bytes:
    """A bit for each hash, set by aggregation; at most TABLE_BITS / 64 words reach the driver."""
    place = F.col("h").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {TABLE_BITS - 1}) & 63 as int))")).alias("bits"))
    table = np.zeros(TABLE_BITS // 64, np.int64)
    for row in words.collect():
        table[row.word] = row.bits
    return table.tobytes()


def consistent(met: list[tuple], enough) -> bool:
    """True if the slots of matched windows agree.

    Most of the slots, a share of AGREEING, must follow one map from item values to document values; several item values may
    have the same document value. Else windows whose slots are all equal must be enough by themselves, and such a share of
    all. A sentence's first word that is the same in both is no slot here.
    """
    slots = {}
    equal = set()
    for item_at, _, item_slots, doc_slots in met:
        pairs = [(i["at"], i["value"], d["value"]) for i, d in zip(item_slots, doc_slots) if not (i["opens"] and i["value"] == d["value"])]
        slots.update({at: (x, y) for at, x, y in pairs})
        if all(x == y for _, x, y in pairs):
            equal.add(item_at)
    most: dict[str, int] = {}
    for (x, _), k in Counter(slots.values()).items():
        most[x] = max(k, most.get(x, 0))
    if sum(most.values()) >= AGREEING * len(slots):
        return True
    return enough(len(equal)) and len(equal) >= AGREEING * len({m[0] for m in met})


def chains(met: list[tuple]) -> Iterator[list[tuple]]:
    """Longest runs of windows that advance in item and document alike, where from one to the next the shift moves by DRIFT words at most.

    Windows come in the document's order. Of each place of the item the last window before is the one to go on from.
    """
    places = sorted({m[0] for m in met})
    number = {p: k for k, p in enumerate(places)}
    item_at = np.array(places)
    doc_at, length, last = np.full(len(places), -1), np.zeros(len(places), int), np.full(len(places), -1)
    before, used, found = [], np.zeros(len(met), bool), []
    for k, m in enumerate(met):
        p = number[m[0]]
        shift = (m[1] - m[0]) - (doc_at[:p] - item_at[:p])
        near = np.flatnonzero((last[:p] >= 0) & (doc_at[:p] < m[1]) & (np.abs(shift) <= DRIFT))
        best = int(near[length[near].argmax()]) if len(near) else -1
        before.append(int(last[best]) if best >= 0 else -1)
        if best >= 0:
            used[last[best]] = True
        doc_at[p], length[p], last[p] = m[1], 1 + (length[best] if best >= 0 else 0), k
    for k in np.flatnonzero(~used).tolist():
        chain = []
        while k >= 0:
            chain.append(met[k])
            k = before[k]
        yield chain


_FOUND = "doc_id bigint, item_id bigint, matched bigint, coverage double, changed boolean"


@tidy
def _judged(batches: Iterator[pa.RecordBatch], least_coverage: float, least_run: int) -> Iterator[pa.RecordBatch]:
    """Batches of met windows sorted by document, item and place in the document; a pair may run over several."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64()), ("changed", pa.bool_())])

    def judge(key: tuple, rows: list[dict]) -> list[tuple]:
        item_n = max(r["item_n"] for r in rows)
        enough = lambda n: n >= least_coverage * item_n or n >= least_run
        if not enough(len({r["item_at"] for r in rows})):
            return []
        both: dict[tuple, tuple[list, list]] = {}  # the readings of one place together
        for r in rows:
            item_slots, doc_slots = both.setdefault((r["doc_at"], r["item_at"]), ([], []))
            item_slots += r["item_slots"]
            doc_slots += r["doc_slots"]
        met = [(item_at, doc_at, *slots) for (doc_at, item_at), slots in both.items()]
        shifts: dict[int, list[tuple]] = {}
        for m in met:
            shifts.setdefault(m[1] - m[0], []).append(m)
        best = None
        for part in [*shifts.values(), *chains(met)]:
            n = len({m[0] for m in part})
            if enough(n) and (best is None or n >= best[0]) and consistent(part, enough):
                same = all(i["value"] == d["value"] for m in part for i, d in zip(m[2], m[3]))
                best = max(best or (0, False), (n, same))
        return [(*key, best[0], best[0] / item_n, not best[1])] if best else []

    key, held = None, []
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if (r["doc_id"], r["item_id"]) != key:
                found += judge(key, held) if held else []
                key, held = (r["doc_id"], r["item_id"]), []
            held.append(r)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], schema=schema)
    found = judge(key, held) if held else []
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], schema=schema)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 5,
    least_literals: int = 3,
    least_named: int = 2,
    least_coverage: float = 0.5,
    least_run: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, matched, coverage, changed.

    Along one alignment, `matched` of the item's windows occur in the document with consistent slots: at least the share
    `least_coverage` of them, or at least `least_run`. changed: a slot has another value than in the item. Rows
    whose id or text is null, and texts with fewer words than a window, match nothing, as do windows with fewer
    than `least_literals` words that are no slots (`least_named` where a sentence's first word is read as a name).
    Repeated rows and items count once. Empty tables give no rows.
    """
    spark = docs.sparkSession

    def source(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")

    items = source(benchmark, item_col, item_text_col).mapInArrow(lambda b: _windows(b, window, least_literals, least_named, None), _WINDOWS)
    items = items.select(F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), F.col("n").alias("item_n"), F.col("slots").alias("item_slots"))
    table = spark.sparkContext.broadcast(_bit_table(items.select("h")))
    found = source(docs, id_col, text_col).mapInArrow(lambda b: _windows(b, window, least_literals, least_named, table), _WINDOWS)
    found = found.select(F.col("id").alias("doc_id"), "h", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    met = found.join(items, "h").select("doc_id", "item_id", "item_at", "doc_at", "item_n", "item_slots", "doc_slots")
    dealt = met.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "doc_at", "item_at")
    return dealt.mapInArrow(lambda b: _judged(b, least_coverage, least_run), _FOUND)
