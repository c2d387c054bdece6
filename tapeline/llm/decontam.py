"""Benchmark decontamination by SimHash of item-sized windows.

Items are put into classes of length (each a tenth longer than the one before), and for every class a window of as many
words slides over every text, word by word; an item is indexed by its first words, as many as its class has, so that
an exact copy agrees in all bits. A window's 64-bit SimHash over words comes from running sums that hold eight bit
counters in one integer. Fingerprints are cut into blocks, and two of them within ``RADIUS`` differ by at most ``RADIUS // blocks`` bits in
one of these, so looking up the values within that distance of an item's, block by block, loses none. A block's index is a bit table of these
values, which most windows do not pass, and their sorted list with the items they stand for, which names the items that a window is compared
with; no others are. With three blocks of 21 and 22 bits some thousandths of all pairs are compared, however many items there are. Pairs of fingerprints are compared in pieces of ``PAIRS``. Windows that pass are verified by the exact
weighted Jaccard similarity (weights: occurrences) of five-word shingles, 0.75 or more, of the whole item and as many
words of the text from the window's start or its neighbours. A text that is shorter than an item has no such window and is compared with the
items that hold one of its shingles.

Items longer than ``LONGEST`` words are looked up by parts of that length, the last one overlapping the one before; what a
part finds is verified as the whole item, from as many words before the hit as stand before the part. The items go to all tasks in blocks of about
``ITEM_BLOCK`` items and ``ITEM_BYTES`` bytes at most; a larger benchmark takes more passes. Texts are scanned in place, without a shuffle.

Defined results: null or blank texts and items match nothing; texts shorter than an item are compared whole; null ids are
kept; repeated rows are reported each; empty tables give no rows; other columns are ignored (``clean_rows`` passes them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.shingles import U, chunks, shingle_hashes, word_hashes
from tapeline.llm.tasks import lean

K = 5
SIMILARITY = 0.75
RADIUS = 8
#: Bits of the blocks.
BITS = (21, 21, 22)
LONGEST = 120
#: Pairs of fingerprints that are compared together.
PAIRS = 1 << 20
ITEM_BLOCK, ITEM_BYTES = 20_000, 16 << 20
#: Windows handled together, so that their counters stay in the processor's cache.
SLICE = 16_384
#: Words to either side of a candidate window at which it is verified too.
AROUND = 1

_ONES, _HIGH = U(0x0101010101010101), U(0x8080808080808080)


def lanes(words: np.ndarray) -> np.ndarray:
    """Running sums of the hash bits: row i counts bits i, i + 8, ... of all words before, a byte each, modulo 2^64."""
    out = np.zeros((8, len(words) + 1), U)
    for i in range(8):
        np.cumsum((words >> U(i)) & _ONES, out=out[i, 1:])
    return out


def window_hashes(sums: np.ndarray, length: int, start: int, stop: int) -> np.ndarray:
    """SimHash of the windows of ``length`` words that begin at start..stop-1: the majority of each bit."""
    out = np.zeros(stop - start, U)
    least = _ONES * U(127 - length // 2)
    for i in range(8):
        count = sums[i, start + length : stop + length] - sums[i, start:stop]
        count += least
        count &= _HIGH
        count >>= U(7 - i)
        out |= count
    return out


def _masks(bits: int, distance: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``distance`` of them set."""
    found = {0}
    for _ in range(distance):
        found |= {x | (1 << i) for x in found for i in range(bits)}
    return np.array(sorted(found), np.uint32)


class Block:
    """One block of the items' fingerprints: which values are near an item's, and to which items."""

    def __init__(self, prints: np.ndarray, shift: int, bits: int, distance: int) -> None:
        self.shift, self.mask = U(shift), U((1 << bits) - 1)
        near = (self.values(prints)[:, None] ^ _masks(bits, distance)[None, :]).astype(U) << U(32) | np.arange(len(prints), dtype=U)[:, None]
        near = np.sort(near, axis=None)
        self.sorted, self.items = (near >> U(32)).astype(np.uint32), near.astype(np.uint32).astype(np.int32)
        table = np.zeros(1 << bits, bool)
        table[self.sorted] = True
        self.table = np.packbits(table, bitorder="little")

    def values(self, prints: np.ndarray) -> np.ndarray:
        return ((prints >> self.shift) & self.mask).astype(np.uint32)

    def passes(self, values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[values >> 3] >> (values & 7).astype(np.uint8) & 1)

    def pairs(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``values``, item) of all that meet, in pieces."""
        low, high = np.searchsorted(self.sorted, values), np.searchsorted(self.sorted, values, side="right")
        counts = high - low
        ends = np.cumsum(counts)
        first = 0
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
            n = counts[first:last]
            place = np.repeat(np.arange(first, last), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield place, self.items[low[place] + step]
            first = last


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def shingle_counts(words: np.ndarray) -> Counter:
    values, _ = shingle_hashes(words, np.array([len(words)]), K)
    return Counter(values.tolist())


def length_class(n: int) -> int:
    """The largest length of the series 1, 2, ... (each a tenth longer, rounded up) that is at most n."""
    at = 1
    while (longer := max(at + 1, at * 11 // 10)) <= n:
        at = longer
    return at


class ItemIndex:
    """The items (or parts) of one class of length, by blocks of the fingerprints of their first words."""

    def __init__(self, length: int, parts: list[tuple[int, int, np.ndarray]]) -> None:
        self.length = length
        self.items = [item for item, _, _ in parts]
        self.offsets = [offset for _, offset, _ in parts]
        self.sizes = [len(whole) for *_, whole in parts]
        whole_counts: dict[int, Counter] = {}
        for *_, whole in parts:  # the parts of an item share its array
            if id(whole) not in whole_counts:
                whole_counts[id(whole)] = shingle_counts(whole)
        self.shingles = [whole_counts[id(whole)] for *_, whole in parts]
        self.prints = np.array([window_hashes(lanes(whole[offset : offset + length]), length, 0, 1)[0] for _, offset, whole in parts], U)
        self.blocks = [Block(self.prints, sum(BITS[:b]), n, RADIUS // len(BITS)) for b, n in enumerate(BITS)]
        held = [np.fromiter(x, U, len(x)) for x in self.shingles]
        order = np.argsort(np.concatenate(held), kind="stable")
        self.held = np.concatenate(held)[order]
        self.holders = np.repeat(np.arange(len(parts)), [len(x) for x in held])[order]
        self.windows = self.compared = 0

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, item) of all fingerprints and items within the radius; some come more than once."""
        self.windows += len(prints)
        for block in self.blocks:
            values = block.values(prints)
            passing = block.passes(values)
            for place, item in block.pairs(values[passing]):
                self.compared += len(item)
                close = np.bitwise_count(prints[passing[place]] ^ self.prints[item]) <= RADIUS
                yield passing[place[close]], item[close]

    def holding(self, words: np.ndarray) -> np.ndarray:
        """Items that hold half of the shingles of a short text, or more."""
        own = np.fromiter(x := shingle_counts(words), U, len(x))
        low, high = np.searchsorted(self.held, own), np.searchsorted(self.held, own, side="right")
        found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.holders[a:b] for a, b in zip(low, high, strict=True))]), return_counts=True)
        return found[2 * n >= len(own)]


def item_parts(rows: list[tuple[int, str | None]]) -> dict[int, list[tuple[int, int, np.ndarray]]]:
    """(item, first word of the part, words of the whole item) by class of length."""
    words, counts = word_hashes([(text or "").encode() for _, text in rows])
    out: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    at = 0
    for (item, _), n in zip(rows, counts.tolist(), strict=True):
        whole = words[at : at + n]
        for start in range(0, n, LONGEST):
            out.setdefault(length_class(min(n, LONGEST)), []).append((item, max(0, min(start, n - LONGEST)), whole))
        at += n
    return out


class Items:
    """Benchmark items as they are sent to all tasks; a worker builds the indexes once."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.parts = item_parts(rows)

    @cached_property
    def indexes(self) -> list[ItemIndex]:
        return [ItemIndex(n, x) for n, x in sorted(self.parts.items())]


def find(texts: list[bytes], indexes: list[ItemIndex]) -> dict[tuple[int, int], tuple[float, int]]:
    """(place of the text, item) -> (best similarity, first word of that window)."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    text_of = np.repeat(np.arange(len(texts)), counts)
    sums, found = lanes(words), {}
    known: dict[tuple[int, int, int], float] = {}  # parts of one item lead to the same windows

    def verify(text: int, start: int, index: ItemIndex, item: int) -> None:
        if found.get((text, index.items[item]), (0.0, 0))[0] == 1:
            return  # windows come in order: an earlier copy is there
        size, best, goal = index.sizes[item], (0.0, 0), index.shingles[item]
        start -= index.offsets[item]
        for shift in sorted(range(-AROUND, AROUND + 1), key=abs):
            a = max(begins[text], start + shift)
            place = (text, id(goal), int(a))
            if place not in known:
                known[place] = similarity(shingle_counts(words[a : min(ends[text], a + size)]), goal)
            best = max(best, (known[place], -int(a - begins[text])))
            if best[0] == 1 or best[0] < SIMILARITY - 0.2:  # a shift by a word cannot make up for more
                break
        key = (text, index.items[item])
        if best[0] >= SIMILARITY and best > found.get(key, (0.0, 0)):
            found[key] = best

    for index in indexes:
        n = index.length
        for start in range(0, len(words) - n + 1, SLICE):
            stop = min(start + SLICE, len(words) - n + 1)
            inside = text_of[start:stop] == text_of[start + n - 1 : stop + n - 1]
            places = start + np.flatnonzero(inside)
            for place, item in index.near(window_hashes(sums, n, start, stop)[inside]):
                for first, own in zip(places[place].tolist(), item.tolist(), strict=True):
                    verify(int(text_of[first]), first, index, own)
        for text in np.flatnonzero((counts < n) & (counts >= SIMILARITY * n)):
            for item in index.holding(words[begins[text] : ends[text]]).tolist():
                verify(int(text), int(begins[text]), index, item)
    return {key: (s, -a) for key, (s, a) in found.items()}


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size.n // ITEM_BLOCK), -(-size.bytes // ITEM_BYTES))
    for i in range(n_blocks):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i).collect()]


def _shared(docs: DataFrame, rows: list[tuple[int, str | None]]):
    return docs.sparkSession.sparkContext.broadcast(Items(rows))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word: every pair of a text and an item that it holds."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(rows: list[tuple[int, str | None]]) -> DataFrame:
        parts = _shared(docs, rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = parts.value.indexes
            for batch in batches:
                ids = batch.column("doc_id")
                for at, texts in chunks(batch.column("text")):
                    if found := find(texts, indexes):
                        columns = list(zip(*((ids[at + t].as_py(), item, s, first) for (t, item), (s, first) in sorted(found.items())), strict=True))
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word"])

        return texts.mapInArrow(lean(run), "doc_id long, item_id long, similarity double, first_word long")

    return reduce(DataFrame.unionByName, map(scan, _item_blocks(items)))


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    place = docs.columns.index(text_col)
    for rows in _item_blocks(items):
        parts = _shared(docs, rows)

        def run(batches: Iterator[pa.RecordBatch], parts=parts) -> Iterator[pa.RecordBatch]:
            indexes = parts.value.indexes
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, texts in chunks(batch.column(place)):
                    keep[[at + t for t, _ in find(texts, indexes)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
