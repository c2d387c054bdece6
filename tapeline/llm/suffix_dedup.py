"""Removal of every byte that a repeated string of ``length`` bytes covers, by a distributed merge sort of suffixes.

A window is a string of ``length`` bytes. Windows in a row whose least gram hash stands at the same place (the first, if
it is met more than once) form a block, and that gram is its anchor. Equal windows have equal anchors at equal places, so only
blocks whose gram occurs twice can repeat (a bit table sized by the input, up to a bound, tells for certain which do not).

For each such block the suffix that begins at its anchor is sorted: behind the gram's hash and up to the end of the
block's last window, then what stands before the anchor, backwards, up to the block's start. Tasks sort them in runs,
front-code them and exchange them by gram; a loser tree merges the runs and knows the common prefix of each contender
with the last winner, so that known prefixes are never compared again. A string met twice repeats whole. Of the strings of one
gram the merge tells the common prefixes of neighbours, both behind and before the anchor: the window with ``l`` bytes
before the anchor repeats if another string agrees in as many bytes before it and in the rest of the window behind it,
that is, if both lie in one interval of common prefixes in either order (``repeated_levels``).

A gram met in many differing contexts would be one task's work. Grams that are frequent in some task (``heavy``) are
therefore dealt by their whole string, and their windows are compared by 64-bit fingerprints (beside the gram's 64) dealt
by the bytes before the anchor, which equal windows share, and by their hash where that is not enough; so are those of any other gram of more than ``GROUP_STRINGS`` strings. Fingerprints stand for bytes there;
the chance that two of N differing windows of one gram collide is about N^2 / 2^65.

Whole copies of a text are found by a hash of 64 bits and enter the sort once a task. Texts are shuffled only in the
last step, and only those that lose some bytes. Parts of the exchange are sized by the input.

Defined results: null text counts as empty; texts shorter than ``length`` lose nothing; null ids are kept; repeated rows
are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.bits import bit_table, bits_for, in_bits
from tapeline.llm.shingles import TOGETHER, U, _tables, mixed
from tapeline.session import saved

LENGTH, GRAM = 200, 32
#: Bits of the table of grams: so many for each expected block, up to the bound (16 MB packed).
TABLE_BITS, TABLE_PARTS, CELLS_PER_BLOCK = 27, 256, 12
#: A task's sorted run ends at this many bytes or suffixes; raw bytes of text to one part of the exchange, and to one task.
RUN_BYTES, RUN_SUFFIXES, PART_BYTES, TASK_BYTES = 24 << 20, 90_000, 2 << 20, 8 << 20
#: A task tells the grams that so large a share of its blocks have, at most this many; of all told, so many stay.
HEAVY_SHARE, HEAVY = 1 / 2000, 4096
#: Differing strings of one gram whose windows one merge compares, and windows of a gram with more in one group that its fingerprints are dealt to.
GROUP_STRINGS, GROUP_WINDOWS = 4096, 100_000
#: Strings whose levels are compared at once.
TOGETHER_STRINGS = 3000
LEAD = 8  # bytes of the gram before each suffix
#: Stands between what is behind the anchor and what is before it; no byte of UTF-8, which Spark's strings are.
MARK = b"\xff"


def sums_of(data: np.ndarray) -> np.ndarray:
    up, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    at = 1
    while 2 * at <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return np.minimum(x[: len(x) - (width - at)], x[width - at :]) if width > at else x


class Blocks:
    """The blocks of some texts laid end to end: gram, start (in ``data``), number of windows, text."""

    def __init__(self, texts: list[bytes], length: int, gram: int) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bytes, self.length = b"".join(texts), length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(sizes) - sizes
        self.sums = sums_of(self.data)
        n = len(self.data) - length + 1
        if n < 1:
            self.gram, self.start, self.windows, self.text, self.grams, self.reach = np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U), length - gram + 1
            return
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * _tables(len(self.sums))[1][: len(self.data) - gram + 1])
        least = sliding_min(grams, length - gram + 1)
        text = np.repeat(np.arange(len(texts)), sizes)
        inside = text[:n] == text[length - 1 :]
        begins = inside & np.concatenate([[True], (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1]) | (text[1:n] != text[: n - 1]) | ~inside[:-1]])
        self.start = np.flatnonzero(begins)
        steps = np.concatenate([[0], np.cumsum(inside)])
        self.windows = np.diff(np.concatenate([steps[self.start], [steps[-1]]]))
        self.gram, self.text, self.grams, self.reach = least[self.start], text[self.start], grams, length - gram + 1

    def anchors(self, some: np.ndarray) -> np.ndarray:
        """Places of the anchors of some blocks: the first of the least grams of each block's first window."""
        first = self.grams[self.start[some][:, None] + np.arange(self.reach)] == self.gram[some][:, None]
        return self.start[some] + first.argmax(axis=1)


def text_blocks(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[Blocks, np.ndarray]]:
    """Blocks of the texts that a task meets, copies of a whole text once, and the texts' keys."""
    seen: set[int] = set()
    run, names, size = [], [], 0
    for batch in batches:
        for tkey, n, text in zip(batch.column("tkey").to_pylist(), batch.column("n").to_pylist(), batch.column("text"), strict=True):
            if n < length or tkey in seen:
                continue
            seen.add(tkey)
            if run and size + n > TOGETHER:
                yield Blocks(run, length, gram), np.array(names, np.int64)
                run, names, size = [], [], 0
            run.append(text.as_buffer().to_pybytes())
            names.append(tkey)
            size += n
    if run:
        yield Blocks(run, length, gram), np.array(names, np.int64)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are equal for sure."""
    low, high, step = known, min(len(a), len(b)), 16
    while low < high:
        stop = min(high, low + step)
        if a[low:stop] != b[low:stop]:
            while stop - low > 1:
                mid = (low + stop) // 2
                if a[low:mid] == b[low:mid]:
                    low = mid
                else:
                    stop = mid
            return low
        low, step = stop, step * 2
    return low


def gram_facts(texts: DataFrame, bits: int, length: int, gram: int) -> tuple[np.ndarray, dict[int, int]]:
    """Packed bits of the cells of the grams that occur twice, and the heavy grams with their least counts, in one pass."""
    width = (1 << bits) // TABLE_PARTS
    names, kinds = ["part", "cells", "gram", "n"], [pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate(waiting), return_counts=True)
            heavy = np.flatnonzero(counts >= max(16, HEAVY_SHARE * counts.sum()))  # 1 / HEAVY_SHARE at most
            found = np.repeat((grams >> U(64 - bits)).astype(np.int64), np.minimum(counts, 2))  # in order; a cell met twice is told twice
            bounds = np.searchsorted(found, np.arange(TABLE_PARTS + 1) * width)
            some = np.flatnonzero(np.diff(bounds))
            cells = [(found[bounds[p] : bounds[p + 1]] - p * width).astype(np.uint32).tobytes() for p in some]
            columns = [[*some.tolist(), *[None] * len(heavy)], [*cells, *[None] * len(heavy)], [*[None] * len(some), *grams[heavy].view(np.int64).tolist()], [*[None] * len(some), *counts[heavy].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for blocks, _ in text_blocks(batches, length, gram):
            waiting.append(blocks.gram)
            size += len(blocks.gram)
            if size > 500_000:
                yield from flush()
                waiting, size = [], 0
        if size:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(part, np.zeros(width, np.uint8))
                got = np.bincount(np.frombuffer(found.as_buffer(), np.uint32), minlength=width)
                np.minimum(own + np.minimum(got, 2).astype(np.uint8), 2, out=own)
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], names=["part", "cells"])

    facts = saved(texts.mapInArrow(run, "part int, cells binary, gram long, n long"))
    out = np.zeros((TABLE_PARTS, width // 8), np.uint8)
    for row in facts.where("part is not null").select("part", "cells").repartition("part").mapInArrow(add, "part int, cells binary").collect():  # 2^bits / 8 bytes
        out[row["part"]] = np.frombuffer(row["cells"], np.uint8)
    heavy = facts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HEAVY).collect()
    return out.reshape(-1), {x["gram"]: x["n"] for x in heavy}


Runs = tuple[bytes, bytes, bytes, bytes, bytes]


def front_coded(strings: dict[bytes, list[tuple[int, int]]]) -> Runs:
    """(common prefixes with the string before, lengths of the tails, numbers of occurrences, occurrences, packed tails) of the strings in order."""
    prefixes, lengths, counts, places, tails, before = [], [], [], [], [], b""
    for s in sorted(strings):
        lcp = common_prefix(before, s)
        prefixes.append(lcp)
        lengths.append(len(s) - lcp)
        counts.append(len(strings[s]))
        places += strings[s]
        tails.append(s[lcp:])
        before = s
    as_bytes = lambda x: zstandard.compress(np.array(x, np.uint32).tobytes(), 3)
    starts = np.array([at for _, at in places], np.uint32)
    where = np.array([text for text, _ in places], np.int64).tobytes() + starts.view(np.uint8).reshape(-1, 4).T.tobytes()
    return as_bytes(prefixes), as_bytes(lengths), as_bytes(counts), zstandard.compress(where, 3), zstandard.compress(b"".join(tails), 3)


def decoded(run: Runs) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(common prefix with the string before, string, occurrences as rows of (text, start))."""
    prefixes, lengths, counts = (np.frombuffer(zstandard.decompress(x), np.uint32).tolist() for x in run[:3])
    where = zstandard.decompress(run[3])
    n = len(where) // 12
    starts = np.ascontiguousarray(np.frombuffer(where, np.uint8, offset=8 * n).reshape(4, n).T).view(np.uint32).reshape(n)
    places = np.stack([np.frombuffer(where, np.int64, n), starts.astype(np.int64)], axis=1)
    at, done, before, tails = 0, 0, b"", zstandard.decompress(run[4])
    for lcp, n, count in zip(prefixes, lengths, counts, strict=True):
        before = before[:lcp] + tails[at : at + n]
        at += n
        yield lcp, before, places[done : done + count]
        done += count


def merged(runs: list) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Loser tree over front-coded runs: (common prefix with the string before, string, occurrences) in order, equal strings apart.

    ``lcps[i]`` is the common prefix of run i's head with the winner that it lost to; a longer one means a smaller head,
    and only heads with equal ones are compared, from there on.
    """
    k = len(runs)
    streams = [decoded(r) for r in runs]
    heads: list[bytes | None] = [None] * k
    lcps, facts = [0] * k, [None] * k

    def advance(i: int) -> None:
        lcps[i], heads[i], facts[i] = next(streams[i], (0, None, None))

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if lcps[i] != lcps[j]:
            return (i, j) if lcps[i] > lcps[j] else (j, i)
        lcp = common_prefix(a, b, lcps[i])
        first = lcp == len(a) or (lcp < len(b) and a[lcp] < b[lcp])
        winner, loser = (i, j) if first else (j, i)
        lcps[loser] = lcp
        return winner, loser

    for i in range(k):
        advance(i)
    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        yield lcps[top], heads[top], facts[top]
        advance(top)
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


class Context:
    """A distinct string of a gram: its two sides of the anchor, the common prefix behind the anchor with the string before, and where it occurs."""

    __slots__ = ("behind", "before", "common", "places")

    def __init__(self, s: bytes, common: int, places: list[np.ndarray]) -> None:
        mark = s.index(MARK, LEAD)
        self.behind, self.before, self.common, self.places = s[LEAD:mark], s[mark + 1 :], max(0, common - LEAD), places

    def count(self) -> int:
        return sum(map(len, self.places))


def by_gram(stream: Iterator[tuple[int, bytes, np.ndarray]]) -> Iterator[tuple[int, list[Context]]]:
    """The distinct strings of each gram in order."""
    gram, group, last = None, [], b""
    for lcp, s, places in stream:
        if lcp == len(s) == len(last):
            group[-1].places.append(places)
            continue
        last = s
        if lcp < LEAD or gram is None:
            if group:
                yield gram, group
            gram, group = int.from_bytes(s[:LEAD], "big"), []
        group.append(Context(s, lcp if group else 0, [places]))
    if group:
        yield gram, group


def repeated_levels(groups: list[list[Context]], length: int, gram: int) -> np.ndarray:
    """For the strings of some grams, one after the other, which windows another string has too: a row of flags for each string, by the bytes before the anchor.

    Two strings agree in ``r`` bytes behind the anchor if no neighbours between them, in sorted order, have a shorter common
    prefix; likewise before it. So the numbers of shorter ones so far name the intervals, and windows with the same pair of
    intervals are equal.
    """
    every = [c for g in groups for c in g]
    n, levels = len(every), np.arange(length - gram + 1)
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    behind = np.array([len(c.behind) for c in every])
    before = np.array([len(c.before) for c in every])
    common = np.array([c.common for c in every])  # 0 for the first of a gram
    order = sorted(range(n), key=lambda i: (group_of[i], every[i].before))
    left = np.zeros(n, np.int64)
    for at in range(1, n):
        i, j = order[at - 1], order[at]
        left[at] = common_prefix(every[i].before, every[j].before) if group_of[i] == group_of[j] else -1
    left[0] = -1
    right_of = np.cumsum(common[:, None] < length - levels, axis=0, dtype=np.int32)
    left_of = np.empty_like(right_of)
    left_of[order] = np.cumsum(left[:, None] < levels, axis=0, dtype=np.int32)
    real = (before[:, None] >= levels) & (behind[:, None] >= length - levels)
    row, level = np.nonzero(real)
    name = (right_of[row, level].astype(np.int64) * (n + 1) + left_of[row, level]) * len(levels) + level
    _, at, counts = np.unique(name, return_inverse=True, return_counts=True)
    out = np.zeros(real.shape, bool)
    out[row, level] = counts[at] > 1
    return out


def removed_runs(texts: DataFrame, total: int, length: int, gram: int) -> DataFrame:
    """tkey, starts, stops: the maximal runs of bytes to remove from each text that has some, whole copies apart; ``total``: bytes of the distinct texts."""
    context, spark = texts.sparkSession.sparkContext, texts.sparkSession
    bits = min(TABLE_BITS, max(16, (CELLS_PER_BLOCK * 2 * (total // (length - gram + 2))).bit_length()))
    table, heavy_counts = gram_facts(texts, bits, length, gram)
    twice, heavy = context.broadcast(table), context.broadcast({g & (2**64 - 1): n for g, n in heavy_counts.items()})
    n_parts = max(256, total // PART_BYTES)
    n_tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often, run, size = twice.value, heavy.value, {}, 0

        def flush() -> pa.RecordBatch:
            by_part: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
            for s, places in run.items():
                g = int.from_bytes(s[:LEAD], "big")
                by_part.setdefault((zlib.crc32(s) if g in often else g & 0xFFFFFFFF) % n_parts, {})[s] = places
            columns = list(zip(*((part, *front_coded(x)) for part, x in by_part.items()), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "prefixes", "lengths", "counts", "places", "tails"])

        for blocks, names in text_blocks(batches, length, gram):
            some = np.flatnonzero(in_bits(table, bits, blocks.gram))
            text = blocks.text[some]
            facts = (blocks.gram[some], blocks.start[some], blocks.anchors(some), blocks.windows[some], names[text], blocks.start[some] - blocks.offsets[text])
            for g, a, m, w, t, place in zip(*(x.tolist() for x in facts), strict=True):
                s = g.to_bytes(LEAD, "big") + blocks.bytes[m : a + w + length - 1] + MARK + blocks.bytes[a:m][::-1]
                if s in run:
                    run[s].append((t, place))
                else:
                    run[s] = [(t, place)]
                    size += len(s)
                if size > RUN_BYTES or len(run) >= RUN_SUFFIXES:
                    yield flush()
                    run, size = {}, 0
        if run:
            yield flush()

    found_names = ["tkeys", "starts", "stops", "gram", "deal", "hashes", "places"]
    found_kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    found_schema = "tkeys binary, starts binary, stops binary, gram long, deal int, hashes binary, places binary"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Intervals to remove, and fingerprints of the windows of grams with many strings."""
        often = heavy.value
        tkeys: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        stops: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if tkeys:
                row = [[np.concatenate(x).tobytes()] for x in (tkeys, starts, stops)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*row, [None], [None], [None], [None]], found_kinds, strict=True)], names=found_names)
                for x in (tkeys, starts, stops):
                    x.clear()

        def take(c: Context, first: int, last: int) -> None:
            """The windows from first to last bytes before the anchor repeat, wherever the string occurs."""
            for places in c.places:
                at = places[:, 1] + len(c.before)
                tkeys.append(places[:, 0])
                starts.append(at - first)
                stops.append(at - last + length)

        def compare(groups: list[list[Context]]) -> None:
            every = [c for g in groups for c in g]
            flags = np.pad(repeated_levels(groups, length, gram), ((0, 0), (1, 1)))
            edges = np.diff(flags.astype(np.int8), axis=1)
            for i, last, first in zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1, strict=True):
                if every[i].count() == 1:
                    take(every[i], int(first), int(last))

        def dealt(g: int, group: list[Context]) -> Iterator[pa.RecordBatch]:
            """The fingerprints of a gram with many strings, dealt by bands of the bytes before the anchor (and by hash) to groups of bounded size."""
            n = max(len(group), often.get(g, 0))
            width, split = max(1, GROUP_WINDOWS // n), -(-n // GROUP_WINDOWS)
            signed = int(np.array([g], U).view(np.int64)[0])
            rows: list[tuple] = []
            for low in range(0, len(group), 512):
                some = group[low : low + 512]
                whole = [c.before[::-1] + c.behind for c in some]
                sums, at = sums_of(np.frombuffer(b"".join(whole), np.uint8)), 0
                for c, w in zip(some, whole, strict=True):
                    start = at + np.arange(len(w) - length + 1)
                    at += len(w)
                    own = hashes(sums, start, start + length)
                    tkey, place = c.places[0][0].tolist()
                    band = (len(c.before) - np.arange(len(own))) // width
                    deal = (band * split + (mixed(own) % U(split)).astype(np.int64)).astype(np.int32)
                    for k in np.unique(deal).tolist():
                        mine = np.flatnonzero(deal == k).astype(np.int32)
                        rows.append((np.int64(tkey).tobytes(), np.int64(place).tobytes(), None, signed, k, own[mine].tobytes(), mine.tobytes()))
            for low in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[low : low + 2000], strict=True), found_kinds, strict=True)], names=found_names)

        def finish(runs: list) -> Iterator[pa.RecordBatch]:
            waiting, size = [], 0
            for g, group in by_gram(merged(runs)):
                for c in group:
                    if c.count() > 1:
                        take(c, len(c.before), length - len(c.behind))
                if g in often or len(group) > GROUP_STRINGS:
                    yield from dealt(g, group)
                elif len(group) > 1:
                    waiting.append(group)
                    size += len(group)
                    if size > TOGETHER_STRINGS:
                        compare(waiting)
                        waiting, size = [], 0
                if len(tkeys) > 20_000:
                    yield from packed()
            if waiting:
                compare(waiting)
            yield from packed()

        part, runs = None, []
        for batch in batches:
            for p, *run in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if p != part and runs:
                    yield from finish(runs)
                    runs = []
                part = p
                runs.append(tuple(run))
        if runs:
            yield from finish(runs)

    run_schema = "part int, prefixes binary, lengths binary, counts binary, places binary, tails binary"
    found = saved(texts.mapInArrow(sorted_runs, run_schema).repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(merge, found_schema))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], names=["tkey", "start", "stop"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows that another block of the gram has too; the windows of one block differ from each other."""
        group, held = None, []

        def finish(out: list[tuple[int, int, int]]) -> None:
            if len(held) < 2:
                return
            every = [np.frombuffer(x[2], U) for x in held]
            values, counts = np.unique(np.concatenate(every), return_counts=True)
            twice_met = values[counts > 1]
            if not len(twice_met):
                return
            for (tkey, start, _, places), own in zip(held, every, strict=True):
                hit = np.flatnonzero(twice_met[np.minimum(np.searchsorted(twice_met, own), len(twice_met) - 1)] == own)
                if len(hit):
                    at = np.frombuffer(places, np.int32)[hit]
                    breaks = np.flatnonzero(np.diff(at) > 1)
                    for low, high in zip(at[np.concatenate([[0], breaks + 1])].tolist(), at[np.concatenate([breaks, [len(at) - 1]])].tolist(), strict=True):
                        out.append((int.from_bytes(tkey, "little", signed=True), int.from_bytes(start, "little") + low, int.from_bytes(start, "little") + high + length))

        def pack(out: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["tkey", "start", "stop"])

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for g, deal, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (g, deal) != group:
                    finish(out)
                    group, held = (g, deal), []
                held.append(row)
            yield from pack(out)
        out = []
        finish(out)
        yield from pack(out)

    fields = "tkey long, start long, stop long"
    told = found.where("deal is null").select("tkeys", "starts", "stops").mapInArrow(unpacked, fields)
    many = found.where("deal is not null").select("gram", "deal", "tkeys", "starts", "hashes", "places").repartition("gram", "deal").sortWithinPartitions("gram", "deal")
    every = told.unionByName(many.mapInArrow(repeated, fields))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, starts, stops = None, [], []
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["tkey", "starts", "stops"]
        for batch in batches:
            out: list[tuple] = []
            for tkey, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if tkey != text:
                    if text is not None:
                        out.append((text, starts, stops))
                    text, starts, stops = tkey, [], []
                if stops and start <= stops[-1]:
                    stops[-1] = max(stops[-1], stop)
                else:
                    starts.append(start)
                    stops.append(stop)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if text is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((text, starts, stops), kinds, strict=True)], names=names)

    return every.repartition("tkey").sortWithinPartitions("tkey", "start").mapInArrow(joined, "tkey long, starts array<long>, stops array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, starts, stops (runs removed, in bytes), kept_sha256 of every row."""
    context = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("tkey"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    distinct = saved(texts.where(F.col("n") >= length).groupBy("tkey", "n").agg(F.count("*").alias("rows")))
    copies = distinct.where("rows > 1").select("tkey", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n").alias("stops"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    runs = saved(removed_runs(texts.select("tkey", "n", "text"), total, length, gram).join(copies.select("tkey"), "tkey", "left_anti"))
    width = bits_for(runs.count())
    bits = context.broadcast(bit_table(runs.select("tkey"), width))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that may lose bytes go on; the others' digests are made here."""
        for batch in batches:
            keep = in_bits(bits.value, width, mixed(batch.column("tkey").to_numpy().view(U)))
            column = batch.column("text")
            own = [None if k else hashlib.sha256(t.as_buffer() or b"").hexdigest() for k, t in zip(keep, column, strict=True)]
            some = pa.array([t.as_buffer().to_pybytes() if k else None for k, t in zip(keep, column, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tkey", "n")), pa.array(own, pa.string()), some], names=["doc_id", "tkey", "n", "own", "text"])

    rows = texts.mapInArrow(digest, "doc_id long, tkey long, n long, own string, text binary").join(copies.unionByName(runs), "tkey", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, starts, stops, t in zip(batch.column("own").to_pylist(), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), batch.column("text"), strict=True):
                if own is None or starts:
                    kept, at, whole = hashlib.sha256(), 0, t.as_buffer() or b""
                    whole = memoryview(whole)
                    for start, stop in zip(starts or (), stops or (), strict=True):
                        kept.update(whole[at:start])
                        at = stop
                    kept.update(whole[at:])
                    own = kept.hexdigest()
                out.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "starts", "stops")), pa.array(out, pa.string())], names=["doc_id", "n_bytes", "starts", "stops", "kept_sha256"])

    return rows.select("doc_id", "n", "own", "starts", "stops", "text").mapInArrow(cut, "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept_sha256 string")


def summary(cut: DataFrame) -> DataFrame:
    """The columns that the contract names."""
    lost = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("doc_id", "n_bytes", F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256")
