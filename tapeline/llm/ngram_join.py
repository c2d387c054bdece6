"""Exact Jaccard join of documents as sets of word shingles, by pivots in the Jaccard metric space.

Pivots, Voronoi regions, triangle-inequality windows and recursion, in this order:

1. *Pivots.* Nearly all pairs of texts have distance 1, so pivots drawn from the whole corpus would put every document on
   the boundary of every region. Pivots are therefore local. Every document offers the head of its sorted set, rarest
   shingles first (by a hashed count table, ties by hash); two sets within distance 0.25 share at least a twentieth
   of the smaller one in their heads. The holder of the least hash is the pivot of a shared shingle, and only documents that share a shingle
   with a pivot can be nearer to it than distance 1.
2. *Voronoi regions.* Each document goes to the region of its nearest pivot, by the distance that the heads allow at
   least. Members within 0.25 of their pivot are settled by that one exact comparison.
3. *Windows.* In a region, two members can only be linked if their exact distances to the pivot differ by at most 0.25;
   others are not compared.
4. *Boundary.* A document that can be linked to a member of another component (by the bound of the heads) is copied into
   each region in which that is so, and these are joined like the first.
5. *Recursion.* A region too large for a task gets pivots of its own (``split_region``), exact distances to them, balls of
   radius 0.25 and copies of the members within 0.5, and its parts are cut again until they fit; members far from all
   pivots for ``ROUNDS`` rounds are joined block by block.

Copies collapse before anything is compared: a document is represented by the fingerprint of its set. The result is one
row per document with its component; pairs are never listed. A member of the largest component of its region need not be
compared once all others are.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; fewer words than a shingle
make one shingle of the whole sequence; null ids are kept (the component takes the least id that is not null); repeated
rows are linked as copies; an empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.bits import bit_table, bits_for, in_bits
from tapeline.llm.components import components
from tapeline.llm.shingles import U, chunks, mixed, set_key, sets_of
from tapeline.llm.tasks import lean
from tapeline.session import saved

K = 5
#: Similarity as a fraction, 3/4, and the distance that goes with it.
NUM, DEN = 3, 4
REACH = 1 - NUM / DEN
#: Part of a set by which its head is longer than a shared shingle would need.
EXTRA = 0.05
#: The count table has a cell for about this many shingles, as long as its bits stay in this range.
LEAST_BITS, MOST_BITS = 16, 24
CELLS_PER_ROW = 16
#: Parts in which tasks hand over their count tables.
TABLE_PARTS = 256
#: Shingles of heads in one part of their exchange, the least number of parts, and shingles that a task packs together.
PART_SHINGLES, LEAST_PARTS, PACKED_SHINGLES = 1_000_000, 64, 400_000
#: Shingles of all members of a region that one task joins.
REGION_SHINGLES = 1_000_000


class Counts:
    """A task's count table of 2^bits cells; what it hands over does not depend on the data's size."""

    def __init__(self, bits: int) -> None:
        self.bits, self.table, self.waiting, self.size = bits, None, [], 0

    def add(self, hashed: np.ndarray) -> None:
        self.waiting.append(hashed)
        self.size += len(hashed)
        if self.size > 250_000:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            if self.table is None:
                self.table = np.zeros(1 << self.bits, np.uint32)
            cells, counts = np.unique((np.concatenate(self.waiting) >> U(64 - self.bits)).astype(np.int64), return_counts=True)
            self.table[cells] += counts.astype(np.uint32)
            self.waiting, self.size = [], 0

    def parts(self) -> Iterator[tuple[int, bytes]]:
        self._flush()
        if self.table is not None:
            for i, part in enumerate(self.table.reshape(TABLE_PARTS, -1)):
                if part.any():
                    yield i, zstandard.compress(part.tobytes(), 1)


def summed(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of the tables in (part, counts) rows."""
    schema = "part int, counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(counts), np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((TABLE_PARTS, (1 << bits) // TABLE_PARTS), np.uint32)
    for row in parts.repartition("part").mapInArrow(lean(add), schema).collect():  # 2^bits cells at most
        out[row["part"]] = np.frombuffer(row["counts"], np.uint32)
    return out.reshape(-1)


def head_length(n: int) -> int:
    return min(n, n - -(-NUM * n // DEN) + -(-n // round(1 / EXTRA)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def fingerprints(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, row, key, n of every document (``row``: a hash of the text), and the count table of all shingles, in one pass."""
    bits = min(MOST_BITS, max(LEAST_BITS, (CELLS_PER_ROW * max(1, texts.count()) - 1).bit_length()))
    names = ["doc_id", "row", "key", "n", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds = Counts(bits), [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        for batch in batches:
            keys, sizes, none = [], [], [None] * batch.num_rows
            for _, run in chunks(batch.column("text")):
                for x in sets_of(run, K):
                    keys.append(set_key(x))
                    sizes.append(len(x))
                    table.add(x)
            yield _batch(names, kinds, [batch.column("doc_id"), batch.column("row"), keys, sizes, none, none])
        for part, counts in table.parts():
            yield _batch(names, kinds, [[None]] * 4 + [[part], [counts]])

    found = saved(texts.withColumn("row", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, row long, key long, n long, part int, counts binary"))
    return found.where("part is null").select(names[:4]), summed(found.where("part is not null").select("part", "counts"), bits)


def heads(texts: DataFrame, classes, bits: int, parts: int) -> DataFrame:
    """The heads of all distinct sets, packed: part, hot, keys, counts (of each key), tokens (48 bits of each).

    Cold tokens are dealt to parts by range, so that equal ones meet; ``classes``: broadcast count classes of the cells.
    A hot token (class over 0) stays in a part of its task's choice.
    """
    names, kinds = ["part", "hot", "keys", "counts", "tokens"], [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held, size = classes.value, set(), [], 0

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, t, _ in held]) >> U(16)
            hot = np.concatenate([h for *_, h in held])
            owner = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
            keys = np.array([k for k, *_ in held], np.int64)
            part = (tokens * U(parts) >> U(48)).astype(np.int64)
            part[hot] = parts + keys[0] % parts
            order = np.argsort(part, kind="stable")
            part, tokens, owner = part[order], tokens[order], owner[order]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            rows = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = owner[low:high]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                counts = np.diff(np.concatenate([begins, [len(own)]])).astype(np.uint32)
                six = tokens[low:high].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(part[low]) % parts, bool(part[low] >= parts), keys[own[begins]].tobytes(), counts.tobytes(), six.tobytes()))
            return _batch(names, kinds, list(zip(*rows, strict=True)))

        for batch in batches:
            for _, run in chunks(batch.column("text")):
                for x in sets_of(run, K):
                    if not len(x) or (key := set_key(x)) in seen:
                        continue
                    seen.add(key)
                    cls = table[(x >> U(64 - bits)).astype(np.int64)]
                    kept = np.argsort(cls, kind="stable")[: head_length(len(x))]
                    held.append((key, x[kept], cls[kept] > 0))
                    size += len(kept)
                    if size > PACKED_SHINGLES:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    return texts.mapInArrow(lean(run), "part int, hot boolean, keys binary, counts binary, tokens binary")


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, keys) of a packed row."""
    keys, counts, six = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.uint32), np.frombuffer(row[2], np.uint8).reshape(-1, 6)
    tokens = np.zeros((len(six), 8), np.uint8)
    tokens[:, :6] = six
    return tokens.view("<u8").reshape(-1).astype(np.int64), np.repeat(keys, counts)


def shared(packed: DataFrame, parts: int) -> DataFrame:
    """token, key, pivot: the cold tokens that another key has too, and all hot ones, whose pivot is still null.

    A part holds ``PART_SHINGLES`` cold tokens at the mean; a token is cold if it is not much more frequent than the mean.
    """
    names, kinds = ["token", "key", "pivot"], [pa.int64()] * 3

    def meet(tokens: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, mixed(keys.view(U)), tokens))
        tokens, keys = tokens[order], keys[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])])
        tokens, keys = tokens[fresh], keys[fresh]
        starts = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        begins, group = np.flatnonzero(starts), np.cumsum(starts) - 1
        kept = np.diff(np.concatenate([begins, [len(tokens)]]))[group] > 1
        return _batch(names, kinds, [tokens[kept], keys[kept], keys[begins][group][kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, hot, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                tokens, keys = _unpacked(row)
                if hot:
                    yield _batch(names, kinds, [tokens, keys, pa.nulls(len(tokens), pa.int64())])
                    continue
                if p != part and held:
                    yield meet(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                part = p
                held.append((tokens, keys))
        if held:
            yield meet(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(run), "token long, key long, pivot long")


def heads_of(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, n, tokens, pivots: the shared parts of heads, of keys that share as many tokens as any link needs.

    The pivots of hot tokens come from a pre-aggregated group-by and a join whose large partitions Spark splits.
    """
    hot = found.where("pivot is null").select("token", "key")
    pivots = hot.groupBy("token").agg(F.min_by("key", F.struct(F.xxhash64("key"), "key")).alias("pivot"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    pivots = saved(pivots.where("lo <> hi").select("token", "pivot"))  # kept, so that the join has a shuffle of its own, whose large partitions Spark splits
    rows = found.where("pivot is not null").unionByName(hot.join(pivots, "token"))
    per = round(1 / EXTRA)
    least = F.expr(f"(({NUM} * n + {DEN - 1}) div {DEN} + {per - 1}) div {per}")
    lists = rows.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.collect_set("pivot").alias("pivots"))
    return lists.join(sizes, "key").where(F.size("tokens") >= F.greatest(F.lit(1), least)).select("key", "n", "tokens", "pivots")


class Links:
    """Union-find over the members of a region."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.up[j] = i
            self.size[i] += self.size[j]


class Postings:
    """Who holds which value, of members given as arrays of distinct values."""

    def __init__(self, members: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in members])
        values = np.concatenate(members)
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        self.n = len(members)
        self.start = np.flatnonzero(new)
        self.length = np.diff(np.concatenate([self.start, [len(values)]]))
        self.owner = np.repeat(np.arange(self.n), sizes)[order]
        self.run = np.empty(len(values), np.int64)
        self.run[order] = np.cumsum(new) - 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])

    def shared_with(self, i: int) -> np.ndarray:
        """How many values member i shares with each member."""
        runs = self.run[self.offset[i] : self.offset[i + 1]]
        runs = runs[self.length[runs] > 1]
        lengths = self.length[runs]
        at = np.repeat(self.start[runs] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def join_region(sets: list[np.ndarray], groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (member, other member) that connect exactly what the pairs within the distance connect.

    ``groups``: members of one group are known to hang together. The first member is the pivot; its exact distances to all
    others give the windows. Every other member is compared with those of its window (through the postings of its
    shingles), unless it belongs to the largest component by then: every pair across components has a member outside it.
    """
    n, links = len(sets), []
    if n < 2:
        return links
    sizes, postings, known = np.array([len(x) for x in sets]), Postings(sets), Links(n)
    if groups is not None:
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            known.join(first.setdefault(g, i), i)
    both = postings.shared_with(0)
    distance = 1 - both / (sizes[0] + sizes - both)
    done = np.zeros(n, bool)
    largest = max((known.find(i) for i in range(n)), key=lambda i: known.size[i])

    def compare(i: int) -> None:
        nonlocal largest
        root = known.find(i)
        window = (np.abs(distance - distance[i]) <= REACH + 1e-9) & (DEN * np.minimum(sizes, sizes[i]) >= NUM * np.maximum(sizes, sizes[i]))
        if not any(known.find(int(j)) != root for j in np.flatnonzero(window)):
            return
        both = postings.shared_with(i)
        for j in np.flatnonzero(window & (DEN * both >= NUM * (sizes[i] + sizes - both))):
            if known.find(i) != known.find(int(j)):
                known.join(i, int(j))
                links.append((i, int(j)))
        if known.size[known.find(i)] > known.size[known.find(largest)]:
            largest = known.find(i)

    compare(0)
    done[0] = True
    while True:
        top = known.find(largest)
        todo = [int(i) for i in np.flatnonzero(~done) if known.size[top] == 1 or known.find(int(i)) != top]
        if not todo:
            return links
        for i in todo:
            if known.size[known.find(largest)] == 1 or known.find(i) != known.find(largest):
                compare(i)
                done[i] = True


def _region_links(rows: DataFrame) -> DataFrame:
    """a, b from (region, key, group, values), one region after the other."""
    ordered = rows.select("region", "key", "group", "values").repartition("region").sortWithinPartitions("region", F.col("region") != F.col("key").cast("string"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, members = None, {}

        def finish() -> Iterator[pa.RecordBatch]:
            keys = list(members)
            found = join_region([np.frombuffer(members[k][1], U) for k in keys], [members[k][0] for k in keys])
            if found:
                yield _batch(["a", "b"], [pa.int64()] * 2, [[keys[i] for i, _ in found], [keys[j] for _, j in found]])

        for batch in batches:
            for r, key, group, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if r != region:
                    yield from finish()
                    region, members = r, {}
                members[key] = (group, values)
        yield from finish()

    return ordered.mapInArrow(lean(run), "a long, b long")


SUB_PIVOTS = 16


def _distances(rows: DataFrame, balls: DataFrame) -> DataFrame:
    """Adds ``near``, array<struct<pivot, distance>>, the exact distances to the region's sub-pivots, ``SUB_PIVOTS`` at most."""
    joined = rows.join(balls, "region")  # Spark broadcasts few pivots, and splits the rows of large regions otherwise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pivot", pa.int64()), ("distance", pa.float64())]))
        for batch in batches:
            near = []
            for values, pivots in zip(batch.column("values"), batch.column("pivots"), strict=True):
                x = np.frombuffer(values.as_py(), U)
                found = []
                for p in pivots.as_py():
                    y = np.frombuffer(p["values"], U)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    found.append({"pivot": p["key"], "distance": 1 - both / (len(x) + len(y) - both)})
                near.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "key", "group", "values")), pa.array(near, kind)], names=["region", "key", "group", "values", "near"])

    return joined.select("region", "key", "group", "values", "pivots").mapInArrow(lean(run), "region string, key long, group long, values binary, near array<struct<pivot:bigint,distance:double>>")


def split_region(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """For regions too large for a task: links found on the way, and the rows of smaller regions that give the rest.

    A member within distance 0.25 of a sub-pivot is settled there. What is left are pairs with an unsettled member and
    pairs settled at different sub-pivots. By the triangle inequality a member can only be linked to one settled at p if
    its own distance to p is at most 0.5. Each ball is cut into pieces by a hash; the members that must be compared with
    it (not settled there, and within 0.5) are copied to every piece, and among themselves they form the next region.
    """
    r = REACH
    ranked = rows.select("region", "key", "values").dropDuplicates(["region", "key"]).withColumn("pos", F.struct(F.xxhash64("key", F.lit(1)), "key"))
    heads_ = ranked.groupBy("region").agg(F.sum(F.octet_length("values") / 8).alias("total"), F.min("pos.col1").alias("lo"), F.max("pos.col1").alias("hi"), F.count("*").alias("n"))
    # about SUB_PIVOTS members of the lowest hashes: a cut at their expected quantile, then at most that many
    cut = heads_.select("region", "total", (F.col("lo").cast("double") + (F.col("hi").cast("double") - F.col("lo").cast("double")) * F.least(F.lit(1.0), 4.0 * SUB_PIVOTS / F.col("n"))).alias("cut"))
    chosen = ranked.join(cut, "region").where(F.col("pos.col1").cast("double") <= F.col("cut"))
    balls = saved(chosen.groupBy("region").agg(F.max("total").alias("total"), F.slice(F.array_sort(F.collect_list(F.struct("key", "values"))), 1, SUB_PIVOTS).alias("pivots")))
    near = saved(_distances(rows, balls.select("region", "pivots")))
    settled = F.filter("near", lambda p: p["distance"] <= r + 1e-12)
    links = near.select("key", F.explode(settled).alias("p")).where("key <> p.pivot").select(F.col("key").alias("a"), F.col("p.pivot").alias("b"))
    home = F.element_at(F.array_sort(settled, lambda a, b: F.when((a["distance"] < b["distance"]) | ((a["distance"] == b["distance"]) & (a["pivot"] < b["pivot"])), -1).otherwise(1)), 1)["pivot"]
    placed = near.withColumn("home", F.when(F.size(settled) > 0, home)).join(balls.select("region", "total"), "region")
    pieces = F.greatest(F.lit(1), F.ceil(2 * F.col("total") / limit)).cast("int")
    inner = placed.where("home is not null").select(F.concat_ws("/", "region", F.col("home").cast("string"), F.pmod(F.xxhash64("key"), pieces).cast("string")).alias("region"), "key", F.col("home").alias("group"), "values")
    around = placed.select("region", "key", "group", "values", "home", pieces.alias("pieces"), F.explode("near").alias("p")).where((F.col("p.distance") <= 2 * r + 1e-12) & ~F.col("p.pivot").eqNullSafe(F.col("home")))
    around = around.where("home is null or home < p.pivot")  # two settled members meet in one ball only
    copied = around.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    copied = copied.select(F.concat_ws("/", "region", F.col("p.pivot").cast("string"), F.col("piece").cast("string")).alias("region"), "key", "group", "values")
    rest = placed.where("home is null").select(F.concat_ws("/", "region", F.lit("rest")).alias("region"), "key", "group", "values")
    return links, inner.unionByName(copied).unionByName(rest)


def block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Regions that balls no longer cut (members far from each other and from all sub-pivots): blocks by a hash of the key, each pair of blocks a cell."""
    loads = rows.groupBy("region").agg(F.ceil(2 * F.sum(F.octet_length("values") / 8) / limit).cast("int").alias("blocks"))
    placed = rows.join(loads, "region").withColumn("own", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.concat_ws("/", "region", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    return met.select(cell.alias("region"), "key", "group", "values")


#: Times that balls cut what is left of large regions.
ROUNDS = 3


def screen_region(heads_: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which members can have a link to a member of another label, from the shared parts of their heads.

    Shingles common to both sets that stand in both heads are counted. All others of the common ones stand behind the
    shorter reaching head, so the intersection is at most that count plus what is behind the one or the other head.
    """
    behind = sizes - np.array([head_length(int(n)) for n in sizes])
    flagged = np.zeros(len(heads_), bool)
    names, counts = np.unique(labels, return_counts=True)
    if len(names) == 1:
        return flagged
    postings = Postings(heads_)
    visited = labels != names[np.argmax(counts)] if counts.max() > 1 else np.ones(len(heads_), bool)
    left = ~visited  # members that only a visit of another one can flag
    for i in np.flatnonzero(visited):
        if flagged[i] and flagged[left].all():
            continue
        both, n = postings.shared_with(i), sizes[i]
        least = -(-NUM * (n + sizes) // (NUM + DEN))
        near = (both > 0) & (labels != labels[i]) & (DEN * np.minimum(n, sizes) >= NUM * np.maximum(n, sizes)) & (both + np.maximum(behind[i], behind) >= least)
        flagged |= near
        flagged[i] |= near.any()
    return flagged


#: Shared shingles of heads that one task may hold to screen a region; the members of a larger one are all kept, and there the bound of the distance is 1.
SCREEN_SHINGLES = 1_500_000


def screened(lists: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """region, key, n, gap: memberships (of key, n, tokens, pivots) that may bring a link, across components if ``labels`` (key, label) are given.

    Of the members that stay, the one with the least hash is the region's pivot and names it. ``gap``: least distance to
    it that the heads allow; -1 for the pivot.
    """
    lists = lists.withColumn("label", F.col("key")) if labels is None else lists.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    members = lists.select(F.explode("pivots").alias("pivot"), "key", "label", F.size("tokens").alias("tokens"))
    loads = members.groupBy("pivot").agg(F.sum("tokens").alias("load"), F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    members = members.select("pivot", "key").join(loads.where("members > 1 and lo <> hi").select("pivot", "load"), "pivot").join(lists.drop("pivots"), "key")
    small = members.where(F.col("load") <= SCREEN_SHINGLES).select("pivot", "key", "n", "label", "tokens").repartition("pivot").sortWithinPartitions("pivot", "key")
    names, kinds = ["region", "key", "n", "gap"], [pa.int64(), pa.int64(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            sizes, own = np.array([n for _, n, *_ in held], np.int64), [t for *_, t in held]
            kept = np.flatnonzero(screen_region(own, sizes, np.array([x for _, _, x, _ in held])))
            if len(kept):
                keys, sizes = np.array([held[i][0] for i in kept], np.int64), sizes[kept]
                first = int(np.argmin(mixed(keys.view(U))))
                behind = sizes - np.array([head_length(int(n)) for n in sizes])
                most = np.minimum(Postings([own[i] for i in kept]).shared_with(first) + np.maximum(behind, behind[first]), np.minimum(sizes, sizes[first]))
                gap = 1 - most / (sizes + sizes[first] - most)
                gap[first] = -1
                yield _batch(names, kinds, [np.full(len(kept), keys[first]), keys, sizes, gap])

        for batch in batches:
            for p, key, n, label, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if p != pivot:
                    yield from finish()
                    pivot, held = p, []
                held.append((key, n, label, tokens.values.to_numpy()))
        yield from finish()

    kept = small.mapInArrow(lean(run), "region long, key long, n int, gap double")
    kept = kept.unionByName(members.where(F.col("load") > SCREEN_SHINGLES).select(F.col("pivot").alias("region"), "key", "n", F.lit(1.0).alias("gap")))
    return kept.groupBy("region", "key").agg(F.max("n").alias("n"), F.min("gap").alias("gap")).withColumn("region", F.col("region").cast("string"))


def sets_for(texts: DataFrame, prints: DataFrame, keys: DataFrame) -> DataFrame:
    """key, values: the sets of ``keys``. One text stands for each set; the tasks know those texts by a bit table of their hashes, whose size has a bound, and the join drops what else passes."""
    chosen = saved(prints.join(keys.select("key").distinct(), "key").groupBy("key").agg(F.min("row").alias("row")))
    bits = bits_for(chosen.count())
    wanted = texts.sparkSession.sparkContext.broadcast(bit_table(chosen.select("row"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = wanted.value, set()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            at = [i for i in np.flatnonzero(in_bits(table, bits, mixed(rows.view(U)))) if not (rows[i] in seen or seen.add(rows[i]))]
            if not at:
                continue
            sets = [x for _, run in chunks(batch.column("text").take(pa.array(at))) for x in sets_of(run, K)]
            kept = [(int(rows[i]), set_key(x), x.tobytes()) for i, x in zip(at, sets, strict=True) if len(x)]
            if kept:
                yield _batch(["row", "key", "values"], [pa.int64(), pa.int64(), pa.binary()], list(zip(*kept, strict=True)))

    found = texts.select(F.xxhash64("text").alias("row"), "text").mapInArrow(lean(run), "row long, key long, values binary")
    own = found.join(chosen.withColumnRenamed("row", "own"), "key").where("row = own")
    return own.groupBy("key").agg(F.first("values").alias("values"))


def join_regions(sets: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """a, b: links inside regions, from (region, key, n, group)."""
    load = members.groupBy("region").agg(F.sum("n").alias("load"), F.count("*").alias("members")).where("members > 1")
    regions = saved(members.join(load, "region").select("region", "key", "group", (F.col("load") > limit).alias("big")))
    rows = regions.join(sets, "key")
    found = [_region_links(rows.where("not big"))]
    if regions.where("big").isEmpty():
        return found[0]
    big = rows.where("big").select("region", "key", "group", "values")
    for _ in range(ROUNDS):
        more, smaller = split_region(saved(big), limit)
        smaller = saved(smaller)
        load = smaller.groupBy("region").agg(F.sum(F.octet_length("values") / 8).alias("load"), F.min("group").alias("lo"), F.max("group").alias("hi"))
        sized = smaller.join(load.where("lo <> hi").drop("lo", "hi"), "region")
        found += [more, _region_links(sized.where(F.col("load") <= limit))]
        big = sized.where(F.col("load") > limit).select("region", "key", "group", "values")
        if big.isEmpty():
            break
    else:
        found.append(_region_links(block_pairs(big, limit)))
    return reduce(DataFrame.unionByName, found)


def links_of(texts: DataFrame, prints: DataFrame, table: np.ndarray, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """a, b: links between keys that connect exactly the keys within the distance."""
    context, bits = texts.sparkSession.sparkContext, int(len(table)).bit_length() - 1
    common = 2 * max(1.0, float(table.mean()))
    classes = np.ceil(np.log2(np.maximum(table, 1, dtype=np.float32) / np.float32(common)) + 1e-6).clip(0, 255).astype(np.uint8)
    parts = max(LEAST_PARTS, -(-int(table.sum(dtype=np.int64)) * 3 // (10 * PART_SHINGLES)))
    found = saved(shared(heads(texts, context.broadcast(classes), bits, parts), parts))
    sizes = prints.where("n > 0").groupBy("key").agg(F.max("n").cast("int").alias("n"))
    alive = saved(heads_of(found, sizes))
    kept = saved(screened(alive))
    sets = saved(sets_for(texts, prints, kept))
    nearest = F.min_by("region", F.struct("gap", "region")).alias("region")
    homes = kept.groupBy("key").agg(nearest, F.max("n").alias("n")).withColumn("group", F.col("key"))
    near = saved(join_regions(sets, homes, region_shingles))
    labels = components(near).withColumnRenamed("node", "key")
    rest = screened(alive.join(kept.select("key").distinct(), "key", "left_semi"), labels)
    rest = saved(rest.join(labels, "key", "left").withColumn("group", F.coalesce("label", "key")).drop("label"))
    more = join_regions(sets, rest, region_shingles)
    return labels.select(F.col("key").alias("a"), F.col("label").alias("b")).unionByName(more)


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = _texts(docs, id_col, text_col)
    prints, table = fingerprints(texts)
    labels = components(links_of(texts, prints, table, region_shingles))
    least = prints.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = saved(least.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_key = named.select("key", "label").join(lowest, "label").select("key", "component_id")
    joined = prints.join(of_key, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """``docs``, all columns, with one row of each component: the one with the least id (null last), then the least hash of the text.

    Rows are told apart by id and a 64-bit hash of the text; of rows that agree in both one stays. Empty sets are
    linked with nothing and stay.
    """
    texts = _texts(docs, id_col, text_col)
    prints, table = fingerprints(texts)
    labels = components(links_of(texts, prints, table, region_shingles)).withColumnRenamed("node", "key")
    rows = prints.where("n > 0").groupBy("doc_id", "row", "key").agg(F.count("*").alias("rows"))
    rows = saved(rows.join(labels, "key", "left").select("doc_id", "row", "rows", F.coalesce("label", "key").alias("label")))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    placed = rows.join(first, "label").withColumn("gone", ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))))
    states = placed.where("gone or rows > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_of"), F.col("gone").alias("_gone"))
    marked = docs.withColumn("_row", F.xxhash64(text_col))
    marked = marked.join(states, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")), "left")
    once = marked.where("_gone is null").select(docs.columns)
    return once.unionByName(marked.where("not _gone").dropDuplicates([id_col, "_row"]).select(docs.columns))
