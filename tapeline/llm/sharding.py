"""Best-fit-decreasing bin packing of indivisible groups of rows into shards.

Rows with equal text form a group that must not be split. Sizes of groups come from one Spark aggregation; every group
enters a best-fit-decreasing packing on its own. One task packs a block of about ``BLOCK_UNITS`` groups (dealt by a hash, sorted by size
as they stream in) and hands on the bins that it filled:

- With a fixed ``capacity`` a bin is a shard. Bins that are filled by less than ``FULL`` of the capacity are units of the next
  round, whose blocks are packed alike, until one block has had them all; so no shard exceeds the capacity, but for a
  group that does so alone, and each round leaves a part of its bins open only.
- With a number of shards a block makes about ``BINS`` bins, each of that part of its bytes, and these are units of the next
  round, until one block packs all that is left into the shards, as equal as they get.

A round's units are a fixed part of those of the round before, so rounds grow with the logarithm of the input; the driver
sees counts only.

Defined results: null text counts as empty (size 1, crc of no bytes); an empty table gives an empty result; repeated
rows are separate rows of one group; rows with null id are kept; other columns of the input are ignored. Ties of size go
to the smaller unit, ties of capacity to the older shard. Groups are told apart by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.tasks import lean
from tapeline.session import saved

#: Units that one task packs, bins that it hands on at about that number when shards are to be equal, and the fill from which a bin of fixed capacity is done.
BLOCK_UNITS, BINS, FULL = 20_000, 1024, 0.9
#: Slots are counted in this many independent parts of each shard.
SLOT_PARTS = 1024


class CapacityTree:
    """Treap of (remaining capacity, bin); finds the tightest bin that still takes a size in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) % (1 << 61)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_id: int) -> None:
        key = (remaining, bin_id)
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._priority(key), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        node = right
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            self.root = left
            return None
        key = node[0]
        _, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, rest)
        return key


def best_fit_decreasing(sizes: dict, capacity: int) -> tuple[dict, int]:
    """Bin of each unit and the number of bins of ``capacity``; a unit above the capacity gets a bin of its own."""
    tree, placed, n_bins = CapacityTree(), {}, 0
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        found = tree.take_tightest(size)
        if found is None:
            found = (max(capacity, size), n_bins)
            n_bins += 1
        placed[unit] = found[1]
        tree.add(found[0] - size, found[1])
    return placed, n_bins


def pack_into(sizes: dict, n_shards: int) -> dict:
    """Best-fit-decreasing with the least capacity (to 0.02 %) for which ``n_shards`` bins suffice."""
    total = sum(sizes.values())
    capacity = max(-(-total // n_shards), max(sizes.values(), default=0), 1)
    while True:
        placed, n_bins = best_fit_decreasing(sizes, capacity)
        if n_bins <= n_shards:
            return placed
        capacity += max(1, capacity // 5000)


def packed(units: DataFrame, n_blocks: int, level: int, n_shards: int | None, capacity: int | None) -> DataFrame:
    """unit, bin, bytes of (unit, bytes) rows, packed block by block; a bin's number tells its block."""
    dealt = units.select(F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(n_blocks)).cast("int").alias("block"), "unit", "bytes")
    ordered = dealt.repartition(n_blocks, "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sizes = None, {}

        def finish() -> pa.RecordBatch:
            if n_shards and n_blocks == 1:
                placed = pack_into(sizes, n_shards)
            else:
                placed, _ = best_fit_decreasing(sizes, capacity or -(-sum(sizes.values()) // BINS))
            return pa.RecordBatch.from_arrays([pa.array(list(placed), pa.int64()), pa.array([block + (b * n_blocks) for b in placed.values()], pa.int64()), pa.array([sizes[u] for u in placed], pa.int64())], names=["unit", "bin", "bytes"])

        for batch in batches:
            for b, unit, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != block and sizes:
                    yield finish()
                    sizes = {}
                block = b
                sizes[unit] = size
        if sizes:
            yield finish()

    return ordered.mapInArrow(lean(run), "unit long, bin long, bytes long")


def place_groups(groups: DataFrame, n_shards: int | None, capacity: int | None) -> DataFrame:
    """group_key, shard of (group_key, bytes) rows."""
    units, level, n = groups.select(F.col("group_key").alias("unit"), "bytes"), 0, groups.count()
    of = groups.select("group_key", F.col("group_key").alias("unit"))
    done = None  # groups whose shard is final: group_key, level, bin
    while True:
        n_blocks = max(1, -(-n // BLOCK_UNITS))
        last = n_blocks == 1
        got = saved(packed(units, n_blocks, level, n_shards, capacity))
        of = of.join(got.select("unit", "bin"), "unit").select("group_key", F.col("bin").alias("unit"))
        units = got.groupBy("bin").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("bin", "unit")
        if last:
            final = of.select("group_key", F.lit(level).alias("level"), F.col("unit").alias("bin"))
            done = final if done is None else done.unionByName(final)
            break
        if capacity:
            full = units.where(F.col("bytes") >= FULL * capacity).select("unit")
            closed = saved(of.join(full, "unit", "left_semi").select("group_key", F.lit(level).alias("level"), F.col("unit").alias("bin")))
            done = closed if done is None else done.unionByName(closed)
            units = units.join(full, "unit", "left_anti")
            of = saved(of.join(full, "unit", "left_anti").select("group_key", "unit"))
        units, before, level = saved(units), n, level + 1
        n = units.count()
        if not n:
            break
        if capacity and n > 0.9 * before:  # hardly any two of them fit together
            done = done.unionByName(of.select("group_key", F.lit(level).alias("level"), F.col("unit").alias("bin")))
            break
    if n_shards:
        return done.select("group_key", F.col("bin").cast("int").alias("shard"))
    done = saved(done)
    bins = done.select("level", "bin").distinct().withColumn("part", F.pmod(F.xxhash64("level", "bin"), F.lit(SLOT_PARTS)))
    number = F.row_number().over(Window.partitionBy("part").orderBy("level", "bin"))
    counts = bins.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most SLOT_PARTS rows
    named = bins.withColumn("number", number).join(F.broadcast(before), "part").select("level", "bin", (F.col("before") + F.col("number") - 1).cast("int").alias("shard"))
    return done.join(named, ["level", "bin"]).select("group_key", "shard")


def shard_rows(docs: DataFrame, n_shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; law: sizes near equal, equal texts together.

    With ``capacity`` instead of ``n_shards`` the shards have that fixed capacity and their number is minimised.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_key"),
        )
    )
    groups = saved(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    shards = saved(place_groups(groups, n_shards, capacity))
    placed_rows = rows.join(shards, "group_key").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_PARTS)))
    counts = placed_rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )  # at most SLOT_PARTS rows a shard
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return placed_rows.withColumn("number", number).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))
