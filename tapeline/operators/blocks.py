"""Running values over logs of any length: two passes over blocks, so that no task holds a whole log.

Rows are dealt by ranges of (file, offset) to blocks of bounded size. The first pass gives one summary for each group and block: sum, greatest,
last value, all of them associative. A window over these few rows gives what each block carries in; the second pass is a window inside the
block, joined with it. Groups (a partition, a track) may share blocks and may reach over many. The results are those of windows over whole
groups; ``timeline`` has these for files of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import tracks
from tapeline.operators import timeline
from tapeline.operators.timeline import BEFORE, DEFAULT, SO_FAR, Order
from tapeline.session import saved

BLOCK_ROWS = 1_000_000
#: Rows of a task that cuts blocks, where a block is not larger.
TASK_ROWS = 1_000_000
#: How a running value is summarised in a block and added to what comes from before.
_JOIN = {
    "sum": lambda carry, own: F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "max": lambda carry, own: F.greatest(carry, own),
    "last": lambda carry, own: F.coalesce(own, carry),
}


def blocked(rows: DataFrame, block_rows: int = BLOCK_ROWS, order: Order = DEFAULT) -> DataFrame:
    """Adds block: numbers of ranges of (file, offset) with ``block_rows`` rows each, or fewer. Kept, as ranges are found by sampling and must not change.

    Tasks hold whole ranges, sorted, and cut them into blocks; small blocks share a task, so what is sampled and what tasks tell the driver
    does not grow with the number of blocks.
    """
    n = rows.count()
    tasks = max(1, -(-n // max(block_rows, TASK_ROWS)), min(-(-n // block_rows), rows.sparkSession.sparkContext.defaultParallelism))
    ranges = rows.repartitionByRange(tasks, order.file, order.offset).sortWithinPartitions(order.file, order.offset)
    task, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(2**33 - 1))  # parts of the number: of the task, and in it
    block = F.shiftleft(task, 33) + F.call_function("div", place, F.lit(block_rows).cast("long"))
    return saved(ranges.withColumn("_place", F.monotonically_increasing_id()).withColumn("block", block).drop("_place"))


def running(rows: DataFrame, keys: list[str], order_by: str, inclusive: bool = True, **columns: tuple[str, Column]) -> DataFrame:
    """Adds running values of each group of ``keys`` in order: name = (``sum``, ``max`` or ``last``, value); null values do not count.

    ``inclusive``: up to the row itself, else up to the one before it. ``rows`` have ``block``; keys are not null.
    """
    held = {name: f"_{name}" for name in columns}
    rows = rows.withColumns({held[n]: value for n, (_, value) in columns.items()})
    summary = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_by)))}
    over = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    blocks = rows.groupBy(*keys, "block").agg(*(summary[how](held[n]).alias(held[n]) for n, (how, _) in columns.items()))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(*BEFORE)
    carries = blocks.select(*keys, "block", *(over[how](held[n], before).alias(f"_carry{held[n]}") for n, (how, _) in columns.items()))
    inside = Window.partitionBy(*keys, "block").orderBy(order_by).rowsBetween(*(SO_FAR if inclusive else BEFORE))
    rows = rows.join(carries, [*keys, "block"])
    rows = rows.withColumns({n: _JOIN[how](F.col(f"_carry{held[n]}"), over[how](held[n], inside)) for n, (how, _) in columns.items()})
    return rows.drop(*held.values(), *(f"_carry{c}" for c in held.values()))


def with_partitions(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """As ``timeline.with_partitions``, for rows in blocks."""
    header = (F.col("track_id") == tracks.HEADER).cast("int")
    rows = running(records, [order.file], order.offset, partition_index=("sum", header))
    return rows.withColumn("partition_index", (F.col("partition_index") - 1).cast("int")).where("partition_index >= 0")


def with_wall_clock(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """As ``timeline.with_wall_clock``."""
    return timeline.clocked(running(records, [order.file, "partition_index"], order.offset, sync=("last", timeline.sync_of_row())))


def with_sections(frames: DataFrame, max_gap_ms: int = 5000, order: Order = DEFAULT) -> DataFrame:
    """As ``timeline.with_sections``."""
    keys = [order.file, "partition_index"]
    video = tracks.is_video(F.col("track_id"))
    rows = running(timeline.media_rows(frames).where("clock_rate <> 0"), keys, order.offset, inclusive=False, video_before=("max", F.when(video, F.col("wc_ms"))))
    rows = timeline.with_gaps(rows, F.col("video_before")).drop("video_before")
    rows = running(rows, keys, order.offset, section_index=("sum", F.coalesce(F.col("gap_ms") > max_gap_ms, F.lit(False)).cast("int")))
    return rows.withColumn("section_index", (F.col("section_index") + 1).cast("int"))


def monotonic(rows: DataFrame, keys: list[str], value: str, order_by: str) -> DataFrame:
    """As ``repair.monotonic``: i (from 1, so a sequence number of the group too), rebased and repaired values."""
    rows = running(rows, keys, order_by, i=("sum", F.lit(1).cast("long")))
    rows = running(rows, keys, order_by, first_row=("last", F.when(F.col("i") == 1, F.struct(F.col(value).alias("v")))))
    rows = rows.withColumn("rebased", F.greatest(F.col(value) - F.col("first_row.v"), F.lit(0).cast("long"))).drop("first_row")
    rows = running(rows, keys, order_by, least=("max", F.col("rebased") - F.col("i")))
    return rows.withColumn("repaired", F.col("i") + F.col("least")).drop("least")


def video_steps(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Video rows with step: dts since the video row before in the partition, null where it does not advance."""
    video = timeline.media_rows(frames).where(tracks.is_video(F.col("track_id")))
    rows = running(video, [order.file, "partition_index"], order.offset, inclusive=False, dts_before=("last", F.col("dts")))
    step = F.col("dts") - F.col("dts_before")
    return rows.withColumn("step", F.when(step > 0, step)).drop("dts_before")


#: Bits of a value that one round settles: a group's histogram has 2^BITS rows at most.
BITS = 10


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: of each group's values (whole numbers, not null) the one of rank n // 2 from 0, exact.

    Equal values are counted first. Then, for all groups at once, each round counts values by range and narrows a group to the
    range that holds its rank; no group is gathered anywhere.
    """
    counts = saved(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n")))
    state = saved(counts.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.call_function("div", F.sum("n"), F.lit(2).cast("long")).alias("rank")))
    width = int(state.agg(F.max(F.col("high").cast("decimal(20,0)") - F.col("low"))).first()[0] or 0).bit_length()
    state = state.select(*keys, "low", "rank")
    shift = width
    while True:
        before, shift = shift, max(0, shift - BITS)
        wide = lambda x: (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(21,0)")  # noqa: E731  differences of LONGs are wider than these
        offset = wide(F.col("value")) - wide(F.col("low"))
        inner = counts.join(state, keys).where((offset >= 0) & (offset < wide(2**before)))
        place = F.call_function("div", offset, wide(2**shift))
        ranges = inner.groupBy(*keys, "low", "rank", place.alias("place")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("place"))
        held = ranges.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = saved(held.select(*keys, (wide(F.col("low")) + wide(F.col("place")) * wide(2**shift)).cast("long").alias("low"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        if shift == 0:
            return state.select(*keys, F.col("low").alias("median"))


def video_rates(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """As ``timeline.video_rates``: file, partition, video_fps."""
    keys = [order.file, "partition_index"]
    steps = video_steps(frames, order)
    first = steps.groupBy(*keys).agg(F.min_by("clock_rate", F.when(F.col("clock_rate") > 0, F.col(order.offset))).alias("rate"))
    rows = first.join(upper_medians(steps, keys, "step"), keys, "left")
    return rows.select(*keys, timeline.per_second(F.col("median"), F.col("rate")).alias("video_fps"))


def section_summary(frames: DataFrame, max_gap_ms: int = 5000, order: Order = DEFAULT) -> DataFrame:
    """As ``timeline.section_summary``: sections by blocks, the video rate of each partition joined to its sections."""
    rows = with_sections(frames, max_gap_ms, order).join(video_rates(frames, order), [order.file, "partition_index"], "left")
    return timeline.summarised(rows, max_gap_ms, order)
