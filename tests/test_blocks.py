"""Running values by blocks and medians by histograms against windows and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import blocks, repair, timeline
from tapeline.plans import standin

SF = "/root/testdata/sf0.001"


def hot(spark):
    return standin.records(spark, SF).withColumn("file_id", F.when(F.col("file_id").cast("long") % 3 == 0, "long").otherwise(F.col("file_id")))


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("block_rows", [1, 37, 10_000])
def test_blocks_equal_windows(spark, block_rows):
    records = hot(spark).where("file_offset % 4 <> 1") if block_rows == 1 else hot(spark)
    records = records.limit(60) if block_rows == 1 else records
    frames = timeline.media_rows(timeline.with_wall_clock(timeline.with_partitions(records)))
    own = timeline.media_rows(blocks.with_wall_clock(blocks.with_partitions(blocks.blocked(records, block_rows))))
    columns = ["file_id", "file_offset", "partition_index", "wc", "wc_ms", "has_sync", "bad_sync"]
    assert rows(own, columns) == rows(frames, columns)
    want = timeline.section_summary(frames, standin.MAX_GAP_MS)
    assert rows(blocks.section_summary(own, standin.MAX_GAP_MS), want.columns) == rows(want, want.columns)
    keys, columns = ["file_id", "partition_index", "track_id"], ["file_id", "file_offset", "i", "rebased", "repaired"]
    assert rows(blocks.monotonic(own, keys, "ticks", "file_offset"), columns) == rows(repair.monotonic(frames, keys, "ticks", "file_offset"), columns)


def test_no_task_holds_a_log(spark):
    """The long log is in many blocks, none of them much above the size asked for, and windows are within a block."""
    records = blocks.blocked(hot(spark), 50)
    sizes = [r["count"] for r in records.groupBy("block").count().collect()]
    assert max(sizes) <= 250 and records.where("file_id = 'long'").select("block").distinct().count() >= 3
    plan = blocks.with_partitions(records)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("block" in line.split("], [")[1] + line.split("], [")[-1] for line in windows)


def test_tasks_do_not_grow_with_small_blocks(spark):
    """Blocks of a few rows, in order and none of them too long, from as many tasks as the session has at once."""
    records = blocks.blocked(hot(spark), 3)
    places = [tuple(r) for r in records.orderBy("file_id", "file_offset").select("block").collect()]
    assert places == sorted(places) and len(set(places)) >= len(places) / 3
    assert records.groupBy("block").count().agg(F.max("count")).first()[0] == 3
    assert records.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_medians_of_random_groups(spark):
    rnd = random.Random(9)
    groups = {f"g{i}": [rnd.choice([rnd.randrange(5), rnd.randrange(-(10**6), 10**6), rnd.randrange(-(2**62), 2**62)]) for _ in range(rnd.randrange(1, 90))] for i in range(60)}
    groups |= {"third": [rnd.randrange(10**9) for _ in range(2000)], "one": [7] * 500, "ends": [-(2**63), 2**63 - 1], "nulls": [None, 3, None]}
    df = spark.createDataFrame([(k, v, "x") for k, vs in groups.items() for v in vs], "k string, v long, median string").repartition(4)
    got = {r.k: r["median"] for r in blocks.upper_medians(df, ["k"], "v").collect()}
    assert got == {k: sorted(x for x in vs if x is not None)[sum(x is not None for x in vs) // 2] for k, vs in groups.items()}
    assert blocks.upper_medians(df.where("v is null"), ["k"], "v").count() == 0


def test_empty(spark):
    none = blocks.blocked(hot(spark).where("file_offset < 0"))
    assert blocks.section_summary(timeline.media_rows(blocks.with_wall_clock(blocks.with_partitions(none)))).count() == 0
