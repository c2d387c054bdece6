"""From records in file order to wall clocks, rates and sections.

Every operator takes the columns that name a file and its order, so it runs on recordings and on any other log. Windows
share one partitioning (the file) and one order, so Spark plans one shuffle and one sort for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import clock, tracks


@dataclass(frozen=True)
class Order:
    """Columns that name a file and the order in it."""

    file: str = "file_id"
    offset: str = "file_offset"

    @property
    def in_file(self):
        return Window.partitionBy(self.file).orderBy(self.offset)

    @property
    def in_partition(self):
        return Window.partitionBy(self.file, "partition_index").orderBy(self.offset)

    @property
    def in_track(self):
        return Window.partitionBy(self.file, "partition_index", "track_id").orderBy(self.offset)


DEFAULT = Order()
SO_FAR = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def with_partitions(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Adds the 0-based partition that a header record opens; what stands before a file's first header goes."""
    headers = F.sum((F.col("track_id") == tracks.HEADER).cast("int")).over(order.in_file.rowsBetween(*SO_FAR))
    return records.withColumn("partition_index", (headers - 1).cast("int")).where("partition_index >= 0")


def with_wall_clock(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Adds wc (ticks), wc_ms, has_sync and bad_sync to media rows: the latest clock sync before a row in its partition, as a running last value.

    Under a sync of rate 0 no wall clock can be told: wc and wc_ms are null and bad_sync is true (``sync_errors`` has the syncs).
    """
    last = F.last(sync_of_row(), ignorenulls=True).over(order.in_partition.rowsBetween(*SO_FAR))
    return clocked(records.withColumn("sync", last))


def sync_of_row() -> Column:
    """What a clock sync tells; null on other rows."""
    return F.when((F.col("track_id") == tracks.SYNC) & F.col("sc_rate").isNotNull(), F.struct("sc_dts", "sc_rate", "sync_ms"))


def clocked(rows: DataFrame) -> DataFrame:
    """Adds the wall clock to rows with ``sync``, the latest clock sync, which goes."""
    known = clock.wall_clock(F.col("dts"), F.col("clock_rate"), F.col("sync.sc_dts"), F.col("sync.sc_rate"), F.col("sync.sync_ms"))
    media = tracks.is_media(F.col("track_id"))
    bad = F.coalesce(F.col("sync.sc_rate") == 0, F.lit(False))
    rows = rows.withColumn("bad_sync", media & bad).withColumn("has_sync", media & F.col("sync").isNotNull() & ~bad)
    rows = rows.withColumn("wc", F.when(media & ~F.col("bad_sync"), F.coalesce(known, F.lit(0).cast("long"))))
    ms = F.coalesce(clock.ticks_to_ms(F.col("wc"), F.col("clock_rate")), F.lit(0).cast("long"))
    return rows.withColumn("wc_ms", F.when(media & ~F.col("bad_sync"), ms)).drop("sync")


def sync_errors(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, code, offset: the clock syncs of rate 0."""
    bad = records.where((F.col("track_id") == tracks.SYNC) & (F.col("sc_rate") == 0))
    return bad.select(order.file, F.lit("zero_sync_rate").alias("code"), F.col(order.offset).alias("offset"))


def media_rows(records: DataFrame) -> DataFrame:
    return records.where(tracks.is_media(F.col("track_id")))


def wall_clock_steps(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Adds delta_ms to media rows: from the media row before in the partition, whatever its track; 0 for the first. Other rows may stand between."""
    media = tracks.is_media(F.col("track_id"))
    before = F.last(F.when(media, F.struct("wc_ms")), ignorenulls=True).over(order.in_partition.rowsBetween(*BEFORE))
    return frames.withColumn("delta_ms", F.when(media, F.coalesce(F.col("wc_ms") - before["wc_ms"], F.lit(0).cast("long"))))


def dts_steps(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Adds step: dts since the row before of the same track, 0 at least; null for the first."""
    step = F.col("dts") - F.lag("dts").over(order.in_track)
    return frames.withColumn("step", F.when(step.isNotNull(), F.greatest(step, F.lit(0).cast("long"))))


def nominal_rate(step: str = "step", rate: Column | None = None) -> Column:
    """Aggregate: clock rate over the upper median of the positive steps, half up, 1 at least; null without any."""
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {step} > 0 THEN {step} END DESC)")
    return per_second(median.cast("long"), (F.first("clock_rate") if rate is None else rate).cast("long"))


def per_second(median: Column, rate: Column) -> Column:
    """Rate over the median step, half up, 1 at least; null without one."""
    per_second = F.call_function("div", rate + F.call_function("div", median, F.lit(2).cast("long")), F.nullif(median, F.lit(0).cast("long")))
    return F.when(rate > 0, F.when(median.isNotNull(), F.greatest(per_second, F.lit(1).cast("long"))))


def track_rates(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition, track: nominal_fps as measured and export_fps, clamped (none: 1, over 120: 30) with a warning flag."""
    rows = dts_steps(frames, order).groupBy(order.file, "partition_index", "track_id").agg(
        nominal_rate(rate=F.min_by("clock_rate", order.offset)).alias("nominal_fps"), F.count("*").alias("frames")
    )
    fps = F.col("nominal_fps")
    return rows.withColumn("export_fps", F.when(fps.isNull(), F.lit(1).cast("long")).when(fps > 120, F.lit(30).cast("long")).otherwise(fps)).withColumn("clamped", fps.isNull() | (fps > 120))


def video_rates(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition: the rate over all video rows together, with the first rate that is not 0."""
    video = frames.where(tracks.is_video(F.col("track_id")))
    step = F.col("dts") - F.lag("dts").over(order.in_partition)
    rows = video.withColumn("step", F.when(step > 0, step))
    first = F.min_by("clock_rate", F.when(F.col("clock_rate") > 0, F.col(order.offset)))
    return rows.groupBy(order.file, "partition_index").agg(nominal_rate(rate=first).alias("video_fps"))


def with_video_rate(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Adds video_fps, the rate of ``video_rates`` for each row, by windows: the rows are read and shuffled once."""
    video, whole = tracks.is_video(F.col("track_id")), Window.partitionBy(order.file, "partition_index")
    step = F.col("dts") - F.last(F.when(video, F.col("dts")), ignorenulls=True).over(order.in_partition.rowsBetween(*BEFORE))
    rows = frames.withColumn("video_step", F.when(video & (step > 0), step))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY video_step DESC)").over(whole)
    first = F.min_by("clock_rate", F.when(video & (F.col("clock_rate") > 0), F.col(order.offset))).over(whole)
    return rows.withColumn("video_fps", per_second(median.cast("long"), first.cast("long"))).drop("video_step")


def with_sections(frames: DataFrame, max_gap_ms: int = 5000, order: Order = DEFAULT) -> DataFrame:
    """Adds section_index (from 1) and gap_ms (since the greatest video wall clock before); rows without a clock rate go.

    A video row more than ``max_gap_ms`` after all video rows before it opens a section; audio joins the open one.
    """
    rows = media_rows(frames).where("clock_rate <> 0")
    video = tracks.is_video(F.col("track_id"))
    rows = with_gaps(rows, F.max(F.when(video, F.col("wc_ms"))).over(order.in_partition.rowsBetween(*BEFORE)))
    splits = F.coalesce(F.col("gap_ms") > max_gap_ms, F.lit(False)).cast("int")
    return rows.withColumn("section_index", (F.sum(splits).over(order.in_partition.rowsBetween(*SO_FAR)) + 1).cast("int"))


def with_gaps(rows: DataFrame, before: Column) -> DataFrame:
    """Adds gap_ms to video rows; ``before``: the greatest video wall clock before the row."""
    video = tracks.is_video(F.col("track_id"))
    return rows.withColumn("gap_ms", F.when(video & before.isNotNull(), F.greatest(F.col("wc_ms") - before, F.lit(0).cast("long"))))


def section_summary(frames: DataFrame, max_gap_ms: int = 5000, order: Order = DEFAULT) -> DataFrame:
    """One row per file, partition and section: first and last wall clocks, counts, durations, and what small gaps cost.

    A gap over twice the expected step (from the partition's video rate) and up to ``max_gap_ms`` costs its excess.
    """
    return summarised(with_sections(with_video_rate(media_rows(frames), order), max_gap_ms, order), max_gap_ms, order)


def summarised(rows: DataFrame, max_gap_ms: int, order: Order = DEFAULT) -> DataFrame:
    """A row for each section of rows with section_index, gap_ms and video_fps."""
    expected = F.when(F.col("video_fps") > 0, F.greatest(F.call_function("div", F.lit(1000).cast("long"), F.col("video_fps")), F.lit(1).cast("long")))
    cost = F.when((F.col("gap_ms") > 2 * expected) & (F.col("gap_ms") <= max_gap_ms), F.col("gap_ms") - expected).otherwise(F.lit(0).cast("long"))
    video, audio = tracks.is_video(F.col("track_id")), tracks.is_audio(F.col("track_id"))
    of = lambda which, f: f(F.when(which, F.col("wc_ms")))
    out = rows.groupBy(order.file, "partition_index", "section_index").agg(
        of(video, F.min).alias("video_first_ms"), of(video, F.max).alias("video_last_ms"), of(audio, F.min).alias("audio_first_ms"), of(audio, F.max).alias("audio_last_ms"),
        F.count_if(video).alias("video_frames"), F.count_if(audio).alias("audio_frames"), F.sum(F.coalesce(cost, F.lit(0).cast("long"))).alias("discontinuity_ms"), F.max("video_fps").alias("video_fps"),
    )
    length = lambda kind: F.coalesce(F.col(f"{kind}_last_ms") - F.col(f"{kind}_first_ms"), F.lit(0).cast("long")).alias(f"{kind}_duration_ms")
    return out.select(
        "*", clock.least_known(F.col("video_first_ms"), F.col("audio_first_ms")).alias("start_ms"), clock.greatest_known(F.col("video_last_ms"), F.col("audio_last_ms")).alias("end_ms"), length("video"), length("audio")
    )


def video_codecs(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition: codec of the first video row, upper case."""
    rows = tracks.with_tracks(frames).where("type_char = 'V'")
    return rows.groupBy(order.file, "partition_index").agg(F.upper(F.min_by("codec", order.offset)).alias("video_codec"))


def continuity(records: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """For every record what stood before it, where it was expected, and how many records came before in file and partition."""
    w = order.in_file
    before = lambda c: F.lag(c).over(w)
    part = F.sum((F.col("track_id") == tracks.HEADER).cast("int")).over(w.rowsBetween(*SO_FAR))
    rows = records.withColumn("expected_offset", before(order.offset) + before("total_size")).withColumn("previous_track", before("track_id")).withColumn("previous_size", before("data_size"))
    rows = rows.withColumn("records_before", (F.row_number().over(w) - 1).cast("long")).withColumn("part", part)
    within = F.row_number().over(Window.partitionBy(order.file, "part").orderBy(order.offset)) - 1
    return rows.withColumn("records_in_partition", within.cast("long")).withColumn("broken", F.col("expected_offset") != F.col(order.offset)).drop("part")
