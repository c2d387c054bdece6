"""Timestamp repair, packet timing and export plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import clock, naming, tracks
from tapeline.operators.timeline import BEFORE, DEFAULT, SO_FAR, Order, dts_steps, nominal_rate


def selected_rows(frames: DataFrame, video_track: int | Column, with_audio: bool = True, with_video: bool = True) -> DataFrame:
    """Rows of the chosen video track and, if asked for, of all audio tracks."""
    video = (F.col("track_id") == video_track) & tracks.is_video(F.col("track_id")) & with_video
    return frames.where(video | (tracks.is_audio(F.col("track_id")) & with_audio))


def track_facts(frames: DataFrame, order: Order = DEFAULT, **more: Column) -> DataFrame:
    """file, partition, track, video_track and what is known of each track, in one pass; ``more``: further aggregates.

    frames, clock_rate and start_ms of the first frame, first_offset, nominal_rate (audio: the clock rate).
    ``video_track`` is the file's first video track.
    """
    rows = dts_steps(frames, order).groupBy(order.file, "partition_index", "track_id").agg(
        nominal_rate(rate=F.min_by("clock_rate", order.offset)).alias("fps"), F.count("*").alias("frames"), F.min_by("clock_rate", order.offset).cast("long").alias("clock_rate"),
        F.min_by("wc_ms", order.offset).alias("first_ms"), F.min(order.offset).alias("first_offset"), *(c.alias(n) for n, c in more.items()),
    )
    fps = F.when(F.col("fps").isNull(), F.lit(1).cast("long")).when(F.col("fps") > 120, F.lit(30).cast("long")).otherwise(F.col("fps"))
    first = F.min_by("track_id", F.when(tracks.is_video(F.col("track_id")), F.struct("partition_index", "first_offset"))).over(Window.partitionBy(order.file))
    return rows.select(
        order.file, "partition_index", "track_id", first.alias("video_track"), "frames", "clock_rate", F.when(F.col("clock_rate") > 0, F.col("first_ms")).alias("start_ms"), "first_offset",
        F.when(tracks.is_audio(F.col("track_id")), F.col("clock_rate")).otherwise(fps).alias("nominal_rate"), *more,
    )


def track_summary(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition, track: frames, clock rate and start of the first frame, nominal rate (audio: the clock rate)."""
    return track_facts(frames, order).select(order.file, "partition_index", "track_id", "frames", "clock_rate", "start_ms", "nominal_rate")


def track_counts(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition: numbers of video and audio tracks, and the audio track that comes first."""
    video, audio = tracks.is_video(F.col("track_id")), tracks.is_audio(F.col("track_id"))
    return frames.groupBy(order.file, "partition_index").agg(
        F.count_distinct(F.when(video, F.col("track_id"))).alias("video_tracks"),
        F.count_distinct(F.when(audio, F.col("track_id"))).alias("audio_tracks"),
        F.min_by("track_id", F.when(audio, F.col(order.offset))).alias("first_audio_track"),
    )


def main_video_track(frames: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file: track of the first video row of all partitions, 0 if there is none."""
    first = F.min_by("track_id", F.when(tracks.is_video(F.col("track_id")), F.struct("partition_index", order.offset)))
    return frames.groupBy(order.file).agg(F.coalesce(first, F.lit(0)).alias("video_track"))


def start_times(facts: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partition, video_track: the video track's start if there is a video track, else the first audio track's; from ``track_facts``."""
    video, audio = tracks.is_video(F.col("track_id")), tracks.is_audio(F.col("track_id"))
    rows = facts.groupBy(order.file, "partition_index", "video_track").agg(
        F.bool_or(video).alias("has_video"), F.min_by("start_ms", F.when(video, F.col("first_offset"))).alias("video_start"), F.min_by("start_ms", F.when(audio, F.col("first_offset"))).alias("audio_start")
    )
    return rows.select(order.file, "partition_index", "video_track", F.when(F.col("has_video"), F.col("video_start")).otherwise(F.col("audio_start")).alias("start_ms"))


def first_partition_report(facts: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file: number of partitions, and of the first one tracks and frames that are exported (the file's first video track and all audio), codecs, rates, frames by kind, start.

    From ``track_facts`` of all records, so that partitions without media count. The video counts only if the chosen track is in the first partition.
    """
    rows = tracks.with_tracks(facts)
    top = F.col("partition_index") == 0
    video = top & (F.col("track_id") == F.col("video_track"))
    audio = top & tracks.is_audio(F.col("track_id"))
    of = lambda which, c: F.min_by(c, F.when(which, F.col("first_offset")))
    total = lambda which: F.sum(F.when(which, F.col("frames")))
    start = F.when(F.bool_or(video), of(video, "start_ms")).otherwise(of(audio, "start_ms"))
    return rows.groupBy(order.file).agg(
        F.count_distinct("partition_index").alias("partitions"), F.nullif(F.count_if(top & tracks.is_media(F.col("track_id"))), F.lit(0).cast("long")).alias("tracks"), total(video | audio).alias("frames"),
        of(video, "codec").alias("video_codec"), of(video, "nominal_rate").alias("fps"), total(video).alias("video_frames"),
        of(audio, "codec").alias("audio_codec"), of(audio, "clock_rate").alias("hz"), total(audio).alias("audio_frames"), start.alias("start_ms"),
    )


def monotonic(rows: DataFrame, keys: list[str], value: str, order_by: str) -> DataFrame:
    """Adds i (from 1), rebased and repaired values: each at least one more than the one before, by a running maximum of value - i."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    base = F.greatest(F.col(value) - F.first(value).over(w.rowsBetween(*SO_FAR)), F.lit(0).cast("long"))
    rows = rows.withColumn("i", F.row_number().over(w).cast("long")).withColumn("rebased", base)
    return rows.withColumn("repaired", F.col("i") + F.max(F.col("rebased") - F.col("i")).over(w.rowsBetween(*SO_FAR)))


def corrections(repaired: DataFrame, keys: list[str]) -> DataFrame:
    return repaired.groupBy(*keys).agg(F.count_if(F.col("repaired") != F.col("rebased")).alias("corrections"), F.count("*").alias("frames"), F.max("repaired").alias("last_dts"))


def with_durations(repaired: DataFrame, keys: list[str]) -> DataFrame:
    """Adds duration: to the next frame, for the last one from the one before, 1 at least."""
    w = Window.partitionBy(*keys).orderBy("i")
    y = F.col("repaired")
    return repaired.withColumn("duration", F.greatest(F.coalesce(F.lead(y).over(w) - y, y - F.lag(y).over(w), F.lit(1).cast("long")), F.lit(1).cast("long")))


def constant_plan(rows: DataFrame, keys: list[str], order_by: str, force_rate: int = 0) -> DataFrame:
    """Constant-rate timing: video counts frames, audio counts samples; effective_fps is ``force_rate`` or the export rate."""
    i = (F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)) - 1).cast("long")
    samples = F.when(F.col("type_char") == "A", F.coalesce(F.col("samples_per_frame"), F.lit(1024))).otherwise(1).cast("long")
    fps = F.lit(force_rate).cast("long") if force_rate > 0 else F.col("export_fps")
    return rows.withColumn("pts", i * samples).withColumn("duration", samples).withColumn("effective_fps", fps)


def variable_plan(frames: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Variable-rate packets: repaired dts, duration and key flag of every exported frame, video and audio.

    Video frames take the repaired times of their own track. Audio frames of all tracks are paired by position with the
    first audio track's repaired times and stop where those do; ``mixed_audio`` tells where another track's frames got these times.
    The exported video track is the first one of the keys' frames. Only video packets carry a key flag.
    """
    is_audio, is_video = tracks.is_audio(F.col("track_id")), tracks.is_video(F.col("track_id"))
    first = lambda which: F.min_by("track_id", F.when(which, F.col(order_by))).over(Window.partitionBy(*keys))
    rows = frames.withColumn("first_audio_track", first(is_audio)).withColumn("video_track", first(is_video))
    video = rows.where(F.col("track_id") == F.col("video_track"))
    video = with_durations(monotonic(video, keys, "dts", order_by), keys).withColumn("mixed_audio", F.lit(False)).withColumn("key", F.col("keyframe"))
    audio = rows.where(is_audio)
    times = with_durations(monotonic(audio.where("track_id = first_audio_track"), keys, "dts", order_by), keys).select(*keys, "i", "repaired", "duration")
    numbered = audio.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)).cast("long"))
    paired = numbered.join(times, [*keys, "i"]).withColumn("mixed_audio", F.col("track_id") != F.col("first_audio_track")).withColumn("key", F.lit(False))
    columns = [*keys, order_by, "track_id", "i", "repaired", "duration", "mixed_audio", "key"]
    return video.select(columns).unionByName(paired.select(columns))


def longest_dts(rows: DataFrame) -> DataFrame:
    """From track rows (frames, last_dts, clock_rate, fps, samples, type_char): the greatest dts of both timings, whether it exceeds 32 bits, and the timescale that each timing needs then.

    A constant timing with one frame or without a rate ends at 0.
    """
    n = F.col("frames") - 1
    steady = F.call_function("div", n * F.col("clock_rate"), F.nullif(F.col("fps"), F.lit(0).cast("long")))
    constant = F.when(F.col("type_char") == "A", n * F.col("samples")).otherwise(F.coalesce(steady, F.lit(0).cast("long")))
    out = rows.withColumn("constant_max", constant).withColumn("variable_max", F.col("last_dts"))
    out = out.withColumn("overflows", F.greatest("constant_max", "variable_max") > clock.MAX32)
    return out.withColumn("timescale", clock.reduced_timescale(F.col("variable_max"), F.col("clock_rate"))).withColumn("constant_timescale", clock.reduced_timescale(F.col("constant_max"), F.col("clock_rate")))


def interleaved(rows: DataFrame, keys: list[str], time: str, is_video: Column, order_by: str) -> DataFrame:
    """Adds place: merge order of two streams that compares their heads, video first on ties.

    Taking the lesser head of two streams again and again gives the order of each stream's running maximum.
    """
    rows = rows.withColumn("stream", F.when(is_video, 0).otherwise(1))
    high = F.max(time).over(Window.partitionBy(*keys, "stream").orderBy(order_by).rowsBetween(*SO_FAR))
    rows = rows.withColumn("high", high)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("high", "stream", order_by)).cast("long"))


def sequence_numbers(rows: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Adds sequence16: numbers of a stream's rows, from 0, wrapping at 65536."""
    return rows.withColumn("sequence16", ((F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)) - 1) % 65536).cast("int"))


def layout(rows: DataFrame, keys: list[str], header: str, size: str, order_by: str) -> DataFrame:
    """Adds written_size and written_offset of records written one after the other from offset 0; each ends aligned to 4 bytes."""
    quads = F.call_function("div", F.col(header) + 4 + F.col(size) + 3, F.lit(4).cast("long"))
    rows = rows.withColumn("written_size", quads * 4 + 4)
    before = F.sum("written_size").over(Window.partitionBy(*keys).orderBy(order_by).rowsBetween(*BEFORE))
    return rows.withColumn("written_offset", F.coalesce(before, F.lit(0).cast("long")))


def export_plan(partitions: DataFrame, folder: str = "./", base: Column | None = None, mp4: bool = True) -> DataFrame:
    """Adds output and collides to rows (path, start_ms, extension)."""
    extension = F.lit("mp4") if mp4 else F.coalesce("extension", F.lit("h264"))
    named = partitions.withColumn("output", naming.output_name(F.col("path"), F.timestamp_millis("start_ms"), extension, F.lit(folder), base))
    return named.withColumn("collides", naming.is_collision(F.col("output")))
