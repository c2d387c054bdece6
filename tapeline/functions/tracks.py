"""The dimension of track kinds, and predicates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "track_id int, track_type string, type_char string, payload_type int, codec string, entry_code string, legacy_code string, group_name string, "
    "group_rank int, samples_per_frame int, stream_format string, is_obu boolean, sample_entry string, extension string"
)
# Kinds of tracks, in the order of SCHEMA.
ROWS = (
    (1, "Reserved", None, 0, None, None, None, None, None, None, None, False, "0", None),
    (5, "Motion", None, 0, None, "M", "M", "Motion", 102, None, None, False, "0", None),
    (6, "Skip", None, 0, None, "Skip", "S", "Skip", 105, None, None, False, "0", None),
    (7, "VideoH264", "V", 1, "h264", "V", "V", "Video (H.264)", 0, None, "h264", False, "0", "h264"),
    (9, "PartitionHeader", None, 0, None, None, None, None, None, None, None, False, "0", None),
    (10, "SmartEvent", None, 0, None, "SE", "E", "Smart Events", 103, None, None, False, "0", None),
    (1000, "AudioAac", "A", 4, "aac", "A", "A", "Audio (AAC)", 0, 1024, "aac", False, "0", "aac"),
    (1001, "AudioRaw", "A", 5, "pcm_alaw", "A", "A", "Audio (Raw)", 0, 1024, "alaw", False, "0", "aac"),
    (1002, "AudioOpus", "A", 6, "opus", "A", "A", "Audio (Opus)", 0, 960, "opus", False, "0", "aac"),
    (1003, "VideoHevc", "V", 2, "hevc", "V", "V", "Video (HEVC)", 0, None, "hevc", False, "hvc1", "hevc"),
    (1004, "VideoAv1", "V", 3, "av1", "V", "V", "Video (AV1)", 0, None, "obu", True, "av01", "av1"),
    (1005, "Talkback", None, 8, None, "TB", "T", "Talkback", 106, None, None, False, "0", None),
    (0x4A70, "Jpeg", None, 0, None, "J", "J", "JPEG", 104, None, None, False, "0", None),
    (0xDA7E, "ClockSync", None, 0, None, "CS", None, "Clock Syncs", 101, None, None, False, "0", None),
)
HEADER, SYNC, MOTION, SMART, JPEG, TALKBACK, SKIP = 9, 0xDA7E, 5, 10, 0x4A70, 1005, 6


def tracks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def with_tracks(records: DataFrame, how: str = "left") -> DataFrame:
    """Records with the dimension's columns; the dimension has a fixed number of rows, so it is broadcast."""
    return records.join(F.broadcast(tracks(records.sparkSession)), "track_id", how)


def known_rows(records: DataFrame) -> DataFrame:
    """Drops unknown and reserved tracks."""
    return with_tracks(records, "inner").where(F.col("track_type") != "Reserved")


def ids(**wanted: str) -> list[int]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return [r[0] for r in ROWS if all(r[names.index(k)] == v for k, v in wanted.items())]


def is_video(track: Column) -> Column:
    return track.isin(ids(type_char="V"))


def is_audio(track: Column) -> Column:
    return track.isin(ids(type_char="A"))


def is_media(track: Column) -> Column:
    return is_video(track) | is_audio(track)


def display_name(group_name: Column, track: Column) -> Column:
    return F.coalesce(group_name, F.concat(F.lit("Track "), track.cast("string")))


def group_label(name: Column, count: Column) -> Column:
    return F.concat(name, F.lit(" ("), count.cast("string"), F.lit(")"))


def entry_offset(entry_code: Column, file_offset: Column, data_offset: Column, legacy: bool) -> Column:
    """Where a metadata entry is said to be: its record in the tree, its data in the legacy listing; media always by data."""
    media = entry_code.isin("V", "A")
    return data_offset if legacy else F.when(media, data_offset).otherwise(file_offset)
