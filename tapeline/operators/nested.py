"""Nested forms of records: the tagged structure, the tree of groups, text listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import clock, naming, tracks
from tapeline.operators.timeline import DEFAULT, Order
from tapeline.session import saved

_RECORD = "track_id: int, data_offset: bigint, data_size: bigint, dts: bigint, clock_rate: bigint, sequence: int, keyframe: boolean"
FRAME = f"struct<type_char: string, {_RECORD}, cts: bigint, wc: bigint, packet_position: string>"
METADATA = f"struct<{_RECORD}, file_offset: bigint>"
SYNC = "struct<sc_dts: bigint, sc_rate: bigint, wc_ms: bigint, wc_seconds: bigint, wc_nanoseconds: bigint>"
# Names of the kinds of metadata entries, as tags of the structure.
KINDS = ("Motion", "SmartEvent", "Jpeg", "Skip", "Talkback")
ENTRY = f"struct<ClockSync: {SYNC}, Frame: {FRAME}, {', '.join(f'{k}: {METADATA}' for k in KINDS)}>"
HEADER = "struct<file_offset: bigint, dts: bigint, clock_rate: bigint, format_code: int, payload: array<smallint>>"
PARTITION = f"struct<index: int, entries: array<{ENTRY}>, header: {HEADER}>"
SCHEMA = f"partitions array<{PARTITION}>"


def tagged(rows: DataFrame) -> DataFrame:
    """Adds entry: one member that is not null, by the kind of track. Rows are with ``tracks`` columns and wall clocks."""
    fields = lambda schema: [f.split(":")[0].strip() for f in schema[schema.index("<") + 1 : -1].split(", ")]
    seconds = F.call_function("div", F.col("sync_ms"), F.lit(1000).cast("long"))
    nanos = F.col("sync_ms") % 1000 * 1_000_000  # for rows that carry milliseconds only
    nanos = F.coalesce(F.col("sync_nanos"), nanos) if "sync_nanos" in rows.columns else nanos
    sync = F.struct("sc_dts", "sc_rate", F.col("sync_ms").alias("wc_ms"), seconds.alias("wc_seconds"), nanos.alias("wc_nanoseconds")).cast(SYNC)
    frame = F.struct(*(F.lit(0).cast("long").alias("cts") if c == "cts" else F.col(c) for c in fields(FRAME))).cast(FRAME)
    metadata = F.struct(*fields(METADATA)).cast(METADATA)
    members = [F.when(F.col("track_type") == "ClockSync", sync).alias("ClockSync"), F.when(F.col("type_char").isNotNull(), frame).alias("Frame")]
    return rows.withColumn("entry", F.struct(*members, *(F.when(F.col("track_type") == k, metadata).alias(k) for k in KINDS)))


def byte_values(data: Column) -> Column:
    """array<smallint> of the bytes, 0 to 255."""
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("smallint"))


def header_of(rows: DataFrame) -> Column:
    """The header that a partition's first record tells."""
    none = F.lit(None).cast("array<smallint>")
    payload = F.when(F.col("payload").isNotNull(), byte_values(F.col("payload"))) if "payload" in rows.columns else none
    return F.struct("file_offset", "dts", "clock_rate", "format_code", payload.alias("payload")).cast(HEADER)


def structure(rows: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """file, partitions: the whole parsed file as one nested value, in file order; arrays hold one recording's records (``documents`` has no such bound)."""
    header = header_of(rows)
    is_header = F.col("track_type") == "PartitionHeader"
    entries = F.collect_list(F.when(~is_header, F.struct(F.col(order.offset).alias("at"), "entry")))
    parts = tagged(rows).groupBy(order.file, "partition_index").agg(
        F.transform(F.array_sort(entries), lambda x: x["entry"]).alias("entries"), F.min_by(F.when(is_header, header), F.when(is_header, F.col(order.offset))).alias("header")
    )
    part = F.struct(F.col("partition_index").alias("index"), "entries", "header")
    return parts.groupBy(order.file).agg(F.array_sort(F.collect_list(part), lambda a, b: a["index"] - b["index"]).alias("partitions"))


def flattened(files: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """The inverse of ``structure``: one row per entry, the members' fields merged, absent ones null."""
    rows = files.select(order.file, F.explode("partitions").alias("p")).select(order.file, F.col("p.index").alias("partition_index"), F.posexplode("p.entries").alias("place", "e"))
    return merged_fields(rows, order)


def merged_fields(rows: DataFrame, order: Order = DEFAULT) -> DataFrame:
    """Rows of (file, partition_index, place, e) with the fields of whichever member ``e`` has."""
    first = lambda name, *members: F.coalesce(*(F.col(f"e.{m}.{name}") for m in members)).alias(name)
    kind = F.coalesce(*(F.when(F.col(f"e.{k}").isNotNull(), F.lit(k)) for k in ("ClockSync", "Frame", *KINDS))).alias("kind")
    both = ("Frame", *KINDS)
    return rows.select(
        order.file, "partition_index", "place", kind, first("track_id", *both), F.coalesce(F.col("e.ClockSync.sc_dts"), *(F.col(f"e.{m}.dts") for m in both)).alias("dts"),
        F.coalesce(F.col("e.ClockSync.sc_rate"), *(F.col(f"e.{m}.clock_rate") for m in both)).alias("clock_rate"), F.coalesce(F.col("e.ClockSync.wc_ms"), F.col("e.Frame.wc")).alias("wc"), F.col("e.ClockSync.wc_nanoseconds").alias("wc_nanoseconds"),
        first("data_offset", *both), first("data_size", *both), first("sequence", *both), first("keyframe", *both), F.col("e.Frame.packet_position").alias("packet_position"), first("file_offset", *KINDS),
    )


def write_structure(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").option("compression", "gzip").json(path)


def read_structure(spark, path: str) -> DataFrame:
    """A folder of structure documents, each a line; ``file_id`` is the file's name."""
    rows = spark.read.schema(f"file_id string, {SCHEMA}").json(path)
    return rows.withColumn("file_id", F.coalesce("file_id", naming.file_name(F.input_file_name())))


def entries(rows: DataFrame) -> DataFrame:
    """Entry rows of the tree: group name and rank, type code, offset, and the fields that the kind has."""
    sync, media = F.col("track_type") == "ClockSync", F.col("type_char").isNotNull()
    known = rows.where(F.col("group_name").isNotNull())
    return known.select(
        "file_id", "partition_index", "file_offset", "group_rank", F.when(media, F.col("track_id")).otherwise(0).alias("group_track"), F.col("group_name"), F.col("entry_code").alias("type"),
        F.when(~sync, F.col("track_id")).alias("track_id"), F.when(~sync, F.col("keyframe")).alias("keyframe"),
        F.when(~sync, tracks.entry_offset(F.col("entry_code"), F.col("file_offset"), F.col("data_offset"), legacy=False)).alias("offset"), F.when(~sync, F.col("data_size")).alias("size"),
        F.when(sync, F.col("sc_dts")).otherwise(F.col("dts")).alias("dts"), F.when(media, F.lit(0).cast("long")).alias("cts"), F.when(sync, F.col("sync_ms")).otherwise(F.col("wc")).alias("wc"),
        F.when(sync, F.col("sc_rate")).otherwise(F.col("clock_rate")).alias("clock_rate"), F.when(~sync, F.col("sequence")).alias("sequence"), F.when(media, F.col("packet_position")).alias("packet_position"),
    )


def group_counts(found: DataFrame) -> DataFrame:
    """Rows of ``entries`` counted by group, with the group's label and the partition's total by a window."""
    rows = found.groupBy("file_id", "partition_index", "group_rank", "group_track", "group_name").agg(F.count("*").alias("count"), (F.bool_or("keyframe") & F.bool_or(~F.col("keyframe"))).alias("show_keyframe"))
    rows = rows.withColumn("total_entries", F.sum("count").over(Window.partitionBy("file_id", "partition_index")))
    return rows.withColumn("label", tracks.group_label(F.col("group_name"), F.col("count")))


def narrowed(rows: DataFrame, total: str) -> DataFrame:
    """``rows`` with the decimal column ``total`` as a bigint if all its values fit, else as the decimals they are: no total is lost. Kept, as the values decide."""
    rows = saved(rows)
    fits = F.col(total).try_cast("long").isNotNull() | F.col(total).isNull()
    return rows.withColumn(total, F.col(total).cast("long")) if rows.where(~fits).isEmpty() else rows


FIELDS = ("type", "track_id", "keyframe", "offset", "size", "dts", "cts", "wc", "clock_rate", "sequence", "packet_position")


def tree(found: DataFrame) -> DataFrame:
    """file_id, tree: partition -> groups in canonical order -> entries in file order, as JSON without null fields."""
    entry = F.struct("file_offset", F.struct(*FIELDS).alias("e"))
    groups = found.groupBy("file_id", "partition_index", "group_rank", "group_track", "group_name").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    group = F.struct("group_rank", "group_track", tracks.group_label(F.col("group_name"), F.size("list")).alias("label"), F.size("list").alias("count"), F.transform("list", lambda x: x["e"]).alias("entries"))
    drop = lambda x: F.struct(x["label"].alias("label"), x["count"].alias("count"), x["entries"].alias("entries"))
    sort = lambda c: F.array_sort(F.collect_list(c), lambda a, b: F.when(a["group_rank"] != b["group_rank"], a["group_rank"] - b["group_rank"]).otherwise(a["group_track"] - b["group_track"]))
    parts = groups.groupBy("file_id", "partition_index").agg(F.transform(sort(group), drop).alias("groups"))
    total = F.aggregate("groups", F.lit(0), lambda a, g: a + g["count"])
    part = F.struct(F.concat(F.lit("Partition "), F.col("partition_index").cast("string")).alias("label"), F.col("partition_index").alias("index"), total.alias("total_entries"), "groups")
    files = parts.groupBy("file_id").agg(F.array_sort(F.collect_list(part), lambda a, b: a["index"] - b["index"]).alias("partitions"))
    return files.select("file_id", F.to_json(F.struct("partitions")).alias("tree"))


TREE_ENTRY = "type string, track_id int, keyframe boolean, offset bigint, size bigint, dts bigint, cts bigint, wc bigint, clock_rate bigint, sequence int, packet_position string"
TREE = f"partitions array<struct<label:string,index:int,total_entries:int,groups:array<struct<label:string,count:int,entries:array<struct<{TREE_ENTRY.replace(', ', ',').replace(' ', ':')}>>>>>>"


def parsed_tree(trees: DataFrame) -> DataFrame:
    """One row per entry of trees, with the places of group and entry; absent fields are null."""
    parts = trees.select("file_id", F.explode_outer(F.from_json("tree", TREE)["partitions"]).alias("p"))
    groups = parts.select("file_id", F.col("p.index").alias("partition_index"), "p.total_entries", F.posexplode_outer("p.groups").alias("group_place", "g"))
    return groups.select("file_id", "partition_index", "total_entries", "group_place", F.col("g.label").alias("label"), F.posexplode_outer("g.entries").alias("place", "e")).select("file_id", "partition_index", "total_entries", "group_place", "label", "place", "e.*")


def listing(rows: DataFrame) -> DataFrame:
    """Adds line: fixed-width columns for media and metadata, ``SC:`` lines for clock syncs, a rule for headers. Needs delta_ms on media rows."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    media = F.col("type_char").isNotNull()
    only = lambda c: F.when(media, s(c)).otherwise("")
    fixed = F.format_string(
        "%4s %5s %3s %16s %8s %15s %5s %17s %6s %7s", F.col("legacy_code"), s(F.col("track_id")), only(F.col("keyframe").cast("int")), s(F.col("data_offset")), s(F.col("data_size")), s(F.col("dts")),
        only(F.lit(0)), only(F.col("wc")), s(F.col("clock_rate")), only(F.col("delta_ms")),
    )
    sync = F.format_string("SC: %d ticks @%dHz -> WC: %dms", "sc_dts", "sc_rate", "sync_ms")
    line = F.when(F.col("track_type") == "PartitionHeader", F.lit("----------- PARTITION START -----------")).when(F.col("track_type") == "ClockSync", sync).when(F.col("legacy_code").isNotNull(), fixed)
    return rows.withColumn("line", line).where("line is not null")


def summary_blocks(partitions: DataFrame, sections: DataFrame, codecs: DataFrame) -> DataFrame:
    """One text block for each section; a partition without any gets one block of dashes."""
    keys = ["file_id", "partition_index"]
    rows = partitions.join(sections, keys, "left").join(codecs, keys, "left")
    zero = F.lit(0).cast("long")
    clock_of = lambda c: clock.timecode_with_base(F.col(c), F.col("video_fps"))
    length = lambda c: clock.duration(F.coalesce(F.col(c), zero))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("PARTITION "), F.col("partition_index").cast("string"), F.lit(":"), F.coalesce("section_index", F.lit(1)).cast("string")),
        F.concat(F.lit("Start: "), clock_of("start_ms")), F.concat(F.lit("End: "), clock_of("end_ms")), F.concat(F.lit("Video Codec: "), F.coalesce(F.when(F.col("section_index").isNotNull(), F.col("video_codec")), F.lit("none"))),
        F.concat(F.lit("Video Duration: "), length("video_duration_ms")), F.concat(F.lit("Audio Duration: "), length("audio_duration_ms")),
        F.when(F.col("discontinuity_ms") > 0, F.concat(F.lit("Discontinuities: "), length("discontinuity_ms"))),
    )
    return rows.select(*keys, F.coalesce("section_index", F.lit(1)).alias("section_index"), block.alias("block"))


def write_lines(rows: DataFrame, line: str, path: str, *order_by: str) -> None:
    """Text files whose lines are in order, globally over the files by a range partitioning."""
    rows.orderBy(*order_by).select(line).write.mode("overwrite").text(path)
