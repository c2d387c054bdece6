"""Registered queries of nested forms, binary records, masks and payload units, each with its SQL."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import decode, tracks
from tapeline.operators import mask, nested, timeline, units
from tapeline.plans import standin as s
from tapeline.plans.timeline_queries import section_summary
from tapeline.sources import archive

KEY = ["file_id", "partition_index"]


def _known(spark: SparkSession, d: str) -> DataFrame:
    return tracks.known_rows(s.clocked(spark, d))


def structure_json(spark: SparkSession, d: str) -> DataFrame:
    """Files as nested JSON documents, parsed and flattened again."""
    files = nested.structure(_known(spark, d)).select("file_id", F.to_json(F.struct("partitions")).alias("json"))
    files = files.select("file_id", F.from_json("json", nested.SCHEMA)["partitions"].alias("partitions"))
    return nested.flattened(files).withColumn("place", F.col("place").cast("long"))


def structure_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.structure(_known(spark, d)).select("file_id", F.explode("partitions").alias("p"))
    return rows.select("file_id", F.col("p.index").alias("partition_index"), F.col("p.header.file_offset").alias("file_offset"), F.col("p.header.dts").alias("dts"), F.col("p.header.format_code").alias("format_code"), F.array_join("p.header.payload", ",").alias("payload"), F.size("p.entries").cast("long").alias("entries"))


def info_tree(spark: SparkSession, d: str) -> DataFrame:
    """Trees as JSON, parsed again to a row per entry."""
    rows = nested.parsed_tree(nested.tree(nested.entries(_known(spark, d))))
    return rows.where("place is not null").withColumn("place", F.col("place").cast("long")).withColumn("group_place", F.col("group_place").cast("long"))


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.group_counts(nested.entries(_known(spark, d)))
    return rows.select(*KEY, "group_rank", "group_track", "label", "count", "total_entries", "show_keyframe")


def group_order(spark: SparkSession, d: str) -> DataFrame:
    """Media and metadata groups as one list, in canonical order; the total ``wc`` is exact, a bigint as long as every group's fits."""
    found = nested.entries(_known(spark, d))
    media = found.where("group_rank = 0").groupBy("group_rank", "group_track", "group_name").agg(F.count("*").alias("n"), F.sum(F.col("wc").cast("decimal(20,0)")).alias("wc"))
    other = found.where("group_rank > 0").groupBy("group_rank", "group_name").agg(F.count("*").alias("n"))
    both = nested.narrowed(media.unionByName(other, allowMissingColumns=True), "wc")
    return both.orderBy("group_rank", "group_track").select("group_rank", "group_track", "group_name", "n", "wc")


def legacy_listing(spark: SparkSession, d: str) -> DataFrame:
    return nested.listing(timeline.wall_clock_steps(_known(spark, d))).select("file_id", "file_offset", "line")


def summary_text(spark: SparkSession, d: str) -> DataFrame:
    frames = s.frames(spark, d)
    parts = s.partitions(spark, d).select(*KEY).distinct()
    return nested.summary_blocks(parts, section_summary(spark, d), timeline.video_codecs(frames))


def format_codes(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("file_offset") * 40503 % 65536).cast("int")
    rows = s.records(spark, d).select("file_offset", code.alias("code"))
    c = F.col("code")
    bits = {"extended": decode.EXTENDED, "keyframe": decode.KEYFRAME, "has_cts": decode.HAS_CTS, "rate_present": decode.RATE_PRESENT, "dts_64": decode.DTS_64, "has_extra": decode.HAS_EXTRA, "padded": decode.PADDING}
    return rows.select("file_offset", "code", *(decode.has(c, m).alias(n) for n, m in bits.items()), decode.packet_position(c).alias("position"), decode.table_rate(c).alias("rate"), decode.header_length(c).alias("header_bytes"))


def _payload_size():
    return F.when(F.col("track_id") == tracks.SYNC, 8).otherwise(F.col("file_offset") % 37).cast("int")


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """One byte log per user, written from the records; every eighth user's has a bad record at its end."""
    rate = F.col("clock_rate")
    low = F.when(rate == 90_000, 12).when(rate == 16_000, 6).when(rate == 1000, 2).otherwise(0)
    code = F.when(F.col("keyframe"), 0xE400).otherwise(0xC400) + low
    seconds, rest = F.call_function("div", F.col("sync_ms"), F.lit(1000).cast("long")), F.col("sync_ms") % 1000 * 1_000_000
    payload = F.when(F.col("track_id") == tracks.SYNC, F.concat(decode.big_endian(seconds, 4), decode.big_endian(rest, 4))).otherwise(F.unhex(F.repeat(F.lit("5A"), _payload_size())))
    rows = s.records(spark, d).select("file_id", "file_offset", archive.encoded(F.col("track_id"), code, F.col("sequence"), F.col("dts"), payload).alias("bytes"))
    files = units.elementary_streams(rows, ["file_id"], "file_offset", "bytes")
    return files.withColumn("content", F.when(F.col("file_id").cast("long") % 8 == 0, F.concat("content", F.unhex(F.lit("BB01020304050607")))).otherwise(F.col("content")))


def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.scan(_contents(spark, d)).where("error is null")
    return rows.select("file_id", "file_offset", "track_id", "sequence", "dts", "clock_rate", "data_size", "data_offset", "total_size", "keyframe", "packet_position", "sync_ms", F.hex("payload").alias("payload"))


def archive_gzip(spark: SparkSession, d: str) -> DataFrame:
    """The same logs compressed; every sixteenth one is cut in its last bytes."""

    def squeeze(batches):
        for batch in batches:
            packed = [gzip.compress(x.as_py(), mtime=0) for x in batch.column(1)]
            cut = [x[:-9] if int(k.as_py()) % 16 == 1 else x for k, x in zip(batch.column(0), packed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], names=["file_id", "content"])

    rows = archive.scan(_contents(spark, d).select("file_id", "content").mapInArrow(squeeze, "file_id string, content binary"), with_payload=False)
    return rows.groupBy("file_id").agg(F.count_if(F.col("error").isNull()).alias("records"), F.max("error.code").alias("code"))


def archive_errors(spark: SparkSession, d: str) -> DataFrame:
    return archive.errors(archive.scan(_contents(spark, d), with_payload=False)).select("file_id", "code", "offset")


def error_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.scan(_contents(spark, d))
    out = [archive.with_policy(rows, mode).groupBy("file_id").agg(F.count("*").alias("records")).withColumn("mode", F.lit(mode)) for mode in ("drop_file", "keep_prefix")]
    return out[0].unionByName(out[1])


def track_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).withColumn("track_id", F.when(F.col("file_offset") % 17 == 0, 1).when(F.col("file_offset") % 19 == 0, 4242).otherwise(F.col("track_id")))
    return tracks.known_rows(rows).select("file_offset", "track_id", "track_type", "type_char", "payload_type", "codec", tracks.is_media(F.col("track_id")).alias("media"))


def single_track(spark: SparkSession, d: str) -> DataFrame:
    return s.records(spark, d).where("track_id = 1000").select("file_id", "file_offset", "dts")


def track_names(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).withColumn("track_id", F.when(F.col("file_offset") % 19 == 0, 4242).otherwise(F.col("track_id")))
    rows = tracks.with_tracks(rows).groupBy("track_id", "group_name", "entry_code", "legacy_code", "extension", "stream_format", "is_obu", "sample_entry", "samples_per_frame").agg(F.count("*").alias("n"))
    media_name = F.when(F.col("entry_code").isin("V", "A"), F.col("group_name"))
    return rows.select("track_id", tracks.display_name(media_name, F.col("track_id")).alias("name"), "entry_code", "legacy_code", F.coalesce("extension", F.lit("h264")).alias("extension"), "stream_format", "is_obu", "sample_entry", "samples_per_frame", "n")


def chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    return s.frames(spark, d).groupBy("file_id").agg(F.bool_or(F.col("packet_position") != "Single").alias("has_chunks"))


def mask_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).withColumn("data_size", F.col("file_offset") % 40)
    both = [mask.is_masked(F.col("track_id"), F.col("data_size"), keep).alias(n) for keep, n in ((False, "masked"), (True, "masked_but_smart"))]
    return rows.select("file_id", "file_offset", "track_id", "data_size", *both)


def mask_totals(spark: SparkSession, d: str) -> DataFrame:
    return mask.mask_totals(s.records(spark, d).withColumn("data_size", F.col("file_offset") % 40), ["file_id"])


def masked_contents(spark: SparkSession, d: str) -> DataFrame:
    """Byte logs with their masked payloads set to zero, as a digest; a log with a bad record is masked up to it."""
    contents = _contents(spark, d)
    rows = archive.with_policy(archive.scan(contents, with_payload=False), "keep_prefix")
    spans = rows.where(mask.is_masked(F.col("track_id"), F.col("data_size"))).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("data_offset").alias("start"), F.col("data_size").alias("size")))).alias("spans"))
    joined = contents.join(spans, "file_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,size:bigint>>")))
    zeroed = mask.zeroed_content(F.col("content"), F.col("spans"))
    return joined.select("file_id", F.octet_length("content").cast("long").alias("bytes"), F.md5(zeroed).alias("md5"))


def unit_split(spark: SparkSession, d: str) -> DataFrame:
    rows = units.split_units(s.payloads(spark, d), "frame_id")
    return rows.select("frame_id", F.col("unit").cast("long").alias("unit"), F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("bytes"), "ok")


def reframed(spark: SparkSession, d: str) -> DataFrame:
    return units.reframed(s.payloads(spark, d), "frame_id", "is_plain").select("frame_id", F.md5("stream").alias("md5"), "ok")


def elementary_streams(spark: SparkSession, d: str) -> DataFrame:
    rows = units.elementary_streams(s.payloads(spark, d), ["conv_id"], "turn")
    return rows.select("conv_id", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("bytes"))


def kind_streams(spark: SparkSession, d: str) -> DataFrame:
    """For each file and partition the streams of video and audio as digests; a frame's payload is its number as a unit of four bytes."""
    chosen = F.min_by("track_id", F.when(tracks.is_video(F.col("track_id")), F.col("file_offset"))).over(Window.partitionBy("file_id"))
    rows = s.frames(spark, d).withColumn("video_track", chosen).withColumn("payload", F.unhex(F.concat(F.lit("00000004"), F.lpad(F.hex("file_offset"), 8, "0"))))
    rows = units.elementary_streams(units.kinds(rows, KEY, "file_offset"), [*KEY, "kind", "extension"], "file_offset", "stream")
    return rows.select(*KEY, "kind", "extension", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("bytes"))


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same streams in pieces of at least 1000 bytes."""
    rows = units.stream_chunks(s.payloads(spark, d), ["conv_id"], "turn", chunk=1000)
    joined = F.expr("listagg(content) WITHIN GROUP (ORDER BY chunk)")
    return rows.groupBy("conv_id").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("chunks"), F.md5(joined).alias("md5"))


_GROUP = "CASE track_id WHEN 7 THEN 'Video (H.264)' WHEN 1004 THEN 'Video (AV1)' WHEN 1000 THEN 'Audio (AAC)' WHEN 55934 THEN 'Clock Syncs' WHEN 5 THEN 'Motion' WHEN 10 THEN 'Smart Events' END"
_RANK = "CASE track_id WHEN 55934 THEN 101 WHEN 5 THEN 102 WHEN 10 THEN 103 ELSE 0 END"
_GT = "CASE WHEN media THEN track_id ELSE 0 END"
_UNITS = """
uni AS (SELECT conv_id * 1000 + turn AS frame_id, conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS parts, conv_id % 10 = 0 AS broken FROM conversations)"""
_FILE = f"""{s.RECORDS_SQL},
siz AS (SELECT *, CASE WHEN track_id = 55934 THEN 8 ELSE file_offset % 37 END AS psize FROM rec),
tot AS (SELECT *, 20 + psize + (4 - (20 + psize) % 4) % 4 + 4 AS total_size FROM siz),
pos AS (SELECT *, CAST(coalesce(sum(total_size) OVER (PARTITION BY file_id ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM tot)"""
_RECORD_HEX = """'A0' || lpad(hex(track_id), 4, '0') || lpad(hex(xor(xor(160, track_id // 256), track_id % 256)), 2, '0') || CASE WHEN keyframe THEN 'E4' ELSE 'C4' END || '0' || CASE clock_rate WHEN 90000 THEN 'C' WHEN 16000 THEN '6' WHEN 1000 THEN '2' ELSE '0' END
 || lpad(hex(sequence), 4, '0') || lpad(hex(dts), 16, '0') || lpad(hex(psize), 8, '0') || {payload} || repeat('00', (4 - (20 + psize) % 4) % 4) || lpad(hex(total_size - 4), 8, '0')"""
_SYNC_HEX = "lpad(hex(sync_ms // 1000), 8, '0') || lpad(hex(sync_ms % 1000 * 1000000), 8, '0')"

QUERIES_SQL = {
    structure_json: f"""WITH {s.CLOCKED_SQL} SELECT file_id, partition_index, row_number() OVER (PARTITION BY file_id, partition_index ORDER BY file_offset) - 1 AS place,
CASE track_id WHEN 55934 THEN 'ClockSync' WHEN 5 THEN 'Motion' WHEN 10 THEN 'SmartEvent' ELSE 'Frame' END AS kind, CASE WHEN track_id <> 55934 THEN track_id END AS track_id, CASE WHEN track_id = 55934 THEN sc_dts ELSE dts END AS dts,
CASE WHEN track_id = 55934 THEN sc_rate ELSE clock_rate END AS clock_rate, CASE WHEN track_id = 55934 THEN sync_ms ELSE wc END AS wc, sync_nanos AS wc_nanoseconds, CASE WHEN track_id <> 55934 THEN data_offset END AS data_offset, CASE WHEN track_id <> 55934 THEN data_size END AS data_size,
CASE WHEN track_id <> 55934 THEN sequence END AS sequence, CASE WHEN track_id <> 55934 THEN keyframe END AS keyframe, CASE WHEN media THEN packet_position END AS packet_position, CASE WHEN track_id IN (5, 10) THEN file_offset END AS file_offset
FROM clk WHERE track_id <> 9""",
    structure_headers: f"""WITH {s.PARTITIONS_SQL}, h AS (SELECT file_id, partition_index, min(file_offset) FILTER (track_id = 9) AS file_offset, arg_min(dts, file_offset) FILTER (track_id = 9) AS dts, arg_min(format_code, file_offset) FILTER (track_id = 9) AS format_code, count(*) FILTER (track_id <> 9) AS entries FROM part GROUP BY ALL)
SELECT *, concat_ws(',', file_offset // 16777216 % 256, file_offset // 65536 % 256, file_offset // 256 % 256, file_offset % 256) AS payload FROM h""",
    info_tree: f"""WITH {s.CLOCKED_SQL}, g AS (SELECT *, {_RANK} AS gr, {_GT} AS gt, {_GROUP} AS gn FROM clk WHERE track_id <> 9)
SELECT file_id, partition_index, CAST(count(*) OVER (PARTITION BY file_id, partition_index) AS INTEGER) AS total_entries, dense_rank() OVER (PARTITION BY file_id, partition_index ORDER BY gr, gt) - 1 AS group_place,
gn || ' (' || count(*) OVER (PARTITION BY file_id, partition_index, gr, gt) || ')' AS label, row_number() OVER (PARTITION BY file_id, partition_index, gr, gt ORDER BY file_offset) - 1 AS place,
CASE track_id WHEN 55934 THEN 'CS' WHEN 5 THEN 'M' WHEN 10 THEN 'SE' WHEN 1000 THEN 'A' ELSE 'V' END AS type, CASE WHEN track_id <> 55934 THEN track_id END AS track_id, CASE WHEN track_id <> 55934 THEN keyframe END AS keyframe,
CASE WHEN media THEN data_offset WHEN track_id <> 55934 THEN file_offset END AS "offset", CASE WHEN track_id <> 55934 THEN data_size END AS size, CASE WHEN track_id = 55934 THEN sc_dts ELSE dts END AS dts, CASE WHEN media THEN 0::BIGINT END AS cts,
CASE WHEN track_id = 55934 THEN sync_ms ELSE wc END AS wc, CASE WHEN track_id = 55934 THEN sc_rate ELSE clock_rate END AS clock_rate, CASE WHEN track_id <> 55934 THEN sequence END AS sequence, CASE WHEN media THEN packet_position END AS packet_position FROM g""",
    group_counts: f"""WITH {s.CLOCKED_SQL}, g AS (SELECT file_id, partition_index, {_RANK} AS group_rank, {_GT} AS group_track, {_GROUP} AS gn, count(*) AS count, CASE WHEN any_value(track_id) <> 55934 THEN bool_or(keyframe) AND bool_or(NOT keyframe) END AS show_keyframe FROM clk WHERE track_id <> 9 GROUP BY ALL)
SELECT file_id, partition_index, group_rank, group_track, gn || ' (' || count || ')' AS label, count, CAST(sum(count) OVER (PARTITION BY file_id, partition_index) AS BIGINT) AS total_entries, show_keyframe FROM g""",
    group_order: f"WITH {s.CLOCKED_SQL} SELECT {_RANK} AS group_rank, CASE WHEN media THEN track_id END AS group_track, {_GROUP} AS group_name, count(*) AS n, CAST(sum(CASE WHEN media THEN wc END) AS BIGINT) AS wc FROM clk WHERE track_id <> 9 GROUP BY ALL",
    legacy_listing: f"""WITH {s.CLOCKED_SQL}, z AS (SELECT file_id, file_offset, coalesce(wc_ms - lag(wc_ms) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset), 0) AS delta_ms FROM frm)
SELECT c.file_id, c.file_offset, CASE WHEN track_id = 9 THEN '----------- PARTITION START -----------' WHEN track_id = 55934 THEN 'SC: ' || sc_dts || ' ticks @' || sc_rate || 'Hz -> WC: ' || sync_ms || 'ms'
 ELSE format('{{:>4}} {{:>5}} {{:>3}} {{:>16}} {{:>8}} {{:>15}} {{:>5}} {{:>17}} {{:>6}} {{:>7}}', CASE track_id WHEN 5 THEN 'M' WHEN 10 THEN 'E' WHEN 1000 THEN 'A' ELSE 'V' END, CAST(track_id AS VARCHAR), CASE WHEN media THEN CAST(CAST(keyframe AS INTEGER) AS VARCHAR) ELSE '' END, CAST(data_offset AS VARCHAR),
  CAST(data_size AS VARCHAR), CAST(dts AS VARCHAR), CASE WHEN media THEN '0' ELSE '' END, CASE WHEN media THEN CAST(wc AS VARCHAR) ELSE '' END, CAST(clock_rate AS VARCHAR), CASE WHEN media THEN CAST(delta_ms AS VARCHAR) ELSE '' END) END AS line
FROM clk c LEFT JOIN z USING (file_id, file_offset)""",
    summary_text: f"""WITH {s.SECTIONS_SQL}, pk AS (SELECT DISTINCT file_id, partition_index FROM part), vc AS (SELECT file_id, partition_index, arg_min(CASE track_id WHEN 7 THEN 'H264' ELSE 'AV1' END, file_offset) AS codec FROM frm WHERE track_id <> 1000 GROUP BY ALL),
j AS (SELECT *, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d %H:%M:%S') AS a, strftime(make_timestamp(end_ms * 1000), '%Y-%m-%d %H:%M:%S') AS b,
  CASE WHEN video_fps > 0 THEN ':' || lpad(CAST(least((start_ms % 1000 * video_fps + 500) // 1000 + 1, video_fps) AS VARCHAR), 2, '0') || '@' || video_fps ELSE '' END AS fa, CASE WHEN video_fps > 0 THEN ':' || lpad(CAST(least((end_ms % 1000 * video_fps + 500) // 1000 + 1, video_fps) AS VARCHAR), 2, '0') || '@' || video_fps ELSE '' END AS fb,
  coalesce(video_duration_ms, 0) AS v, coalesce(audio_duration_ms, 0) AS u, discontinuity_ms AS x FROM pk LEFT JOIN sections USING (file_id, partition_index) LEFT JOIN vc USING (file_id, partition_index))
SELECT file_id, partition_index, coalesce(section_index, 1) AS section_index, 'PARTITION ' || partition_index || ':' || coalesce(section_index, 1) || chr(10) || 'Start: ' || coalesce(a || fa, '-') || chr(10) || 'End: ' || coalesce(b || fb, '-') || chr(10)
 || 'Video Codec: ' || coalesce(CASE WHEN section_index IS NOT NULL THEN codec END, 'none') || chr(10) || 'Video Duration: ' || format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', v // 3600000, v % 3600000 // 60000, v % 60000 // 1000, v % 1000) || chr(10)
 || 'Audio Duration: ' || format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', u // 3600000, u % 3600000 // 60000, u % 60000 // 1000, u % 1000)
 || CASE WHEN x > 0 THEN chr(10) || 'Discontinuities: ' || format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', x // 3600000, x % 3600000 // 60000, x % 60000 // 1000, x % 1000) ELSE '' END AS block FROM j""",
    format_codes: f"""WITH {s.RECORDS_SQL}, c AS (SELECT file_offset, CAST(file_offset * 40503 % 65536 AS INTEGER) AS code FROM rec), h AS (SELECT *, code // 256 AS b FROM c)
SELECT file_offset, code, b & 128 <> 0 AS extended, b & 32 <> 0 AS keyframe, b & 16 <> 0 AS has_cts, b & 8 <> 0 AS rate_present, b & 4 <> 0 AS dts_64, b & 2 <> 0 AS has_extra, b & 1 <> 0 AS padded, ['Middle', 'Last', 'First', 'Single'][b // 64 + 1] AS position,
CAST([0, 0, 1000, 8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 90000, 1000000, 1000000000, 0][code % 16 + 1] AS BIGINT) AS rate,
CAST(8 + CASE WHEN code % 16 = 1 THEN 4 ELSE 0 END + CASE WHEN b & 4 <> 0 THEN 8 ELSE 4 END + CASE WHEN b & 2 <> 0 THEN 4 ELSE 0 END + CASE WHEN b & 64 = 0 THEN 4 ELSE 0 END AS INTEGER) AS header_bytes FROM h""",
    archive_scan: f"""WITH {_FILE} SELECT file_id, begun AS file_offset, track_id, sequence, dts, clock_rate, CAST(psize AS BIGINT) AS data_size, begun + 20 AS data_offset, total_size, keyframe, 'Single' AS packet_position, sync_ms,
CASE WHEN track_id = 55934 THEN {_SYNC_HEX} ELSE repeat('5A', psize) END AS payload FROM pos""",
    archive_gzip: f"""WITH {_FILE} SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 16 = 1 THEN 0 ELSE count(*) END AS records,
CASE WHEN CAST(file_id AS BIGINT) % 16 = 1 THEN 'bad_gzip' WHEN CAST(file_id AS BIGINT) % 8 = 0 THEN 'bad_magic' END AS code FROM pos GROUP BY file_id""",
    archive_errors: f"WITH {_FILE} SELECT file_id, 'bad_magic' AS code, CAST(sum(total_size) AS BIGINT) AS \"offset\" FROM pos WHERE CAST(file_id AS BIGINT) % 8 = 0 GROUP BY file_id",
    error_policy: f"WITH {s.RECORDS_SQL} SELECT file_id, count(*) AS records, 'keep_prefix' AS mode FROM rec GROUP BY file_id UNION ALL SELECT file_id, count(*), 'drop_file' FROM rec WHERE CAST(file_id AS BIGINT) % 8 <> 0 GROUP BY file_id",
    track_filter: f"""WITH {s.RECORDS_SQL}, z AS (SELECT file_offset, CASE WHEN file_offset % 17 = 0 THEN 1 WHEN file_offset % 19 = 0 THEN 4242 ELSE track_id END AS track_id FROM rec)
SELECT file_offset, track_id, CASE track_id WHEN 7 THEN 'VideoH264' WHEN 1004 THEN 'VideoAv1' WHEN 1000 THEN 'AudioAac' WHEN 55934 THEN 'ClockSync' WHEN 5 THEN 'Motion' WHEN 10 THEN 'SmartEvent' WHEN 9 THEN 'PartitionHeader' END AS track_type,
CASE WHEN track_id IN (7, 1004) THEN 'V' WHEN track_id = 1000 THEN 'A' END AS type_char, CASE track_id WHEN 7 THEN 1 WHEN 1004 THEN 3 WHEN 1000 THEN 4 ELSE 0 END AS payload_type, CASE track_id WHEN 7 THEN 'h264' WHEN 1004 THEN 'av1' WHEN 1000 THEN 'aac' END AS codec, track_id IN (7, 1000, 1004) AS media
FROM z WHERE track_id NOT IN (1, 4242)""",
    single_track: f"WITH {s.RECORDS_SQL} SELECT file_id, file_offset, dts FROM rec WHERE track_id = 1000",
    track_names: f"""WITH {s.RECORDS_SQL}, z AS (SELECT CASE WHEN file_offset % 19 = 0 THEN 4242 ELSE track_id END AS track_id FROM rec)
SELECT track_id, CASE track_id WHEN 7 THEN 'Video (H.264)' WHEN 1004 THEN 'Video (AV1)' WHEN 1000 THEN 'Audio (AAC)' ELSE 'Track ' || track_id END AS name, CASE track_id WHEN 7 THEN 'V' WHEN 1004 THEN 'V' WHEN 1000 THEN 'A' WHEN 55934 THEN 'CS' WHEN 5 THEN 'M' WHEN 10 THEN 'SE' END AS entry_code,
CASE track_id WHEN 7 THEN 'V' WHEN 1004 THEN 'V' WHEN 1000 THEN 'A' WHEN 5 THEN 'M' WHEN 10 THEN 'E' END AS legacy_code, CASE track_id WHEN 1004 THEN 'av1' WHEN 1000 THEN 'aac' ELSE 'h264' END AS extension, CASE track_id WHEN 7 THEN 'h264' WHEN 1004 THEN 'obu' WHEN 1000 THEN 'aac' END AS stream_format,
CASE WHEN track_id <> 4242 THEN track_id = 1004 END AS is_obu, CASE track_id WHEN 4242 THEN NULL WHEN 1004 THEN 'av01' ELSE '0' END AS sample_entry, CASE track_id WHEN 1000 THEN 1024 END AS samples_per_frame, count(*) AS n FROM z GROUP BY track_id""",
    chunk_flags: f"WITH {s.CLOCKED_SQL} SELECT file_id, bool_or(packet_position <> 'Single') AS has_chunks FROM frm GROUP BY file_id",
    mask_rows: f"""WITH {s.RECORDS_SQL}, z AS (SELECT file_id, file_offset, track_id, file_offset % 40 AS data_size FROM rec) SELECT *, data_size > 0 AND (track_id IN (7, 1000, 1004, 10) OR track_id = 9 AND data_size > 32) AS masked, data_size > 0 AND (track_id IN (7, 1000, 1004) OR track_id = 9 AND data_size > 32) AS masked_but_smart FROM z""",
    mask_totals: f"""WITH {s.RECORDS_SQL}, z AS (SELECT file_id, track_id, file_offset % 40 AS data_size FROM rec), m AS (SELECT *, data_size > 0 AND (track_id IN (7, 1000, 1004, 10) OR track_id = 9 AND data_size > 32) AS masked FROM z)
SELECT file_id, count(*) AS seen, count(*) FILTER (masked) AS zeroed, CAST(sum(CASE WHEN masked THEN data_size ELSE 0 END) AS BIGINT) AS bytes_zeroed FROM m GROUP BY file_id""",
    masked_contents: f"""WITH {_FILE}, h AS (SELECT file_id, file_offset, {_RECORD_HEX.format(payload=f"CASE WHEN track_id = 55934 THEN {_SYNC_HEX} WHEN track_id IN (7, 1000, 1004, 10) OR track_id = 9 AND psize > 32 THEN repeat('00', psize) ELSE repeat('5A', psize) END")} AS x FROM pos),
f AS (SELECT file_id, string_agg(x, '' ORDER BY file_offset) || CASE WHEN CAST(file_id AS BIGINT) % 8 = 0 THEN 'BB01020304050607' ELSE '' END AS x FROM h GROUP BY file_id) SELECT file_id, length(x) // 2 AS bytes, md5(unhex(x)) AS md5 FROM f""",
    unit_split: f"""WITH {_UNITS}, z AS (SELECT frame_id, broken, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS unit, len(parts) AS n FROM uni)
SELECT frame_id, unit, md5(encode(p)) AS md5, octet_length(encode(p)) AS bytes, true AS ok FROM z UNION ALL SELECT frame_id, len(parts), md5(encode('A')), 1, false FROM uni WHERE broken""",
    reframed: f"""WITH {_UNITS}, z AS (SELECT frame_id, turn, broken, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM uni)
SELECT frame_id, md5(unhex(string_agg(CASE WHEN turn % 3 = 2 THEN lpad(hex(octet_length(encode(p))), 8, '0') ELSE '00000001' END || hex(encode(p)), '' ORDER BY i) || CASE WHEN any_value(turn) % 3 = 2 AND any_value(broken) THEN '000000FF41' ELSE '' END)) AS md5, any_value(turn) % 3 = 2 OR NOT any_value(broken) AS ok FROM z GROUP BY frame_id""",
    elementary_streams: f"""WITH {_UNITS}, z AS (SELECT conv_id, turn, broken, unnest(parts) AS p, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM uni),
x AS (SELECT conv_id, string_agg(lpad(hex(octet_length(encode(p))), 8, '0') || hex(encode(p)) || CASE WHEN broken AND i = n THEN '000000FF41' ELSE '' END, '' ORDER BY turn, i) AS h FROM z GROUP BY conv_id) SELECT conv_id, md5(unhex(h)) AS md5, length(h) // 2 AS bytes FROM x""",
    kind_streams: f"""WITH {s.CLOCKED_SQL}, v AS (SELECT file_id, arg_min(track_id, file_offset) FILTER (track_id <> 1000) AS chosen FROM frm GROUP BY file_id),
k AS (SELECT *, CASE WHEN track_id = 1000 THEN 'audio' ELSE 'video' END AS kind, CASE track_id WHEN 1000 THEN 'aac' WHEN 7 THEN 'h264' ELSE 'av1' END AS extension,
      CASE WHEN track_id = 7 THEN '00000001' ELSE '00000004' END || lpad(hex(file_offset), 8, '0') AS x FROM frm JOIN v USING (file_id) WHERE track_id = 1000 OR track_id = chosen)
SELECT file_id, partition_index, kind, extension, md5(unhex(string_agg(x, '' ORDER BY file_offset))) AS md5, 8 * count(*) AS bytes FROM k GROUP BY ALL""",
    stream_chunks: f"""WITH RECURSIVE {_UNITS}, w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(list_sum([octet_length(encode(p)) + 4 FOR p IN parts]) + CASE WHEN broken THEN 5 ELSE 0 END AS BIGINT) AS b FROM uni),
c AS (SELECT conv_id, i, b AS held, 1::BIGINT AS n FROM w WHERE i = 1 UNION ALL SELECT c.conv_id, w.i, CASE WHEN held >= 1000 THEN w.b ELSE held + w.b END, CASE WHEN held >= 1000 THEN n + 1 ELSE n END FROM c JOIN w ON w.conv_id = c.conv_id AND w.i = c.i + 1),
z AS (SELECT conv_id, turn, broken, unnest(parts) AS p, generate_subscripts(parts, 1) AS i, len(parts) AS m FROM uni),
x AS (SELECT conv_id, md5(unhex(string_agg(lpad(hex(octet_length(encode(p))), 8, '0') || hex(encode(p)) || CASE WHEN broken AND i = m THEN '000000FF41' ELSE '' END, '' ORDER BY turn, i))) AS md5 FROM z GROUP BY conv_id)
SELECT conv_id, (SELECT CAST(sum(b) AS BIGINT) FROM w WHERE w.conv_id = c.conv_id) AS bytes, max(n) AS chunks, any_value(md5) AS md5 FROM c JOIN x USING (conv_id) GROUP BY conv_id""",
}
