"""Registered queries over recordings that are written as files and read again: splits, late payloads, masked copies, the data source.

The files come from the test tables: one recording a user, payloads of one byte to some thousands, and bytes that are no record behind
the last one of every eighth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import decode, naming, tracks
from tapeline.operators import mask, nested, timeline, units
from tapeline.plans import catalog_queries, record_queries
from tapeline.plans import standin as s
from tapeline.session import saved, shared_folder
from tapeline.sources import archive, documents, recordings, sinks, splits, store
from tapeline.streaming import status

#: Bytes of a split here, so that every recording has several.
SMALL_SPLIT = 1 << 13


def _size() -> Column:
    """Bytes of a frame's one unit."""
    at = F.col("file_offset")
    return F.when(at % 8 == 0, at * 977 % 5003 + 1).otherwise(at % 211 + 1)


def written(spark: SparkSession, d: str, name: Column | None = None) -> str:
    """The folder of the recordings, named ``<user>.ubv`` or as told."""
    name = F.concat("file_id", F.lit(".ubv")) if name is None else name
    rate = F.col("clock_rate")
    low = F.when(rate == 90_000, 12).when(rate == 16_000, 6).when(rate == 1000, 2).otherwise(0)
    code = F.when(F.col("keyframe"), 0xE400).otherwise(0xC400) + low
    seconds, rest = F.call_function("div", F.col("sync_ms"), F.lit(1000).cast("long")), F.col("sync_ms") % 1000 * 1_000_000
    unit = F.unhex(F.repeat(F.lpad(F.hex(F.col("file_offset") % 251), 2, "0"), _size().cast("int")))
    payload = F.when(F.col("track_id") == tracks.SYNC, F.concat(decode.big_endian(seconds, 4), decode.big_endian(rest, 4))).when(F.col("track_id") == 7, F.concat(decode.big_endian(_size(), 4), unit)).otherwise(unit)
    rows = s.records(spark, d).select("file_id", "file_offset", archive.encoded(F.col("track_id"), code, F.col("sequence"), F.col("dts"), payload).alias("bytes"))
    ends = rows.where(F.col("file_id").cast("long") % 8 == 0).select("file_id", F.lit(2**62).alias("file_offset"), F.unhex(F.lit("BB01020304050607")).alias("bytes")).distinct()
    folder = shared_folder(spark, "recordings")
    sinks.write_files(rows.unionByName(ends).withColumn("name", name), folder, "name", "file_offset", "bytes").write.format("noop").mode("overwrite").save()
    return folder


def _user(column: str = "file_id") -> Column:
    return F.regexp_extract(column, r"([0-9]+)\.ubv", 1)


def split_scan(spark: SparkSession, d: str) -> DataFrame:
    """The recordings walked in splits, with whether each is broken, and the error rows."""
    rows = splits.scan_files(spark, [written(spark, d)], split=SMALL_SPLIT)
    return rows.select(_user().alias("file_id"), "file_offset", "track_id", "dts", "data_size", F.length("payload").cast("long").alias("inline"), "sync_ms", "broken", F.col("error.code").alias("code"))


def demuxed_streams(spark: SparkSession, d: str) -> DataFrame:
    """The streams of each kind, with payloads read late from the recordings."""
    folder = written(spark, d)
    rows = archive.with_policy(splits.scan_files(spark, [folder], split=SMALL_SPLIT, with_payload=False), "keep_prefix")
    frames = timeline.media_rows(timeline.with_partitions(rows))
    chosen = F.min_by("track_id", F.when(tracks.is_video(F.col("track_id")), F.col("file_offset"))).over(Window.partitionBy("file_id"))
    return sinks.write_streams(frames.withColumn("video_track", chosen), shared_folder(spark, "streams"))


def masked_copies(spark: SparkSession, d: str) -> DataFrame:
    """Masked copies of the recordings, by what they inflate to."""
    folder = written(spark, d)
    files = saved(archive.list_files(spark, [folder])[0])
    rows = archive.with_policy(splits.scan_listed(files, split=SMALL_SPLIT, with_payload=False), "keep_prefix")
    spans = rows.where(mask.is_masked(F.col("track_id"), F.col("data_size"))).select("file_id", F.col("data_offset").alias("start"), F.col("data_size").alias("size"))
    done = sinks.write_masked(files.select(F.col("path").alias("file_id")), spans, shared_folder(spark, "masked"), check=True)
    return done.select("name", "plain_bytes", "md5")


def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Audio of some recordings through the data source, which is told both filters."""
    recordings.register(spark)
    rows = spark.read.format("recordings").option("path", written(spark, d)).load()
    rows = rows.where("track_id = 1000 and file_name >= '1' and file_name < '6'")
    return archive.decoded(rows).where("error is null").select(_user().alias("file_id"), "file_offset", "dts", "sequence", "data_size", "data_offset", "keyframe")


def stored_records(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of seven cameras, three of a day, taken into the store in two runs; then three cameras from the second day on."""
    user = F.col("file_id").cast("long")
    name = F.concat(F.lpad(F.hex(user % 7), 12, "0"), F.lit("_0_rotating_"), (user * 28_800_000 + s.EPOCH_MS).cast("string"), F.lit(".ubv"))
    folder, kept = written(spark, d, name), shared_folder(spark, "store")
    for pattern in (f"{folder}/00000000000[0-3]_*", folder):  # the second run finds what the first has left
        store.ingest(spark, [pattern], kept, split=SMALL_SPLIT)
    rows = store.records(spark, kept).where(F.col("camera").isin("000000000001", "000000000002", "000000000005") & (F.col("day") >= "2024-01-02") & F.col("error").isNull())
    of = F.call_function("div", naming.recorded_ms(naming.file_name(F.col("file_id"))) - s.EPOCH_MS, F.lit(28_800_000).cast("long")).cast("string")
    return rows.select(of.alias("file_id"), "file_offset", "track_id", "dts", "data_size", "camera", "day", "broken")


def structure_documents(spark: SparkSession, d: str) -> DataFrame:
    """Structure documents written a file each, then read again entry by entry."""
    folder = shared_folder(spark, "documents")
    rows = tracks.known_rows(s.clocked(spark, d))
    documents.write_documents(rows, folder).write.format("noop").mode("overwrite").save()
    return documents.flattened(documents.read_documents(spark, [folder]))


def tree_documents(spark: SparkSession, d: str) -> DataFrame:
    """Trees written a file each, then read again entry by entry."""
    folder = shared_folder(spark, "trees")
    documents.write_trees(nested.entries(tracks.known_rows(s.clocked(spark, d))), folder).write.format("noop").mode("overwrite").save()
    return documents.read_trees(spark, [folder])


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """The recordings that a pattern or a path names, once each, with their lengths."""
    folder = written(spark, d)
    files, unmatched = archive.list_files(spark, [f"{folder}/[1-4]*.ubv", f"{folder}/*5.ubv", f"{folder}/1.ubv", f"{folder}/none*"])
    return files.select(_user("path").alias("file_id"), "length", F.lit(len(unmatched)).cast("long").alias("unmatched"))


def followed_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of each file from the changes that a stream of the events gives; they come out of order, and a fifth of them twice."""
    folder = shared_folder(spark, "events")
    events = s.progress(spark, d)
    events.unionByName(events.where("seq % 5 = 0")).repartition(4, F.xxhash64("seq", F.rand(3))).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    out = shared_folder(spark, "changes")
    writer = status.changes_stream(stream).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    status.started(writer, spark).awaitTermination()
    return status.latest(spark.read.schema(status.CHANGES).parquet(f"{out}/rows")).withColumn("outputs", F.array_join("outputs", "|"))


def unit_split_sql(spark: SparkSession, d: str) -> DataFrame:
    """Units by the table function, from SQL."""
    units.register_functions(spark)
    s.payloads(spark, d).createOrReplaceTempView("unit_payloads")
    return spark.sql("SELECT frame_id, CAST(u.unit AS BIGINT) AS unit, md5(u.data) AS md5, CAST(octet_length(u.data) AS BIGINT) AS bytes, u.ok FROM unit_payloads, LATERAL split_units(payload) u")


_SIZE = "CASE WHEN file_offset % 8 = 0 THEN file_offset * 977 % 5003 + 1 ELSE file_offset % 211 + 1 END"
_FILES = f"""{s.RECORDS_SQL},
siz AS (SELECT *, CASE WHEN track_id = 55934 THEN 8 WHEN track_id = 7 THEN {_SIZE} + 4 ELSE {_SIZE} END AS psize FROM rec),
tot AS (SELECT *, 20 + psize + (4 - (20 + psize) % 4) % 4 + 4 AS total_size FROM siz),
pos AS (SELECT *, CAST(coalesce(sum(total_size) OVER (PARTITION BY file_id ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM tot)"""
_UNIT = f"repeat(lpad(hex(file_offset % 251), 2, '0'), CAST({_SIZE} AS INTEGER))"
_HEX = """'A0' || lpad(hex(track_id), 4, '0') || lpad(hex(xor(xor(160, track_id // 256), track_id % 256)), 2, '0') || CASE WHEN keyframe THEN 'E4' ELSE 'C4' END || '0' || CASE clock_rate WHEN 90000 THEN 'C' WHEN 16000 THEN '6' WHEN 1000 THEN '2' ELSE '0' END
 || lpad(hex(sequence), 4, '0') || lpad(hex(dts), 16, '0') || lpad(hex(psize), 8, '0') || {payload} || repeat('00', (4 - (20 + psize) % 4) % 4) || lpad(hex(total_size - 4), 8, '0')"""
_MASKED = f"""CASE WHEN track_id = 55934 THEN lpad(hex(sync_ms // 1000), 8, '0') || lpad(hex(sync_ms % 1000 * 1000000), 8, '0') WHEN track_id IN (7, 1000, 1004, 10) OR track_id = 9 AND psize > 32 THEN repeat('00', CAST(psize AS INTEGER)) ELSE {_UNIT} END"""

QUERIES_SQL = {
    tree_documents: record_queries.QUERIES_SQL[record_queries.info_tree],
    listed_files: f"""WITH {_FILES} SELECT file_id, CAST(sum(total_size) + CASE WHEN CAST(file_id AS BIGINT) % 8 = 0 THEN 8 ELSE 0 END AS BIGINT) AS length, CAST(1 AS BIGINT) AS unmatched FROM pos WHERE file_id[1] BETWEEN '1' AND '4' OR file_id[-1] = '5' GROUP BY file_id""",
    followed_status: catalog_queries.QUERIES_SQL[catalog_queries.file_status],
    structure_documents: record_queries.QUERIES_SQL[record_queries.structure_json],
    unit_split_sql: record_queries.QUERIES_SQL[record_queries.unit_split],
    split_scan: f"""WITH {_FILES} SELECT file_id, begun AS file_offset, track_id, dts, CAST(psize AS BIGINT) AS data_size, CAST(CASE WHEN psize <= 1024 THEN psize END AS BIGINT) AS inline, sync_ms, CAST(file_id AS BIGINT) % 8 = 0 AS broken, NULL::VARCHAR AS code FROM pos
UNION ALL SELECT file_id, CAST(sum(total_size) AS BIGINT), NULL, NULL, NULL, NULL, NULL, true, 'bad_magic' FROM pos WHERE CAST(file_id AS BIGINT) % 8 = 0 GROUP BY file_id""",
    demuxed_streams: f"""WITH {s.CLOCKED_SQL}, v AS (SELECT file_id, arg_min(track_id, file_offset) FILTER (track_id <> 1000) AS chosen FROM frm GROUP BY file_id),
k AS (SELECT *, CASE WHEN track_id = 1000 THEN 'audio.aac' WHEN track_id = 7 THEN 'video.h264' ELSE 'video.av1' END AS kind, CASE WHEN track_id = 7 THEN '00000001' ELSE '' END || {_UNIT} AS x FROM frm JOIN v USING (file_id) WHERE track_id = 1000 OR track_id = chosen)
SELECT file_id || '.ubv_' || partition_index || '_' || kind AS name, count(*) AS frames, CAST(sum(length(x) // 2) AS BIGINT) AS bytes, md5(unhex(string_agg(x, '' ORDER BY file_offset))) AS md5 FROM k GROUP BY file_id, partition_index, kind""",
    masked_copies: f"""WITH {_FILES}, h AS (SELECT file_id, file_offset, {_HEX.format(payload=_MASKED)} AS x FROM pos),
f AS (SELECT file_id, string_agg(x, '' ORDER BY file_offset) || CASE WHEN CAST(file_id AS BIGINT) % 8 = 0 THEN 'BB01020304050607' ELSE '' END AS x FROM h GROUP BY file_id) SELECT 'anonymised-' || file_id || '.ubv.gz' AS name, length(x) // 2 AS plain_bytes, md5(unhex(x)) AS md5 FROM f""",
    stored_records: f"""WITH {_FILES}, c AS (SELECT *, lpad(hex(CAST(file_id AS BIGINT) % 7), 12, '0') AS camera, strftime(make_timestamp((CAST(file_id AS BIGINT) * 28800000 + {s.EPOCH_MS}) * 1000), '%Y-%m-%d') AS day FROM pos)
SELECT file_id, begun AS file_offset, track_id, dts, CAST(psize AS BIGINT) AS data_size, camera, day, CAST(file_id AS BIGINT) % 8 = 0 AS broken FROM c WHERE camera IN ('000000000001', '000000000002', '000000000005') AND day >= '2024-01-02'""",
    source_scan: f"""WITH {_FILES} SELECT file_id, begun AS file_offset, dts, sequence, CAST(psize AS BIGINT) AS data_size, begun + 20 AS data_offset, keyframe FROM pos WHERE track_id = 1000 AND file_id || '.ubv' >= '1' AND file_id || '.ubv' < '6'""",
}
