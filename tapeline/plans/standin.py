"""The test tables read as recordings: ``events`` as records, ``customer`` as cameras and file names, ``conversations`` as payloads.

Each mapping has its twin in SQL, so that queries over it can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import tracks
from tapeline.operators import timeline
from tapeline.session import table

EPOCH_MS = 1_704_067_200_000
#: One user has a video event about every 54 h.
MAX_GAP_MS = 72 * 3_600_000


def _div(a, b: int):
    return F.call_function("div", a, F.lit(b).cast("long"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, file_offset and the other columns of a record for every event."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    track = F.when(kind == "error", tracks.HEADER).when(kind == "signup", tracks.SYNC).when(kind == "view", F.when(F.col("user_id") % 5 == 4, 1004).otherwise(7)).when(kind == "click", 1000).when(kind == "purchase", F.when(F.col("event_id") % 3 == 0, tracks.SMART).otherwise(tracks.MOTION))
    rows = ev.select(
        F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("file_offset"), track.alias("track_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall_ms"),
        F.round(F.col("value") * 100).cast("long").alias("ticks"),
    ).where("track_id is not null")
    rate = F.when(F.col("track_id").isin(7, 1004, 9), 90_000).when(F.col("track_id") == 1000, F.when(F.col("file_offset") % 11 == 0, 0).otherwise(16_000)).otherwise(1000).cast("long")
    rel, at = F.col("wall_ms") - EPOCH_MS, F.col("file_offset")
    sync = F.col("track_id") == tracks.SYNC
    rows = rows.withColumn("clock_rate", rate)
    return rows.select(
        "*", _div(rel * F.col("clock_rate"), 1000).alias("dts"), F.when(sync, rel + at % 7).alias("sc_dts"), F.when(sync, F.lit(1000).cast("long")).alias("sc_rate"), F.when(sync, F.col("wall_ms")).alias("sync_ms"), F.when(sync, F.col("wall_ms") % 1000 * 1_000_000 + at % 1_000_000).alias("sync_nanos"),
        F.when(F.col("track_id") == tracks.HEADER, F.unhex(F.lpad(F.hex(at), 8, "0"))).alias("payload"),
        (at % 3000 + 16).alias("data_size"), (at * 4096 + 20).alias("data_offset"), (at % 65536).cast("int").alias("sequence"), (at % 4 == 0).alias("keyframe"), (at % 16 + 64768).cast("int").alias("format_code"),
        F.when(at % 50 == 0, "First").when(at % 50 == 1, "Last").otherwise("Single").alias("packet_position"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_partitions(records(spark, sf_dir))


def clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_wall_clock(partitions(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.media_rows(clocked(spark, sf_dir))


RECORDS_SQL = f"""
rec0 AS (
  SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS file_offset, epoch_us(ts) // 1000 AS wall_ms, CAST(round(value * 100) AS BIGINT) AS ticks,
         CASE event_type WHEN 'error' THEN 9 WHEN 'signup' THEN 55934 WHEN 'view' THEN CASE WHEN user_id % 5 = 4 THEN 1004 ELSE 7 END WHEN 'click' THEN 1000
              WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 10 ELSE 5 END END AS track_id
  FROM events),
rec1 AS (SELECT *, CAST(CASE WHEN track_id IN (7, 1004, 9) THEN 90000 WHEN track_id = 1000 THEN CASE WHEN file_offset % 11 = 0 THEN 0 ELSE 16000 END ELSE 1000 END AS BIGINT) AS clock_rate FROM rec0 WHERE track_id IS NOT NULL),
rec AS (
  SELECT *, (wall_ms - {EPOCH_MS}) * clock_rate // 1000 AS dts, file_offset % 3000 + 16 AS data_size, file_offset * 4096 + 20 AS data_offset, CAST(file_offset % 65536 AS INTEGER) AS sequence,
         file_offset % 4 = 0 AS keyframe, CAST(file_offset % 16 + 64768 AS INTEGER) AS format_code, CASE file_offset % 50 WHEN 0 THEN 'First' WHEN 1 THEN 'Last' ELSE 'Single' END AS packet_position,
         CASE WHEN track_id = 55934 THEN wall_ms - {EPOCH_MS} + file_offset % 7 END AS sc_dts, CASE WHEN track_id = 55934 THEN 1000::BIGINT END AS sc_rate, CASE WHEN track_id = 55934 THEN wall_ms END AS sync_ms,
         CASE WHEN track_id = 55934 THEN wall_ms % 1000 * 1000000 + file_offset % 1000000 END AS sync_nanos
  FROM rec1)"""
PARTITIONS_SQL = f"""{RECORDS_SQL},
part AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN track_id = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY file_offset) - 1 AS INTEGER) AS partition_index FROM rec) WHERE partition_index >= 0)"""
_SCALED = "(({x}) // ({b}) * ({r}) + (({x}) % ({b}) * ({r}) + ({b}) // 2) // ({b}))"
CLOCKED_SQL = f"""{PARTITIONS_SQL},
syn AS (
  SELECT *, last_value(sc_dts IGNORE NULLS) OVER w AS s_dts, last_value(sync_ms IGNORE NULLS) OVER w AS s_ms, track_id IN (7, 1000, 1004) AS media
  FROM part WINDOW w AS (PARTITION BY file_id, partition_index ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wcl AS (
  SELECT *, CASE WHEN media THEN CASE WHEN s_dts IS NULL THEN 0 ELSE greatest(dts + {_SCALED.format(x="s_ms", r="clock_rate", b="1000")} - {_SCALED.format(x="s_dts", r="clock_rate", b="1000")}, 0) END END AS wc,
         media AND s_dts IS NOT NULL AS has_sync FROM syn),
clk AS (SELECT *, CASE WHEN media THEN CASE WHEN clock_rate = 0 THEN 0 ELSE (wc // clock_rate) * 1000 + ((wc % clock_rate) * 1000 + clock_rate // 2) // clock_rate END END AS wc_ms FROM wcl),
frm AS (SELECT * FROM clk WHERE media)"""
RATES_SQL = """
stp AS (SELECT *, dts - lag(dts) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset) AS d FROM frm WHERE track_id IN (7, 1004)),
vfp AS (
  SELECT file_id, partition_index, CASE WHEN m IS NOT NULL THEN greatest((r + m // 2) // m, 1) END AS video_fps
  FROM (SELECT file_id, partition_index, CAST(quantile_disc(d, 0.5 ORDER BY d DESC) FILTER (d > 0) AS BIGINT) AS m, arg_min(clock_rate, file_offset) AS r FROM stp GROUP BY ALL))"""
SECTIONS_SQL = f"""{CLOCKED_SQL}, {RATES_SQL},
gap AS (
  SELECT *, CASE WHEN track_id <> 1000 THEN greatest(wc_ms - max(CASE WHEN track_id <> 1000 THEN wc_ms END) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS gap_ms0,
         max(CASE WHEN track_id <> 1000 THEN wc_ms END) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM frm WHERE clock_rate <> 0),
gp2 AS (SELECT *, CASE WHEN before IS NOT NULL THEN gap_ms0 END AS gap_ms FROM gap),
sec AS (SELECT *, CAST(1 + sum(CASE WHEN gap_ms > {MAX_GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset) AS INTEGER) AS section_index FROM gp2),
sco AS (SELECT s.*, video_fps, CASE WHEN video_fps > 0 THEN greatest(1000 // video_fps, 1) END AS expected FROM sec s LEFT JOIN vfp USING (file_id, partition_index)),
smy AS (
  SELECT file_id, partition_index, section_index, min(wc_ms) FILTER (track_id <> 1000) AS video_first_ms, max(wc_ms) FILTER (track_id <> 1000) AS video_last_ms,
         min(wc_ms) FILTER (track_id = 1000) AS audio_first_ms, max(wc_ms) FILTER (track_id = 1000) AS audio_last_ms,
         count(*) FILTER (track_id <> 1000) AS video_frames, count(*) FILTER (track_id = 1000) AS audio_frames,
         CAST(sum(CASE WHEN gap_ms > 2 * expected AND gap_ms <= {MAX_GAP_MS} THEN gap_ms - expected ELSE 0 END) AS BIGINT) AS discontinuity_ms, max(video_fps) AS video_fps
  FROM sco GROUP BY ALL),
sections AS (
  SELECT *, least(video_first_ms, audio_first_ms) AS start_ms, greatest(video_last_ms, audio_last_ms) AS end_ms,
         coalesce(video_last_ms - video_first_ms, 0) AS video_duration_ms, coalesce(audio_last_ms - audio_first_ms, 0) AS audio_duration_ms FROM smy)"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: pos, mac (mixed case), name (blank for some)."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    mac = F.lpad(F.hex(key % 700 * 7919), 12, "0")
    return c.select(key.alias("pos"), F.when(key % 2 == 0, F.lower(mac)).otherwise(mac).alias("mac"), F.when(key % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"))


CAMERAS_SQL = """
cam AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN lower(lpad(hex(c_custkey % 700 * 7919), 12, '0')) ELSE lpad(hex(c_custkey % 700 * 7919), 12, '0') END AS mac,
               CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name FROM customer)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths in many forms, from the keys of customers."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    mac = F.lpad(F.hex(key % 700 * 7919), 12, "0")
    middle = F.when(key % 6 == 0, "_2_rotating_").when(key % 6 == 1, "_TIMELAPSE_").otherwise("_0_rotating_")
    ms = F.when(key % 9 == 0, F.lit("notanumber")).otherwise((key * 1000003 + EPOCH_MS).cast("string"))
    end = F.when(key % 7 == 0, ".UBV").when(key % 7 == 1, ".ubv.gz").when(key % 7 == 2, ".mp4").otherwise(".ubv")
    return c.select(key, F.concat(F.lit("/in/"), (key % 3).cast("string"), F.lit("/"), F.when(key % 8 == 0, F.substring(mac, 3, 10)).otherwise(mac), middle, ms, end).alias("path"))


PATHS_SQL = f"""
pth AS (SELECT c_custkey, '/in/' || CAST(c_custkey % 3 AS VARCHAR) || '/' || CASE WHEN c_custkey % 8 = 0 THEN substr(lpad(hex(c_custkey % 700 * 7919), 12, '0'), 3) ELSE lpad(hex(c_custkey % 700 * 7919), 12, '0') END
   || CASE c_custkey % 6 WHEN 0 THEN '_2_rotating_' WHEN 1 THEN '_TIMELAPSE_' ELSE '_0_rotating_' END
   || CASE WHEN c_custkey % 9 = 0 THEN 'notanumber' ELSE CAST(c_custkey * 1000003 + {EPOCH_MS} AS VARCHAR) END
   || CASE c_custkey % 7 WHEN 0 THEN '.UBV' WHEN 1 THEN '.ubv.gz' WHEN 2 THEN '.mp4' ELSE '.ubv' END AS path FROM customer)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "signup", "warn").when(kind == "click", "Warn").otherwise("info")
    return ev.select(F.col("event_id"), level.alias("level"), F.concat(kind, F.lit(" "), F.col("props")).alias("message"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("user_id") % 20).cast("int").alias("file_index"))


LOGS_SQL = """
lg AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'Warn' ELSE 'info' END AS level, event_type || ' ' || props AS message, ts, CAST(user_id % 20 AS INTEGER) AS file_index FROM events)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_index, seq, json: progress events, kinds by event type and key."""
    ev = table(spark, sf_dir, "events")
    kind, at = F.col("event_type"), F.col("event_id")
    type_ = F.when(kind == "signup", "file_started").when(kind == "error", F.when(at % 2 == 0, "partition_error").otherwise("file_completed")).when(kind == "view", F.when(at % 4 == 0, "partitions_found").otherwise("partition_started")).when(kind == "click", "output_generated").otherwise("log")
    ev = ev.withColumn("type", type_)
    has = lambda *kinds: F.col("type").isin(*kinds)
    fields = F.struct(
        "type", F.when(has("log"), F.lit("warn")).alias("level"), F.when(has("log"), F.col("props")).alias("message"), F.when(has("output_generated", "file_completed"), F.concat(F.lit("/out/"), at.cast("string"), F.lit(".mp4"))).alias("path"),
        F.when(has("partitions_found"), at % 9).alias("count"), F.when(has("partition_started", "partition_error"), at % 5).alias("index"), F.when(has("partition_started"), at % 5 + at % 3).alias("total"),
        F.when(has("partition_error"), F.concat(F.lit("bad "), at.cast("string"))).alias("error"), F.when(has("file_completed"), F.array(F.concat(F.lit("/out/"), at.cast("string")))).alias("outputs"),
        F.when(has("file_completed"), F.when(at % 3 == 0, F.array(F.lit("e1"), F.concat(F.lit("e"), at.cast("string")))).otherwise(F.array().cast("array<string>"))).alias("errors"),
    )
    return ev.select(F.col("user_id").cast("int").alias("file_index"), at.alias("seq"), F.to_json(fields).alias("json"))


PROGRESS_SQL = """
prg0 AS (SELECT CAST(user_id AS INTEGER) AS file_index, event_id AS seq, props,
   CASE event_type WHEN 'signup' THEN 'file_started' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'partition_error' ELSE 'file_completed' END
        WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'partitions_found' ELSE 'partition_started' END WHEN 'click' THEN 'output_generated' ELSE 'log' END AS type FROM events),
prg AS (SELECT *, CASE WHEN type = 'log' THEN 'warn' END AS level, CASE WHEN type = 'log' THEN props END AS message, CASE WHEN type IN ('output_generated', 'file_completed') THEN '/out/' || seq || '.mp4' END AS path,
   CASE WHEN type = 'partitions_found' THEN seq % 9 END AS count, CASE WHEN type IN ('partition_started', 'partition_error') THEN seq % 5 END AS index, CASE WHEN type = 'partition_started' THEN seq % 5 + seq % 3 END AS total,
   CASE WHEN type = 'partition_error' THEN 'bad ' || seq END AS error, CASE WHEN type = 'file_completed' THEN CASE WHEN seq % 3 = 0 THEN 'e1; e' || seq ELSE '' END END AS errors FROM prg0)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, payload: a text as length-prefixed units, one per line; some units claim more bytes than there are."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    unit = lambda x: F.concat(F.unhex(F.lpad(F.hex((F.octet_length(x)).cast("long")), 8, "0")), F.encode(x, "utf-8"))
    units = F.aggregate(F.transform(F.split("text", "\n"), unit), F.lit(b""), lambda a, x: F.concat(a, x))
    broken = F.when(F.col("conv_id") % 10 == 0, F.unhex(F.lit("000000FF41"))).otherwise(F.lit(b""))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), "conv_id", "turn", "text", F.concat(units, broken).alias("payload"), (F.col("turn") % 3 == 2).alias("is_plain"))
