"""Registered queries of the timeline and of timestamp repair, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import clock, tracks
from tapeline.operators import repair, timeline, units
from tapeline.plans import standin as s

KEY = ["file_id", "partition_index"]
BY_TRACK = [*KEY, "track_id"]


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.section_summary(s.frames(spark, d), s.MAX_GAP_MS)


def partition_assignment(spark: SparkSession, d: str) -> DataFrame:
    return s.partitions(spark, d).select("file_id", "file_offset", "track_id", "partition_index")


def asof_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    return s.frames(spark, d).select("file_id", "file_offset", "partition_index", "track_id", "dts", "clock_rate", "wc", "wc_ms", "has_sync")


def _with_dead_syncs(spark: SparkSession, d: str) -> DataFrame:
    return s.partitions(spark, d).withColumn("sc_rate", F.when(F.col("file_offset") % 5 == 0, F.lit(0).cast("long") * F.col("sc_rate")).otherwise(F.col("sc_rate")))


def zero_rate_syncs(spark: SparkSession, d: str) -> DataFrame:
    """Wall clocks where a fifth of the clock syncs have no rate."""
    rows = timeline.media_rows(timeline.with_wall_clock(_with_dead_syncs(spark, d)))
    return rows.select("file_id", "file_offset", "wc", "wc_ms", "has_sync", "bad_sync")


def sync_errors(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sync_errors(_with_dead_syncs(spark, d))


def wall_clock_steps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.wall_clock_steps(s.frames(spark, d)).select("file_id", "file_offset", "delta_ms")


def dts_steps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.dts_steps(s.frames(spark, d)).select("file_id", "file_offset", "track_id", "step")


def track_rates(spark: SparkSession, d: str) -> DataFrame:
    return timeline.track_rates(s.frames(spark, d))


def video_rates(spark: SparkSession, d: str) -> DataFrame:
    return timeline.video_rates(s.frames(spark, d))


def unordered_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of values that run backward as well, whose steps are as small as frames'."""
    rows = s.frames(spark, d).withColumn("dts", F.col("ticks"))
    return timeline.track_rates(rows)


def sections(spark: SparkSession, d: str) -> DataFrame:
    return timeline.with_sections(s.frames(spark, d), s.MAX_GAP_MS).select("file_id", "file_offset", "partition_index", "section_index", "gap_ms")


def video_codecs(spark: SparkSession, d: str) -> DataFrame:
    return timeline.video_codecs(s.frames(spark, d))


def continuity(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).withColumn("total_size", F.when(F.col("file_offset") % 3 == 0, F.col("data_size")).otherwise(F.lit(150).cast("long")))
    return timeline.continuity(rows).select("file_id", "file_offset", "expected_offset", "previous_track", "previous_size", "records_before", "records_in_partition", "broken")


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = section_summary(spark, d).withColumn("fps", F.call_function("div", F.col("start_ms"), F.lit(7).cast("long")) % 61)
    return rows.select(
        *KEY, "section_index", F.date_format(clock.ms_to_timestamp(F.col("start_ms")), "yyyy-MM-dd HH:mm:ss.SSS").alias("start_time"), clock.timecode(F.col("start_ms"), F.greatest("fps", F.lit(1))).alias("timecode"),
        clock.timecode_with_base(F.col("start_ms"), F.col("fps")).alias("start_code"), clock.timecode_with_base(F.col("video_first_ms"), F.col("fps")).alias("video_code"), clock.duration(F.col("video_duration_ms")).alias("video_length"),
        clock.least_known(F.col("video_first_ms"), F.col("audio_first_ms")).alias("first_ms"), clock.greatest_known(F.col("video_last_ms"), F.col("audio_last_ms")).alias("last_ms"),
    )


def dts_rescale(spark: SparkSession, d: str) -> DataFrame:
    rows = s.frames(spark, d)
    first = F.first("dts").over(Window.partitionBy(*BY_TRACK).orderBy("file_offset"))
    return rows.select("file_id", "file_offset", clock.ticks_to_us(F.col("dts"), F.col("clock_rate")).alias("us"), clock.rebased(F.col("dts"), first, F.col("clock_rate")).alias("ticks90"))


def reduced_timescale(spark: SparkSession, d: str) -> DataFrame:
    rows = s.frames(spark, d).groupBy(*BY_TRACK).agg(F.max("dts").alias("max_dts"), F.max("clock_rate").alias("rate"))
    return rows.withColumn("timescale", clock.reduced_timescale(F.col("max_dts"), F.col("rate")))


def monotonic_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.monotonic(s.records(spark, d), ["file_id"], "ticks", "file_offset").select("file_id", "file_offset", "i", "rebased", "repaired")


def repair_corrections(spark: SparkSession, d: str) -> DataFrame:
    return repair.corrections(repair.monotonic(s.records(spark, d), ["file_id"], "ticks", "file_offset"), ["file_id"])


def frame_durations(spark: SparkSession, d: str) -> DataFrame:
    rows = repair.monotonic(s.frames(spark, d), BY_TRACK, "dts", "file_offset")
    return repair.with_durations(rows, BY_TRACK).select("file_id", "file_offset", "track_id", "repaired", "duration")


def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return repair.track_summary(s.frames(spark, d))


def track_counts(spark: SparkSession, d: str) -> DataFrame:
    return repair.track_counts(s.frames(spark, d))


def main_video_track(spark: SparkSession, d: str) -> DataFrame:
    return repair.main_video_track(s.frames(spark, d))


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return repair.start_times(repair.track_facts(s.frames(spark, d)))


def start_times(spark: SparkSession, d: str) -> DataFrame:
    return _starts(spark, d).drop("video_track")


def first_partition_report(spark: SparkSession, d: str) -> DataFrame:
    return repair.first_partition_report(repair.track_facts(s.clocked(spark, d)))


def constant_plan(spark: SparkSession, d: str) -> DataFrame:
    frames = tracks.with_tracks(s.frames(spark, d)).join(timeline.track_rates(s.frames(spark, d)).select(*BY_TRACK, "export_fps"), BY_TRACK)
    return repair.constant_plan(frames, BY_TRACK, "file_offset").select("file_id", "file_offset", "pts", "duration", "effective_fps")


def variable_plan(spark: SparkSession, d: str) -> DataFrame:
    """Packets of the first video track, and of audio whose every third frame stands on another track."""
    frames = s.frames(spark, d)
    more = frames.withColumn("track_id", F.when((F.col("track_id") == 1000) & (F.col("file_offset") % 3 == 0), 1002).otherwise(F.col("track_id")))
    return repair.variable_plan(more, KEY, "file_offset").select("file_id", "file_offset", "track_id", "repaired", "duration", "mixed_audio", "key")


def longest_dts(spark: SparkSession, d: str) -> DataFrame:
    frames = repair.monotonic(s.frames(spark, d), BY_TRACK, "dts", "file_offset")
    rows = tracks.with_tracks(repair.track_facts(frames, last_dts=F.max("repaired")))
    rows = rows.select(*BY_TRACK, "frames", "last_dts", "clock_rate", "type_char", F.col("nominal_rate").alias("fps"), F.coalesce("samples_per_frame", F.lit(1024)).cast("long").alias("samples"))
    return repair.longest_dts(rows).select(*BY_TRACK, "constant_max", "variable_max", "overflows", "timescale", "constant_timescale")


def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    return repair.selected_rows(s.frames(spark, d), 7).select("file_id", "file_offset", "track_id")


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    rows = s.frames(spark, d)
    return repair.interleaved(rows, ["file_id"], "ticks", tracks.is_video(F.col("track_id")), "file_offset").select("file_id", "file_offset", "place")


def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each file's track, the writer's scope."""
    return repair.sequence_numbers(s.records(spark, d), ["file_id", "track_id"], "file_offset").select("file_id", "file_offset", "track_id", "sequence16")


def layout_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = s.records(spark, d).withColumn("header_bytes", (F.lit(12) + F.col("file_offset") % 3 * 4).cast("long"))
    return repair.layout(rows, ["file_id"], "header_bytes", "data_size", "file_offset").select("file_id", "file_offset", "written_size", "written_offset")


def export_plan(spark: SparkSession, d: str) -> DataFrame:
    named = s.paths(spark, d).select((F.col("c_custkey") - 1).cast("string").alias("file_id"), "path")
    starts = tracks.with_tracks(_starts(spark, d).withColumn("track_id", F.coalesce("video_track", F.lit(0))))
    rows = starts.select(*KEY, "start_ms", "extension").join(named, "file_id")
    return repair.export_plan(rows, "SRC-FOLDER", mp4=False).select("file_id", "partition_index", "output", "collides")


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return units.first_rows(s.frames(spark, d), ["file_id", "track_id"], "file_offset").select("file_id", "track_id", "file_offset", F.col("place").cast("long").alias("place"))


def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    rows = s.frames(spark, d)
    return rows.groupBy("file_id", "track_id").agg(F.min_by(F.struct("file_offset", "dts"), "file_offset").alias("x")).select("file_id", "track_id", "x.file_offset", "x.dts")


def file_order(spark: SparkSession, d: str) -> DataFrame:
    return s.partitions(spark, d).select("file_id", "file_offset", "partition_index").orderBy("file_id", "file_offset")


_TRACK_STEPS = "tst AS (SELECT *, greatest({v} - lag({v}) OVER (PARTITION BY file_id, partition_index, track_id ORDER BY file_offset), 0) AS st0, lag({v}) OVER (PARTITION BY file_id, partition_index, track_id ORDER BY file_offset) AS pv FROM frm), ts2 AS (SELECT *, CASE WHEN pv IS NOT NULL THEN st0 END AS step FROM tst)"
_TRACK_RATES = _TRACK_STEPS + """,
trm AS (SELECT file_id, partition_index, track_id, CAST(quantile_disc(step, 0.5 ORDER BY step DESC) FILTER (step > 0) AS BIGINT) AS m, arg_min(clock_rate, file_offset) AS r, count(*) AS frames FROM ts2 GROUP BY ALL),
trn AS (SELECT *, CASE WHEN r > 0 AND m IS NOT NULL THEN greatest((r + m // 2) // m, 1) END AS nominal_fps FROM trm),
tra AS (SELECT file_id, partition_index, track_id, nominal_fps, frames, CASE WHEN nominal_fps IS NULL THEN 1 WHEN nominal_fps > 120 THEN 30 ELSE nominal_fps END AS export_fps, nominal_fps IS NULL OR nominal_fps > 120 AS clamped FROM trn)"""
_SUMMARY = f"""{_TRACK_RATES.format(v="dts")},
tfi AS (SELECT file_id, partition_index, track_id, arg_min(clock_rate, file_offset) AS clock_rate, arg_min(wc_ms, file_offset) AS first_ms, min(file_offset) AS first_offset FROM frm GROUP BY ALL),
tsu AS (SELECT file_id, partition_index, track_id, frames, clock_rate, CASE WHEN clock_rate > 0 THEN first_ms END AS start_ms, CASE WHEN track_id = 1000 THEN clock_rate ELSE export_fps END AS nominal_rate, first_offset
        FROM tra JOIN tfi USING (file_id, partition_index, track_id)),
sta AS (SELECT file_id, partition_index, CASE WHEN bool_or(track_id <> 1000) THEN (list(start_ms ORDER BY first_offset) FILTER (track_id <> 1000))[1] ELSE (list(start_ms ORDER BY first_offset) FILTER (track_id = 1000))[1] END AS start_ms FROM tsu GROUP BY ALL)"""


def _repair(keys: str, value: str, source: str) -> str:
    """The repair as a recursion from row to row, apart from the running maximum that Spark uses."""
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY file_offset) AS i, greatest({value} - first_value({value}) OVER (PARTITION BY {keys} ORDER BY file_offset), 0) AS rebased FROM {source}),
rpr AS (SELECT {keys}, i, rebased, rebased AS repaired, file_offset FROM num WHERE i = 1
        UNION ALL SELECT {", ".join("n." + k.strip() for k in keys.split(","))}, n.i, n.rebased, greatest(n.rebased, p.repaired + 1), n.file_offset FROM rpr p JOIN num n ON {" AND ".join(f"n.{k.strip()} = p.{k.strip()}" for k in keys.split(","))} AND n.i = p.i + 1)"""


_KEYS3 = "file_id, partition_index, track_id"
_DURATION = "greatest(coalesce(lead(repaired) OVER w - repaired, repaired - lag(repaired) OVER w, 1), 1)"

QUERIES_SQL = {
    section_summary: f"WITH {s.SECTIONS_SQL} SELECT * FROM sections",
    partition_assignment: f"WITH {s.PARTITIONS_SQL} SELECT file_id, file_offset, track_id, partition_index FROM part",
    asof_wall_clock: f"WITH {s.CLOCKED_SQL} SELECT file_id, file_offset, partition_index, track_id, dts, clock_rate, wc, wc_ms, has_sync FROM frm",
    zero_rate_syncs: f"""WITH {s.PARTITIONS_SQL}, p2 AS (SELECT *, CASE WHEN track_id = 55934 THEN CASE WHEN file_offset % 5 = 0 THEN 0 ELSE 1000 END END AS sr FROM part),
z AS (SELECT *, last_value(sc_dts IGNORE NULLS) OVER w AS s_dts, last_value(sync_ms IGNORE NULLS) OVER w AS s_ms, last_value(sr IGNORE NULLS) OVER w AS s_rate FROM p2 WINDOW w AS (PARTITION BY file_id, partition_index ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN s_rate = 0 THEN NULL WHEN s_rate IS NULL THEN 0 ELSE greatest(dts + {s._SCALED.format(x="s_ms", r="clock_rate", b="1000")} - {s._SCALED.format(x="s_dts", r="clock_rate", b="1000")}, 0) END AS wc FROM z WHERE track_id IN (7, 1000, 1004))
SELECT file_id, file_offset, wc, CASE WHEN clock_rate = 0 AND wc IS NOT NULL THEN 0 ELSE (wc // clock_rate) * 1000 + ((wc % clock_rate) * 1000 + clock_rate // 2) // clock_rate END AS wc_ms, coalesce(s_rate, 0) <> 0 AS has_sync, coalesce(s_rate = 0, false) AS bad_sync FROM y""",
    sync_errors: f"""WITH {s.PARTITIONS_SQL} SELECT file_id, 'zero_sync_rate' AS code, file_offset AS "offset" FROM part WHERE track_id = 55934 AND file_offset % 5 = 0""",
    wall_clock_steps: f"WITH {s.CLOCKED_SQL} SELECT file_id, file_offset, coalesce(wc_ms - lag(wc_ms) OVER (PARTITION BY file_id, partition_index ORDER BY file_offset), 0) AS delta_ms FROM frm",
    dts_steps: f"WITH {s.CLOCKED_SQL}, {_TRACK_STEPS.format(v='dts')} SELECT file_id, file_offset, track_id, step FROM ts2",
    track_rates: f"WITH {s.CLOCKED_SQL}, {_TRACK_RATES.format(v='dts')} SELECT * FROM tra",
    unordered_rates: f"WITH {s.CLOCKED_SQL}, {_TRACK_RATES.format(v='ticks')} SELECT * FROM tra",
    video_rates: f"WITH {s.CLOCKED_SQL}, {s.RATES_SQL} SELECT * FROM vfp",
    sections: f"WITH {s.SECTIONS_SQL} SELECT file_id, file_offset, partition_index, section_index, gap_ms FROM sec",
    video_codecs: f"WITH {s.CLOCKED_SQL} SELECT file_id, partition_index, arg_min(CASE track_id WHEN 7 THEN 'H264' ELSE 'AV1' END, file_offset) AS video_codec FROM frm WHERE track_id <> 1000 GROUP BY ALL",
    continuity: f"""WITH {s.RECORDS_SQL}, tot AS (SELECT *, CASE WHEN file_offset % 3 = 0 THEN data_size ELSE 150 END AS total_size, sum(CASE WHEN track_id = 9 THEN 1 ELSE 0 END) OVER w AS p FROM rec WINDOW w AS (PARTITION BY file_id ORDER BY file_offset))
SELECT file_id, file_offset, lag(file_offset + total_size) OVER w AS expected_offset, lag(track_id) OVER w AS previous_track, lag(data_size) OVER w AS previous_size, row_number() OVER w - 1 AS records_before,
       row_number() OVER (PARTITION BY file_id, p ORDER BY file_offset) - 1 AS records_in_partition, lag(file_offset + total_size) OVER w <> file_offset AS broken FROM tot WINDOW w AS (PARTITION BY file_id ORDER BY file_offset)""",
    section_texts: f"""WITH {s.SECTIONS_SQL}, t AS (SELECT *, start_ms // 7 % 61 AS fps, make_timestamp(start_ms * 1000) AS ts, make_timestamp(video_first_ms * 1000) AS vts FROM sections)
SELECT file_id, partition_index, section_index, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS start_time,
       strftime(ts, '%H:%M:%S') || ':' || lpad(CAST(least((start_ms % 1000 * greatest(fps, 1) + 500) // 1000 + 1, greatest(fps, 1)) AS VARCHAR), 2, '0') AS timecode,
       CASE WHEN start_ms IS NULL THEN '-' WHEN fps > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ':' || lpad(CAST(least((start_ms % 1000 * fps + 500) // 1000 + 1, fps) AS VARCHAR), 2, '0') || '@' || fps ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start_code,
       CASE WHEN video_first_ms IS NULL THEN '-' WHEN fps > 0 THEN strftime(vts, '%Y-%m-%d %H:%M:%S') || ':' || lpad(CAST(least((video_first_ms % 1000 * fps + 500) // 1000 + 1, fps) AS VARCHAR), 2, '0') || '@' || fps ELSE strftime(vts, '%Y-%m-%d %H:%M:%S') END AS video_code,
       format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', video_duration_ms // 3600000, video_duration_ms % 3600000 // 60000, video_duration_ms % 60000 // 1000, video_duration_ms % 1000) AS video_length,
       least(video_first_ms, audio_first_ms) AS first_ms, greatest(video_last_ms, audio_last_ms) AS last_ms FROM t""",
    dts_rescale: f"""WITH {s.CLOCKED_SQL} SELECT file_id, file_offset, CASE WHEN clock_rate = 0 THEN 9223372036854775807 ELSE dts // clock_rate * 1000000 + dts % clock_rate * 1000000 // clock_rate END AS us,
CASE WHEN clock_rate > 0 THEN greatest(dts - first_value(dts) OVER w, 0) // clock_rate * 90000 + greatest(dts - first_value(dts) OVER w, 0) % clock_rate * 90000 // clock_rate END AS ticks90
FROM frm WINDOW w AS (PARTITION BY file_id, partition_index, track_id ORDER BY file_offset)""",
    reduced_timescale: f"""WITH {s.CLOCKED_SQL}, g AS (SELECT file_id, partition_index, track_id, max(dts) AS max_dts, max(clock_rate) AS rate FROM frm GROUP BY ALL)
SELECT *, CASE WHEN rate <> 0 AND max_dts > 2147483647 THEN least(greatest(2147483647 * rate // max_dts * 95 // 100, 1), rate) END AS timescale FROM g""",
    monotonic_repair: f"WITH RECURSIVE {s.RECORDS_SQL}, {_repair('file_id', 'ticks', 'rec')} SELECT file_id, file_offset, i, rebased, repaired FROM rpr",
    repair_corrections: f"WITH RECURSIVE {s.RECORDS_SQL}, {_repair('file_id', 'ticks', 'rec')} SELECT file_id, count(*) FILTER (repaired <> rebased) AS corrections, count(*) AS frames, max(repaired) AS last_dts FROM rpr GROUP BY file_id",
    frame_durations: f"WITH RECURSIVE {s.CLOCKED_SQL}, {_repair(_KEYS3, 'dts', 'frm')} SELECT file_id, file_offset, track_id, repaired, {_DURATION} AS duration FROM rpr WINDOW w AS (PARTITION BY {_KEYS3} ORDER BY i)",
    track_summary: f"WITH {s.CLOCKED_SQL}, {_SUMMARY} SELECT file_id, partition_index, track_id, frames, clock_rate, start_ms, nominal_rate FROM tsu",
    track_counts: f"WITH {s.CLOCKED_SQL} SELECT file_id, partition_index, count(DISTINCT track_id) FILTER (track_id <> 1000) AS video_tracks, count(DISTINCT track_id) FILTER (track_id = 1000) AS audio_tracks, arg_min(track_id, file_offset) FILTER (track_id = 1000) AS first_audio_track FROM frm GROUP BY ALL",
    main_video_track: f"WITH {s.CLOCKED_SQL} SELECT file_id, coalesce(arg_min(track_id, file_offset) FILTER (track_id <> 1000), 0) AS video_track FROM frm GROUP BY ALL",
    start_times: f"WITH {s.CLOCKED_SQL}, {_SUMMARY} SELECT * FROM sta",
    first_partition_report: f"""WITH {s.CLOCKED_SQL}, {_SUMMARY}, n AS (SELECT file_id, count(DISTINCT partition_index) AS partitions FROM part GROUP BY file_id),
v AS (SELECT file_id, arg_min(track_id, file_offset) FILTER (track_id <> 1000) AS chosen FROM frm GROUP BY file_id),
z AS (SELECT file_id, count(*) AS tracks, CAST(sum(frames) FILTER (track_id = 1000 OR track_id = chosen) AS BIGINT) AS frames, max(CASE track_id WHEN 7 THEN 'h264' ELSE 'av1' END) FILTER (track_id = chosen) AS video_codec,
      max(nominal_rate) FILTER (track_id = chosen) AS fps, CAST(sum(frames) FILTER (track_id = chosen) AS BIGINT) AS video_frames, max('aac') FILTER (track_id = 1000) AS audio_codec, max(clock_rate) FILTER (track_id = 1000) AS hz,
      CAST(sum(frames) FILTER (track_id = 1000) AS BIGINT) AS audio_frames, CASE WHEN bool_or(track_id = chosen) THEN max(start_ms) FILTER (track_id = chosen) ELSE max(start_ms) FILTER (track_id = 1000) END AS start_ms
      FROM tsu JOIN v USING (file_id) WHERE partition_index = 0 GROUP BY file_id)
SELECT n.file_id, partitions, tracks, frames, video_codec, fps, video_frames, audio_codec, hz, audio_frames, start_ms FROM n LEFT JOIN z USING (file_id)""",
    constant_plan: f"""WITH {s.CLOCKED_SQL}, {_TRACK_RATES.format(v='dts')} SELECT file_id, file_offset, (row_number() OVER (PARTITION BY {_KEYS3} ORDER BY file_offset) - 1) * CASE WHEN track_id = 1000 THEN 1024 ELSE 1 END AS pts,
CAST(CASE WHEN track_id = 1000 THEN 1024 ELSE 1 END AS BIGINT) AS duration, export_fps AS effective_fps FROM frm JOIN (SELECT {_KEYS3}, export_fps FROM tra) USING ({_KEYS3})""",
    variable_plan: f"""WITH RECURSIVE {s.CLOCKED_SQL}, aud AS (SELECT file_id, partition_index, file_offset, dts, CASE WHEN file_offset % 3 = 0 THEN 1002 ELSE 1000 END AS track_id FROM frm WHERE track_id = 1000),
fst AS (SELECT file_id, partition_index, arg_min(track_id, file_offset) AS f FROM aud GROUP BY ALL), src AS (SELECT a.* FROM aud a JOIN fst USING (file_id, partition_index) WHERE track_id = f),
{_repair('file_id, partition_index', 'dts', 'src')},
tim AS (SELECT file_id, partition_index, i, repaired, {_DURATION} AS duration FROM rpr WINDOW w AS (PARTITION BY file_id, partition_index ORDER BY i)),
al AS (SELECT *, row_number() OVER (PARTITION BY file_id, partition_index ORDER BY file_offset) AS i FROM aud),
vid AS (SELECT * FROM frm JOIN (SELECT file_id, partition_index, arg_min(track_id, file_offset) AS chosen FROM frm WHERE track_id <> 1000 GROUP BY ALL) USING (file_id, partition_index) WHERE track_id = chosen),
vno AS (SELECT *, row_number() OVER w AS i, greatest(dts - first_value(dts) OVER w, 0) AS b FROM vid WINDOW w AS (PARTITION BY file_id, partition_index ORDER BY file_offset)),
vrp AS (SELECT file_id, partition_index, i, b AS repaired FROM vno WHERE i = 1 UNION ALL SELECT n.file_id, n.partition_index, n.i, greatest(n.b, p.repaired + 1) FROM vrp p JOIN vno n ON n.file_id = p.file_id AND n.partition_index = p.partition_index AND n.i = p.i + 1)
SELECT file_id, file_offset, track_id, repaired, duration, track_id <> f AS mixed_audio, false AS key FROM al JOIN tim USING (file_id, partition_index, i) JOIN fst USING (file_id, partition_index)
UNION ALL SELECT file_id, file_offset, track_id, repaired, {_DURATION} AS duration, false, keyframe FROM vrp JOIN vno USING (file_id, partition_index, i) WINDOW w AS (PARTITION BY file_id, partition_index ORDER BY i)""",
    longest_dts: f"""WITH RECURSIVE {s.CLOCKED_SQL}, {_SUMMARY}, {_repair(_KEYS3, 'dts', 'frm')}, l AS (SELECT {_KEYS3}, max(repaired) AS variable_max FROM rpr GROUP BY ALL),
j AS (SELECT *, CASE WHEN track_id = 1000 THEN (frames - 1) * 1024 ELSE (frames - 1) * clock_rate // nominal_rate END AS constant_max FROM tsu JOIN l USING ({_KEYS3}))
SELECT {_KEYS3}, constant_max, variable_max, greatest(constant_max, variable_max) > 2147483647 AS overflows, CASE WHEN clock_rate <> 0 AND variable_max > 2147483647 THEN least(greatest(2147483647 * clock_rate // variable_max * 95 // 100, 1), clock_rate) END AS timescale,
CASE WHEN clock_rate <> 0 AND constant_max > 2147483647 THEN least(greatest(2147483647 * clock_rate // constant_max * 95 // 100, 1), clock_rate) END AS constant_timescale FROM j""",
    selected_rows: f"WITH {s.CLOCKED_SQL} SELECT file_id, file_offset, track_id FROM frm WHERE track_id IN (7, 1000)",
    interleaved: f"""WITH {s.CLOCKED_SQL}, h AS (SELECT file_id, file_offset, track_id = 1000 AS a, max(ticks) OVER (PARTITION BY file_id, track_id = 1000 ORDER BY file_offset) AS hi FROM frm)
SELECT file_id, file_offset, row_number() OVER (PARTITION BY file_id ORDER BY hi, a, file_offset) AS place FROM h""",
    sequence_numbers: f"WITH {s.RECORDS_SQL} SELECT file_id, file_offset, track_id, CAST((row_number() OVER (PARTITION BY file_id, track_id ORDER BY file_offset) - 1) % 65536 AS INTEGER) AS sequence16 FROM rec",
    layout_plan: f"""WITH {s.RECORDS_SQL}, z AS (SELECT *, (12 + file_offset % 3 * 4 + 4 + data_size) AS b FROM rec), y AS (SELECT *, b + (4 - b % 4) % 4 + 4 AS written_size FROM z)
SELECT file_id, file_offset, written_size, CAST(coalesce(sum(written_size) OVER (PARTITION BY file_id ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS written_offset FROM y""",
    export_plan: f"""WITH {s.CLOCKED_SQL}, {_SUMMARY}, {s.PATHS_SQL}, v AS (SELECT file_id, coalesce(CASE arg_min(track_id, file_offset) FILTER (track_id <> 1000) WHEN 7 THEN 'h264' WHEN 1004 THEN 'av1' END, 'h264') AS ext FROM frm GROUP BY ALL),
o AS (SELECT file_id, partition_index, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_[^_]*$', '') || '_'
      || coalesce(strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H.%M.%SZ'), 'unknown-time') || '.' || ext AS output FROM sta JOIN v USING (file_id) JOIN (SELECT CAST(c_custkey - 1 AS VARCHAR) AS file_id, path FROM pth) USING (file_id))
SELECT *, count(*) OVER (PARTITION BY output) > 1 AS collides FROM o""",
    first_rows: f"WITH {s.CLOCKED_SQL} SELECT * FROM (SELECT file_id, track_id, file_offset, row_number() OVER (PARTITION BY file_id, track_id ORDER BY file_offset) AS place FROM frm) WHERE place <= 10",
    first_of_group: f"WITH {s.CLOCKED_SQL} SELECT file_id, track_id, min(file_offset) AS file_offset, arg_min(dts, file_offset) AS dts FROM frm GROUP BY ALL",
    file_order: f"WITH {s.PARTITIONS_SQL} SELECT file_id, file_offset, partition_index FROM part",
}
