"""Registered queries of names, cameras, queues, logs and progress events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import naming
from tapeline.operators import catalog
from tapeline.plans import standin as s
from tapeline.session import table
from tapeline.streaming import status


def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = naming.file_name(F.col("path"))
    mac = naming.mac_of(name)
    return s.paths(spark, d).select(
        "path", mac.alias("mac"), naming.mac_display(mac).alias("mac_display"), naming.mac_plain(F.concat(F.lit("-:"), mac)).alias("mac_plain"), naming.recorded_ms(name).alias("recorded_ms"),
        naming.time_label(naming.recorded_ms(name)).alias("time_label"), naming.is_low_resolution(name).alias("low_resolution"), naming.is_recording(name).alias("recording"),
        naming.safe_base(F.concat(F.lit("  *"), F.col("path"), F.lit("?|  "))).alias("safe_base"),
    )


def output_names(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    start = F.when(key % 10 > 0, F.timestamp_millis(key * 86_400_123 + s.EPOCH_MS))
    base = F.when(key % 13 == 0, F.lit("given"))
    folder = F.when(key % 3 == 0, "./").when(key % 3 == 1, "SRC-FOLDER/").otherwise("/")
    return s.paths(spark, d).select("path", naming.output_name(F.col("path"), start, F.lit("mp4"), folder, base).alias("output"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    size = (key * key % 1009 * 7 + 3) * F.pow(F.lit(10), key % 8).cast("long") + 1
    state = F.element_at(F.array(*map(F.lit, ("Pending", "Processing", "Completed", "Failed", "Lost"))), (key % 5 + 1).cast("int"))
    return o.select(
        key.alias("o_orderkey"), naming.size_label(size).alias("size_label"), naming.status_label(state, key % 4).alias("status_label"), naming.code_label(key % 65536).alias("code_label"),
        naming.display_name(F.when(key % 3 == 0, F.lit(" ")).when(key % 3 == 1, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")), F.when(key % 7 == 0, F.lit("odd")).otherwise(F.lpad(F.hex(key), 12, "0"))).alias("display_name"),
    )


def _files(spark: SparkSession, d: str) -> DataFrame:
    return s.paths(spark, d).select("path", naming.mac_of(naming.file_name(F.col("path"))).alias("mac"))


def camera_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_camera_names(_files(spark, d), s.cameras(spark, d)).select("path", "mac", "camera_name")


def camera_upsert(spark: SparkSession, d: str) -> DataFrame:
    return catalog.upserted(s.cameras(spark, d).where("pos % 3 = 0"), _files(spark, d))


def camera_delete(spark: SparkSession, d: str) -> DataFrame:
    cameras = s.cameras(spark, d)
    return catalog.without(cameras, cameras.where("pos % 4 = 1").select("mac")).select("pos", "mac", "name")


def queue_intake(spark: SparkSession, d: str) -> DataFrame:
    rows = s.paths(spark, d)
    twice = rows.select("path").unionByName(rows.where("c_custkey % 4 = 0").select("path"))
    return catalog.intake(twice, rows.where("c_custkey % 11 = 0").select("path"))


def log_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.filtered_logs(s.logs(spark, d), file_index=3, level="WARN", search="  K\": 1 ")
    return rows.select("event_id", "level", "message")


def log_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.log_counts(s.logs(spark, d))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return catalog.log_lines(s.logs(spark, d)).select("event_id", "line")


def file_results(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    bad = F.col("l_linenumber") % 3 == 0
    rows = li.select(
        "l_orderkey", "l_linenumber", F.when(~bad, F.concat(F.lit("out"), F.col("l_partkey").cast("string"))).alias("output"), F.when(bad, F.concat(F.lit("err"), F.col("l_suppkey").cast("string"))).alias("error"),
        F.when(bad, F.lit(0)).otherwise(F.col("l_suppkey") % 5).cast("long").alias("size"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )
    return catalog.file_results(rows, ["l_orderkey"], "at")


def registry_json(spark: SparkSession, d: str) -> DataFrame:
    """Registries as JSON documents, one for every fifty cameras, some broken; saved and read back."""
    docs = s.cameras(spark, d).groupBy(F.call_function("div", F.col("pos"), F.lit(50).cast("long")).alias("registry")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mac", "name"))), lambda x: F.struct(x["mac"].alias("mac"), x["name"].alias("name"))).alias("cameras"))
    text = F.when(F.col("registry") % 10 == 2, F.lit("{broken")).otherwise(catalog.registry_to_json(F.col("cameras")))
    return docs.select("registry", F.inline(catalog.registry_from_json(text)))


def event_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = status.parsed(s.progress(spark, d))
    return rows.select("file_index", "seq", "type", "level", "message", "path", "count", "index", "total", "error", F.array_join("errors", "; ").alias("errors"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return status.log_rows(status.parsed(s.progress(spark, d)))


def file_status(spark: SparkSession, d: str) -> DataFrame:
    rows = status.file_status(status.parsed(s.progress(spark, d)))
    return rows.withColumn("outputs", F.array_join("outputs", "|"))


_MAC = "CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^[0-9A-Fa-f]{12}_') THEN upper(substr(regexp_extract(path, '([^/]*)$', 1), 1, 12)) END"
_MS = "TRY_CAST(CASE WHEN regexp_matches(path, '_[0-9]+\\.[^_]*$') THEN regexp_extract(path, '_([0-9]+)(\\.ubv)?(\\.gz)?$', 1, 'i') END AS BIGINT)"

QUERIES_SQL = {
    file_names: f"""WITH {s.PATHS_SQL}, m AS (SELECT path, {_MAC} AS mac, {_MS} AS ms FROM pth)
SELECT path, mac, CASE WHEN mac IS NOT NULL THEN array_to_string([substr(mac, 2 * i + 1, 2) FOR i IN range(0, 6)], ':') END AS mac_display, mac AS mac_plain, CASE WHEN ms > 1000000000000 AND ms < 10000000000000 THEN ms END AS recorded_ms,
       CASE WHEN ms > 1000000000000 AND ms < 10000000000000 THEN strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') END AS time_label,
       lower(path) LIKE '%\\_2\\_rotating\\_%' ESCAPE '\\' OR lower(path) LIKE '%\\_timelapse\\_%' ESCAPE '\\' AS low_resolution, lower(path) LIKE '%.ubv' OR lower(path) LIKE '%.ubv.gz' AS recording, replace(path, '/', '') AS safe_base FROM m""",
    output_names: f"""WITH {s.PATHS_SQL} SELECT path, CASE c_custkey % 3 WHEN 0 THEN './' WHEN 1 THEN regexp_extract(path, '^(.*/)', 1) ELSE '' END || CASE WHEN c_custkey % 13 = 0 THEN 'given' ELSE regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_[^_]*$', '') END
|| '_' || CASE WHEN c_custkey % 10 > 0 THEN strftime(make_timestamp((c_custkey * 86400123 + {s.EPOCH_MS}) * 1000), '%Y-%m-%dT%H.%M.%SZ') ELSE 'unknown-time' END || '.mp4' AS output FROM pth""",
    labels: """WITH z AS (SELECT o_orderkey AS k, (o_orderkey * o_orderkey % 1009 * 7 + 3) * CAST(pow(10, o_orderkey % 8) AS BIGINT) + 1 AS size, o_orderpriority AS p FROM orders)
SELECT k AS o_orderkey, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.0f} KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN format('{:.0f} MB', size / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', size / 1073741824.0::DOUBLE) END AS size_label,
       CASE k % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing...' WHEN 2 THEN CASE k % 4 WHEN 0 THEN 'Done' WHEN 1 THEN 'Done (1 file)' ELSE 'Done (' || k % 4 || ' files)' END WHEN 3 THEN 'Failed' ELSE 'Unknown' END AS status_label,
       format('0x{:04X}', k % 65536) AS code_label,
       CASE WHEN k % 3 = 2 THEN p WHEN k % 7 = 0 THEN 'odd' ELSE array_to_string([substr(format('{:012X}', k), 2 * i + 1, 2) FOR i IN range(0, 6)], ':') END AS display_name FROM z""",
    camera_lookup: f"""WITH {s.PATHS_SQL}, {s.CAMERAS_SQL}, n AS (SELECT upper(mac) AS k, arg_min(name, pos) AS camera_name FROM cam WHERE trim(name) <> '' GROUP BY ALL)
SELECT path, mac, camera_name FROM (SELECT path, {_MAC} AS mac FROM pth) LEFT JOIN n ON k = mac""",
    camera_upsert: f"""WITH {s.PATHS_SQL}, {s.CAMERAS_SQL}, r AS (SELECT * FROM cam WHERE pos % 3 = 0)
SELECT mac, name FROM r UNION ALL SELECT DISTINCT m, '' FROM (SELECT {_MAC} AS m FROM pth) WHERE m IS NOT NULL AND m NOT IN (SELECT upper(mac) FROM r)""",
    camera_delete: f"WITH {s.CAMERAS_SQL} SELECT pos, mac, name FROM cam WHERE mac NOT IN (SELECT mac FROM cam WHERE pos % 4 = 1)",
    queue_intake: f"""WITH {s.PATHS_SQL} SELECT DISTINCT path, lower(path) LIKE '%\\_2\\_rotating\\_%' ESCAPE '\\' OR lower(path) LIKE '%\\_timelapse\\_%' ESCAPE '\\' AS needs_confirmation FROM pth
WHERE (lower(path) LIKE '%.ubv' OR lower(path) LIKE '%.ubv.gz') AND path NOT IN (SELECT path FROM pth WHERE c_custkey % 11 = 0)""",
    log_filter: f"WITH {s.LOGS_SQL} SELECT event_id, level, message FROM lg WHERE file_index = 3 AND lower(level) = 'warn' AND contains(lower(message), 'k\": 1')",
    log_counts: f"WITH {s.LOGS_SQL} SELECT count(*) FILTER (lower(level) = 'error') AS errors, count(*) FILTER (lower(level) = 'warn') AS warnings, count(*) FILTER (lower(level) NOT IN ('error', 'warn')) AS infos FROM lg",
    log_lines: f"WITH {s.LOGS_SQL} SELECT event_id, strftime(ts, '%H:%M:%S') || ' [' || level || '] ' || message AS line FROM lg",
    file_results: """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN 'out' || l_partkey END AS output, CASE WHEN l_linenumber % 3 = 0 THEN 'err' || l_suppkey END AS error, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_suppkey % 5 END AS size FROM lineitem)
SELECT l_orderkey, CAST(count(output) AS INTEGER) AS n_outputs, coalesce(string_agg(output, '|' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS outputs, string_agg(error, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS error, CAST(nullif(sum(size), 0) AS BIGINT) AS output_size FROM r GROUP BY l_orderkey""",
    registry_json: f"WITH {s.CAMERAS_SQL} SELECT pos // 50 AS registry, mac, name FROM cam WHERE pos // 50 % 10 <> 2 AND trim(name) <> ''",
    event_codec: f"WITH {s.PROGRESS_SQL} SELECT file_index, seq, type, level, message, path, count, index, total, error, errors FROM prg",
    event_log: f"""WITH {s.PROGRESS_SQL} SELECT file_index, seq, CASE type WHEN 'log' THEN level WHEN 'partition_error' THEN 'error' ELSE 'info' END AS level,
CASE type WHEN 'log' THEN message WHEN 'partitions_found' THEN 'Found ' || count || ' partition(s)' WHEN 'partition_started' THEN 'Processing partition ' || index + 1 || '/' || total ELSE 'Partition #' || index || ': ' || error END AS message
FROM prg WHERE type IN ('log', 'partitions_found', 'partition_started', 'partition_error')""",
    file_status: f"""WITH {s.PROGRESS_SQL}, e AS (SELECT *, CASE WHEN type = 'file_started' THEN 'Processing' WHEN type = 'file_completed' THEN CASE WHEN errors <> '' THEN 'Failed' ELSE 'Completed' END END AS st,
  CASE WHEN type = 'partitions_found' THEN 0.0::DOUBLE WHEN type = 'partition_started' AND total > 0 THEN index * 100.0::DOUBLE / total WHEN type = 'file_completed' THEN 100.0::DOUBLE END AS pr FROM prg)
SELECT file_index, coalesce(arg_max(st, seq) FILTER (st IS NOT NULL), 'Pending') AS status, arg_max(count, seq) FILTER (count IS NOT NULL) AS partition_count, arg_max(pr, seq) FILTER (pr IS NOT NULL) AS progress,
       coalesce(string_agg(path, '|' ORDER BY seq) FILTER (type = 'output_generated'), '') AS outputs, arg_max(errors, seq) FILTER (errors <> '') AS error FROM e GROUP BY file_index""",
}
