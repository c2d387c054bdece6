"""The scalar functions for SQL users, as temporary functions whose bodies Catalyst inlines; they give what the Column forms give."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SCALED = "({x} DIV {base}) * {rate} + (({x} % {base}) * {rate} + {base} DIV 2) DIV {base}"
_FRAME = "least((pmod(ms, 1000L) * {fps} + 500) DIV 1000 + 1, CAST({fps} AS BIGINT))"
_SAFE = r"""r'[/\\:*?"<>|]'"""
_BLANKS = r"r'^\p{IsWhite_Space}+|\p{IsWhite_Space}+$'"
_STEM = r"regexp_replace(regexp_replace(name, r'(?i)\.gz$', ''), r'(?i)\.ubv$', '')"
_PATH_STEM = r"regexp_replace(substring_index(path, '/', -1), r'(?<=.)\.[^.]*$', '')"
_FOLDER = r"regexp_replace(folder, r'[/\\]+$', '')"
_INTO = rf"CASE WHEN {_FOLDER} = 'SRC-FOLDER' THEN CASE WHEN path RLIKE '^/[^/]*$' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END ELSE {_FOLDER} END"

#: name -> (parameters, type, body)
FUNCTIONS = {
    "wall_clock": (
        "dts BIGINT, rate BIGINT, sc_dts BIGINT, sc_rate BIGINT, wc_ms BIGINT",
        "BIGINT",
        f"CASE WHEN sc_rate <> 0 THEN greatest(dts + ({_SCALED.format(x='wc_ms', base='1000L', rate='rate')}) - ({_SCALED.format(x='sc_dts', base='nullif(sc_rate, 0L)', rate='rate')}), 0L) END",
    ),
    "ticks_to_ms": ("ticks BIGINT, rate BIGINT", "BIGINT", _SCALED.format(x="ticks", base="nullif(rate, 0L)", rate="1000L")),
    "ms_to_time": ("ms BIGINT", "TIMESTAMP", "timestamp_millis(ms)"),
    "timecode": (
        "ms BIGINT, fps DOUBLE",
        "STRING",
        f"date_format(timestamp_millis(ms), 'HH:mm:ss') || format_string(':%02d', {_FRAME.format(fps='greatest(CAST(floor(fps + 0.5) AS BIGINT), 1L)')})",
    ),
    "timecode_with_base": (
        "ms BIGINT, fps BIGINT",
        "STRING",
        f"CASE WHEN ms IS NULL THEN '-' WHEN fps > 0 THEN date_format(timestamp_millis(ms), 'yyyy-MM-dd HH:mm:ss') || format_string(':%02d@%d', {_FRAME.format(fps='fps')}, fps) ELSE date_format(timestamp_millis(ms), 'yyyy-MM-dd HH:mm:ss') END",
    ),
    "duration_label": ("ms BIGINT", "STRING", "format_string('%02d:%02d:%02d.%03d', ms DIV 3600000, ms % 3600000 DIV 60000, ms % 60000 DIV 1000, ms % 1000)"),
    "reduced_timescale": (
        "max_dts BIGINT, rate BIGINT",
        "BIGINT",
        "CASE WHEN rate <> 0 AND max_dts > 2147483647 THEN least(greatest((2147483647L * rate DIV nullif(max_dts, 0L)) * 95 DIV 100, 1L), rate) END",
    ),
    "mac_of": ("name STRING", "STRING", "nullif(upper(regexp_extract(name, '^([0-9A-Fa-f]{12})_', 1)), '')"),
    "recorded_ms": (
        "name STRING",
        "BIGINT",
        f"CASE WHEN contains({_STEM}, '_') AND substring_index({_STEM}, '_', -1) RLIKE r'^\\+?0*[0-9]{{1,18}}$' AND try_cast(substring_index({_STEM}, '_', -1) AS BIGINT) BETWEEN 1000000000001 AND 9999999999999 THEN try_cast(substring_index({_STEM}, '_', -1) AS BIGINT) END",
    ),
    "mac_display": ("mac STRING", "STRING", "CASE WHEN mac RLIKE '^[0-9A-Fa-f]{12}$' THEN regexp_replace(upper(mac), '(..)(?!$)', '$1:') END"),
    "mac_plain": ("mac STRING", "STRING", "upper(translate(mac, ':-', ''))"),
    "safe_base": ("name STRING", "STRING", f"nullif(regexp_replace(regexp_replace(name, {_SAFE}, ''), {_BLANKS}, ''), '')"),
    "is_low_resolution": ("name STRING", "BOOLEAN", "name RLIKE '(?i)_2_rotating_|_timelapse_'"),
    "output_name": (
        "path STRING, start TIMESTAMP, extension STRING, folder STRING, base STRING",
        "STRING",
        f"""CASE WHEN {_INTO} = '' THEN '' WHEN {_INTO} LIKE '%/' THEN {_INTO} ELSE {_INTO} || '/' END || coalesce(base, regexp_replace({_PATH_STEM}, '_[^_]*$', '')) || '_'
            || coalesce(date_format(start, "yyyy-MM-dd'T'HH.mm.ss'Z'"), 'unknown-time') || '.' || extension""",
    ),
    "size_label": (
        "size BIGINT",
        "STRING",
        "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format_string('%.0f KB', size / 1024D) WHEN size < 1073741824 THEN format_string('%.0f MB', size / 1048576D) ELSE format_string('%.1f GB', size / 1073741824D) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
