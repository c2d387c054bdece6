"""Registered queries of logs without a bound: one log holds a third of all records, and blocks hold some hundreds of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import blocks, timeline
from tapeline.plans import standin as s

KEY = ["file_id", "partition_index"]
BLOCK_ROWS = 300


def _records(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("file_id").cast("long")
    rows = s.records(spark, d).withColumn("file_id", F.when(user % 3 == 0, "long").otherwise(F.col("file_id")))
    return blocks.blocked(rows, BLOCK_ROWS)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return timeline.media_rows(blocks.with_wall_clock(blocks.with_partitions(_records(spark, d))))


def blocked_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("file_id", "file_offset", "partition_index", "wc", "wc_ms", "has_sync")


def blocked_sections(spark: SparkSession, d: str) -> DataFrame:
    return blocks.section_summary(_frames(spark, d), s.MAX_GAP_MS)


def blocked_repair(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps of each log made increasing."""
    return blocks.monotonic(_records(spark, d), ["file_id"], "ticks", "file_offset").select("file_id", "file_offset", "i", "rebased", "repaired")


def exact_medians(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of each track's ticks over all logs, and of each log's."""
    rows = s.records(spark, d).withColumn("file_id", F.when(F.col("file_id").cast("long") % 3 == 0, "long").otherwise(F.col("file_id")))
    both = rows.select("file_id", "ticks").unionByName(rows.select(F.concat(F.lit("track "), F.col("track_id").cast("string")).alias("file_id"), "ticks"))
    return blocks.upper_medians(both, ["file_id"], "ticks")


def _long(sql: str) -> str:
    return sql.replace("CAST(user_id AS VARCHAR) AS file_id", "CASE WHEN user_id % 3 = 0 THEN 'long' ELSE CAST(user_id AS VARCHAR) END AS file_id")


QUERIES_SQL = {
    blocked_wall_clock: f"WITH {_long(s.CLOCKED_SQL)} SELECT file_id, file_offset, partition_index, wc, wc_ms, has_sync FROM frm",
    blocked_sections: f"WITH {_long(s.SECTIONS_SQL)} SELECT * FROM sections",
    blocked_repair: f"""WITH {_long(s.RECORDS_SQL)}, n AS (SELECT file_id, file_offset, row_number() OVER w AS i, greatest(ticks - first_value(ticks) OVER w, 0) AS rebased FROM rec WINDOW w AS (PARTITION BY file_id ORDER BY file_offset))
SELECT *, i + max(rebased - i) OVER (PARTITION BY file_id ORDER BY file_offset) AS repaired FROM n""",
    exact_medians: f"""WITH {_long(s.RECORDS_SQL)}, b AS (SELECT file_id, ticks FROM rec UNION ALL SELECT 'track ' || track_id, ticks FROM rec)
SELECT file_id, CAST(quantile_disc(ticks, 0.5 ORDER BY ticks DESC) AS BIGINT) AS median FROM b GROUP BY file_id""",
}
