"""A store of decoded records that takes in what is new: Parquet by camera and day, and a list of the files that it holds.

Camera and day come from a file's name, so a query by either reads its folders alone. A run compares the files that the
patterns name with the list, by path, length and time of change, and scans those that are new or have changed. Folders
(camera, day) that these belong to are written anew from their stored rows and the scanned ones, by tasks, beside the store first and put in place when
all are whole; other folders and other recordings are not opened, nor those of other cameras listed. The list is appended to last: a run that was cut off is done again by the next one,
with the same result. A store has one writer at a time.

Defined results: names without a camera or a time go to ``unknown``; error rows are kept as the scan gives them; an empty file is as one
that is not there, as Spark lists none; patterns that name nothing take in nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tapeline.functions import naming
from tapeline.session import listing, saved, shared_folder
from tapeline.sources import archive, sinks, splits

UNKNOWN = "unknown"
LISTED = "path string, length long, modified timestamp, camera string, day string, run long, present boolean"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _emptied(spark: SparkSession, folder: str) -> str:
    """The folder, with nothing in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path, True)
    store.mkdirs(path)
    return folder


def placed(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``camera`` and ``day`` (UTC) of the file's name."""
    name = naming.file_name(F.col(path))
    day = F.date_from_unix_date(F.floor(naming.recorded_ms(name) / 86_400_000).cast("int")).cast("string")
    return rows.withColumns({"camera": F.coalesce(naming.mac_of(name), F.lit(UNKNOWN)), "day": F.coalesce(day, F.lit(UNKNOWN))})


def files(spark: SparkSession, store: str) -> DataFrame:
    """path, length, modified, camera, day, run of the files that the store holds, as of the last run that told of each."""
    if not _exists(spark, f"{store}/files"):
        return spark.createDataFrame([], LISTED).drop("present")
    told = spark.read.schema(LISTED).parquet(f"{store}/files")
    columns = [c for c in told.columns if c != "path"]
    latest = told.groupBy("path").agg(F.max_by(F.struct(*columns), "run").alias("last")).select("path", "last.*")
    return latest.where("present").drop("present")


def records(spark: SparkSession, store: str, cameras: list[str] | None = None) -> DataFrame:
    """The stored records and error rows, with ``camera`` and ``day``; filters on these two choose the folders that are read, ``cameras`` those that are listed."""
    fields = StructType(archive.decoded(spark.createDataFrame([], archive.RAW)).schema.fields).add("camera", StringType()).add("day", StringType())
    base = f"{store}/records"
    found = [f for f in ([base] if cameras is None else [f"{base}/camera={c}" for c in cameras]) if _exists(spark, f)]
    if not found:
        return spark.createDataFrame([], fields)
    with listing(spark):
        return spark.read.schema(fields).option("basePath", base).parquet(*found).where("file_id is not null")


def changes(spark: SparkSession, patterns: list[str], store: str, drop_missing: bool = False) -> DataFrame:
    """path, length, modified, camera, day, change (``new``, ``changed``, ``removed``) of the files that differ from the list.

    ``removed`` are listed files that no pattern names, told only with ``drop_missing``.
    """
    found = placed(archive.list_files(spark, patterns)[0], "path")
    known = files(spark, store).select("path", F.col("length").alias("had"), F.col("modified").alias("had_modified"), F.col("camera").alias("its_camera"), F.col("day").alias("its_day"))
    differs = (F.col("length") != F.col("had")) | (F.col("modified") != F.col("had_modified"))
    change = F.when(F.col("had").isNull(), "new").when(F.col("length").isNull(), F.lit("removed") if drop_missing else F.lit(None)).when(differs, "changed")
    rows = found.join(known, "path", "full").withColumn("change", change).where("change is not null")
    return rows.select("path", "length", "modified", F.coalesce("camera", "its_camera").alias("camera"), F.coalesce("day", "its_day").alias("day"), "change")


def ingest(spark: SparkSession, patterns: list[str], store: str, drop_missing: bool = False, split: int = splits.SPLIT) -> DataFrame:
    """Takes in the new and changed files; gives the rows of ``changes`` that it has acted on."""
    folder = f"{shared_folder(spark, 'changes')}/rows"
    changes(spark, patterns, store, drop_missing).write.parquet(folder)
    done = spark.read.parquet(folder)  # as written: Spark knows its size and broadcasts it only if it is small
    if done.isEmpty():
        return done
    acted = done.where("change in ('new', 'changed', 'removed')")
    folders = acted.select("camera", "day").distinct()
    stored = records(spark, store, [r.camera for r in folders.select("camera").distinct().collect()])
    kept = stored.join(folders, ["camera", "day"], "left_semi").join(done.select(F.col("path").alias("file_id")), "file_id", "left_anti").select(stored.columns)
    fresh = placed(splits.scan_listed(done.where("change <> 'removed'"), split), "file_id").select(stored.columns)
    rows = fresh.unionByName(kept).unionByName(folders, allowMissingColumns=True)  # one row without a file, as a folder that becomes empty must be written too
    rows = rows.hint("rebalance", "camera", "day").sortWithinPartitions("camera", "day", "file_id", "file_offset")
    staging = _emptied(spark, f"{store}/.staged")  # a run that was cut off may have left files there
    sinks.replace_folders(saved(sinks.stage_folders(rows, ["camera", "day"], staging)), staging, f"{store}/records")
    _emptied(spark, staging)
    spark.catalog.refreshByPath(f"{store}/records")
    run = (spark.read.schema(LISTED).parquet(f"{store}/files").agg(F.max("run")).first()[0] or 0) + 1 if _exists(spark, f"{store}/files") else 1
    listed = done.select("path", "length", "modified", "camera", "day", F.lit(run).cast("long").alias("run"), (F.col("change") != "removed").alias("present"))
    listed.write.mode("append").parquet(f"{store}/files")
    return done
