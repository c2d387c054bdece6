"""Cameras, queued files, logs, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import naming
from tapeline.sources.archive import list_files


def camera_names(registry: DataFrame) -> DataFrame:
    """mac_key, name: of cameras that match ignoring case, the first one in the registry (pos) whose name is not blank."""
    named = registry.where(F.trim("name") != "")
    return named.groupBy(F.upper("mac").alias("mac_key")).agg(F.min_by("name", "pos").alias("camera_name"))


def with_camera_names(files: DataFrame, registry: DataFrame, mac: str = "mac") -> DataFrame:
    """Adds camera_name, null if unknown. Spark broadcasts the registry if it is small and shuffles it otherwise."""
    names = camera_names(registry)
    return files.join(names, F.upper(F.col(mac)) == names["mac_key"], "left").drop("mac_key")


def upserted(registry: DataFrame, macs: DataFrame) -> DataFrame:
    """The registry and, with blank names, the MACs that it lacks in any case."""
    key = F.upper(F.col("mac"))
    known = registry.select(key.alias("key")).distinct()
    new = macs.select("mac", key.alias("key")).where("key is not null").groupBy("key").agg(F.min("mac").alias("mac")).join(known, "key", "left_anti")
    return registry.select("mac", "name").unionByName(new.select("mac", F.lit("").alias("name")))


def without(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("mac").distinct(), "mac", "left_anti")


def intake(paths: DataFrame, queued: DataFrame) -> DataFrame:
    """New recordings, once each, and whether they need a confirmation (low resolution)."""
    new = paths.where(naming.is_recording(F.col("path"))).select("path").dropDuplicates(["path"]).join(queued.select("path"), "path", "left_anti")
    return new.withColumn("needs_confirmation", naming.is_low_resolution(naming.file_name(F.col("path"))))


def filtered_logs(logs: DataFrame, file_index: int | None = None, level: str = "all", search: str = "") -> DataFrame:
    keep = F.lit(True)
    if file_index is not None:
        keep = keep & (F.col("file_index") == file_index)
    if level.lower() != "all":
        keep = keep & (F.lower("level") == level.lower())
    if search.strip():
        keep = keep & F.contains(F.lower("message"), F.lit(search.strip().lower()))
    return logs.where(keep)


def log_counts(logs: DataFrame) -> DataFrame:
    level = F.lower("level")
    return logs.agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warn").alias("warnings"), F.count_if(~level.isin("error", "warn")).alias("infos"))


def log_lines(logs: DataFrame) -> DataFrame:
    return logs.select("*", F.format_string("%s [%s] %s", F.date_format("timestamp", "HH:mm:ss"), F.col("level"), F.col("message")).alias("line"))


def file_results(outputs: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Outputs and errors of each file in order, errors joined, sizes added (null if nothing). Lists grow with one file's outputs only."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order_by, c)))), lambda x: x[c])
    rows = outputs.groupBy(*keys).agg(ordered("output").alias("outputs"), ordered("error").alias("error_list"), F.sum("size").alias("total"))
    return rows.select(*keys, F.size("outputs").alias("n_outputs"), F.array_join("outputs", "|").alias("outputs"), F.nullif(F.array_join("error_list", "; "), F.lit("")).alias("error"), F.nullif("total", F.lit(0).cast("long")).alias("output_size"))


CAMERAS = "array<struct<mac:string,name:string>>"


def save_registry(registry: DataFrame, path: str) -> None:
    """Cameras with a name, as one JSON document ``{"cameras": [...]}`` in the order of ``pos`` if there is one; it holds one installation's cameras."""
    at = F.col("pos") if "pos" in registry.columns else F.lit(0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(at.cast("long").alias("pos"), "mac", "name"))), lambda x: F.struct(x["mac"].alias("mac"), x["name"].alias("name")))
    registry.agg(registry_to_json(listed).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """pos, mac, name of the document at ``path``; a missing or unreadable one gives no rows."""
    files, unmatched = list_files(spark, [path])
    if unmatched or files.isEmpty():
        return spark.createDataFrame([], "pos long, mac string, name string")
    text = spark.read.text(path, wholetext=True)
    cameras = text.select(F.posexplode(registry_from_json(F.col("value"))).alias("pos", "camera"))
    return cameras.select(F.col("pos").cast("long").alias("pos"), "camera.mac", "camera.name")


def registry_from_json(text: Column) -> Column:
    """array<struct<mac,name>> of a registry document; empty if it cannot be read."""
    return F.coalesce(F.from_json(text, f"cameras {CAMERAS}")["cameras"], F.array().cast(CAMERAS))


def registry_to_json(cameras: Column) -> Column:
    return F.to_json(F.struct(F.filter(cameras, lambda c: F.trim(c["name"]) != "").alias("cameras")))
