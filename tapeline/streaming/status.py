"""Progress events of a batch: coding, log rows, and the state of each file, for batches and streams alike.

A stream has two forms. ``status_stream`` keeps the aggregates of ``file_status`` and gives a file's whole row at each update.
``changes_stream`` keeps a state of its own for each open file and gives what has changed: its work at an update does not grow with the
outputs that a file already has, and a finished file's state goes after a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENT = "type string, level string, message string, path string, count bigint, index bigint, total bigint, error string, outputs array<string>, errors array<string>"


def to_event_json(fields: Column) -> Column:
    """A struct of EVENT's fields as JSON; what a kind does not have is null and left out."""
    return F.to_json(fields)


def from_event_json(text: Column) -> Column:
    return F.from_json(text, EVENT)


def parsed(events: DataFrame, json: str = "json") -> DataFrame:
    """Adds the event's fields; other columns (file_index, seq) pass."""
    rows = events.withColumn("event", from_event_json(F.col(json)))
    return rows.select(*(c for c in events.columns if c != json), "event.*")


def log_rows(events: DataFrame) -> DataFrame:
    """level and message of the events that are told in the log; stateless, so a stream may append it."""
    kind = F.col("type")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    message = (
        F.when(kind == "log", F.coalesce("message", F.lit("")))
        .when(kind == "partitions_found", F.concat(F.lit("Found "), text(F.col("count")), F.lit(" partition(s)")))
        .when(kind == "partition_started", F.concat(F.lit("Processing partition "), (F.coalesce("index", F.lit(0).cast("long")) + 1).cast("string"), F.lit("/"), text(F.col("total"))))
        .when(kind == "partition_error", F.concat(F.lit("Partition #"), text(F.col("index")), F.lit(": "), text(F.col("error"))))
    )
    level = F.when(kind == "log", F.coalesce("level", F.lit("info"))).when(kind == "partition_error", F.lit("error")).otherwise(F.lit("info"))
    return events.withColumn("log_message", message).where("log_message is not null").select("file_index", "seq", level.alias("level"), F.col("log_message").alias("message"))


def told(events: DataFrame) -> DataFrame:
    """What each event tells of its file: status, partition_count, progress, error and an output's path, null where it tells nothing."""
    kind = F.col("type")
    failed = F.coalesce(F.size("errors") > 0, F.lit(False))
    status = F.when(kind == "file_started", F.lit("Processing")).when(kind == "call_error", F.lit("Failed")).when((kind == "file_completed") & failed, F.lit("Failed")).when(kind == "file_completed", F.lit("Completed"))
    progress = F.when(kind == "partitions_found", F.lit(0.0)).when((kind == "partition_started") & (F.col("total") > 0), F.coalesce("index", F.lit(0).cast("long")) * 100.0 / F.nullif("total", F.lit(0).cast("long"))).when(kind == "file_completed", F.lit(100.0))
    error = F.when((kind == "file_completed") & failed, F.array_join("errors", "; ")).when(kind == "call_error", F.col("error"))
    return events.select(
        "file_index", "seq", status.alias("status"), F.when(kind == "partitions_found", F.col("count")).alias("partition_count"), progress.cast("double").alias("progress"), error.alias("error"),
        F.when(kind == "output_generated", F.col("path")).alias("output"),
    )


def file_status(events: DataFrame) -> DataFrame:
    """One row per file: the latest status, partitions, progress, outputs in order and joined errors.

    All of it are aggregates by file, so a batch runs it once and a stream keeps it up to date in ``update`` mode.
    """
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    output = F.when(F.col("output").isNotNull(), F.struct("seq", F.col("output").alias("path")))
    return told(events).groupBy("file_index").agg(
        F.coalesce(latest("status"), F.lit("Pending")).alias("status"), latest("partition_count").alias("partition_count"), latest("progress").alias("progress"),
        F.transform(F.array_sort(F.collect_list(output)), lambda x: x["path"]).alias("outputs"), latest("error").alias("error"),
    )


def status_stream(stream: DataFrame):
    """The writer of a running fold over a stream of (file_index, seq, json); set a sink, a checkpoint folder and a trigger, then start."""
    return file_status(parsed(stream)).writeStream.outputMode("update")


#: What an event may tell, each kept with the number of the event that told it last.
FIELDS = ("status", "partition_count", "progress", "error")
_KEPT = "status string, status_seq long, partition_count long, partition_count_seq long, progress double, progress_seq long, error string, error_seq long"
CHANGES = f"file_index int, {_KEPT}, output_seqs array<long>, output_paths array<string>"
_FINISHED = ("Completed", "Failed")


class Follow(StatefulProcessor):
    """The state of one file: the latest of each field with its event's number, and the outputs by theirs.

    A field is replaced only by an event of a greater number, so late and repeated events change nothing that they should not, in whatever order
    they come. When a file has been finished for ``keep_ms`` its state is dropped.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)
        self.outputs = handle.getMapState("outputs", "seq long", "path string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.kept.exists()  # each call of a state is a message to the JVM; a file without ``kept`` has no outputs and no timers either
        before = self.kept.get() if known else None
        state, made = list(before or [None] * (2 * len(FIELDS))), {}
        for row in rows:
            for i, field in enumerate(FIELDS):
                if row[field] is not None and (state[2 * i + 1] is None or row["seq"] > state[2 * i + 1]):
                    state[2 * i : 2 * i + 2] = row[field], row["seq"]
            if row["output"] is not None:
                made.setdefault(row["seq"], row["output"])
        new = sorted((seq, path) for seq, path in made.items() if not known or not self.outputs.containsKey((seq,)))
        for seq, path in new:
            self.outputs.updateValue((seq,), (path,))
        if known and tuple(state) == tuple(before) and not new:
            return
        self.kept.update(tuple(state))
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        if state[0] in _FINISHED:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        names = ["file_index", *(n for f in FIELDS for n in (f, f"{f}_seq")), "output_seqs", "output_paths"]
        yield Row(**dict(zip(names, [key[0], *state, [s for s, _ in new], [p for _, p in new]], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        self.outputs.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes_stream(stream: DataFrame, keep_ms: int = 3_600_000) -> DataStreamWriter:
    """The writer of the changes in a stream of (file_index, seq, json); start it by ``started``.

    A file has one row in a micro-batch at most, and none if nothing has changed: the latest of each field with the number of the event
    that told it, and the outputs that are new. Rows are facts that later ones do not take back, so they are appended. State is
    held for files that are not finished, and for ``keep_ms`` after that; an event that comes later still begins a new state, which ``latest`` puts in
    its place by the numbers. Events without a number are left out.
    """
    rows = told(parsed(stream).withColumn("file_index", F.col("file_index").cast("int")).where("seq is not null"))
    return rows.groupBy("file_index").transformWithState(statefulProcessor=Follow(keep_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime").writeStream.outputMode("append")


#: The state store that a state of several variables needs; and no batches without events, as one that may have timers would never come to an end.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a writer of ``changes_stream`` with the settings that it needs; other streams of the session keep theirs. States expire in the batches of later events."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def latest(changes: DataFrame) -> DataFrame:
    """The rows of ``file_status`` from the changes, in whatever order they are and however often one is repeated."""
    last = lambda c: F.max_by(c, f"{c}_seq")
    outputs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("output_seqs", "output_paths"))))
    return changes.groupBy("file_index").agg(
        F.coalesce(last("status"), F.lit("Pending")).alias("status"), last("partition_count").alias("partition_count"), last("progress").alias("progress"),
        F.transform(F.array_sort(outputs), lambda x: x["output_paths"]).alias("outputs"), last("error").alias("error"),
    )
