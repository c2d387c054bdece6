"""Files written by tasks: elementary streams and masked copies of recordings, Parquet of many small folders.

Spark has no writer for raw bytes, and its own for Parquet opens, commits and renames small files at a cost far above what is in them, so a task writes its files itself, through a file system that all executors share (any
URI that pyarrow opens). A file appears under its name only when it is whole: a task writes beside it and renames, so one
that is run again or fails leaves nothing behind, and the last writer wins.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators import mask, units
from tapeline.sources import ranges

#: Bytes of a recording that a copy holds at a time.
PIECE = 1 << 20
#: Bytes of rows that are gathered to a row group.
ROW_GROUP = 16 << 20


class _File:
    """One file on its way: written under another name, then renamed."""

    def __init__(self, folder: str, name: str, compress: bool) -> None:
        self.store, base = ranges.located(folder)
        self.store.create_dir(base)
        self.final, self.path, self.bytes = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}", 0
        self.raw = self.store.open_output_stream(self.path)
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0) if compress else self.raw

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def size(self) -> int:
        """Bytes of the file, once it is closed."""
        return self.store.get_file_info(self.final).size

    def close(self, keep: bool) -> None:
        if self.out is not self.raw:
            self.out.close()
        self.raw.close()
        if keep:
            self.store.move(self.path, self.final)
        else:
            with contextlib.suppress(OSError):
                self.store.delete_file(self.path)


def write_files(rows: DataFrame, folder: str, name: str, order_by: str, payload: str, compress: bool = False) -> DataFrame:
    """name, bytes of every file written: the payloads of each name in order, joined as they stream by. Run by an action on the result."""
    ordered = rows.select(F.col(name).alias("name"), F.col(order_by).alias("at"), F.col(payload).alias("payload")).where("name is not null").repartition("name").sortWithinPartitions("name", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, file = None, None

        def done() -> pa.RecordBatch:
            file.close(keep=True)
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([file.bytes], pa.int64())], names=["name", "bytes"])

        try:
            for batch in batches:
                for n, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if n != current:
                        if file is not None:
                            yield done()
                        current, file = n, _File(folder, n, compress)
                    file.write(data.as_py() or b"")
            if file is not None:
                yield done()
                file = None
        except BaseException:
            if file is not None:
                file.close(keep=False)
            raise

    return ordered.mapInArrow(run, "name string, bytes long")


def _tasks(rows: DataFrame) -> int:
    """Tasks for narrow rows that stand for much work; Spark would join them into one."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_streams(plan: DataFrame, folder: str, order_by: str = "file_offset") -> DataFrame:
    """name, frames, bytes, md5: for each file and partition one stream of the chosen video track and one of audio, each only if that kind has frames.

    ``plan``: file_id (the path), partition_index, track_id, video_track, data_offset, data_size and ``order_by``; no payloads. They are read
    late: the narrow rows are shuffled by target and sorted by place, and the task that writes a stream reads the byte ranges
    of its frames, neighbours together. What is short of a frame, or a unit cut short, fails the job.
    """
    rows = units.of_kinds(plan)
    name = _stream_name().alias("name")
    rows = rows.select(name, F.col(order_by).alias("at"), "file_id", F.col("data_offset").cast("long").alias("data_offset"), F.col("data_size").cast("long").alias("data_size"), "plain")
    ordered = rows.repartition(_tasks(rows), "name").sortWithinPartitions("name", "file_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, frames, digest = None, None, 0, None
        path, source = None, None

        def done() -> pa.RecordBatch:
            out.close(keep=True)
            columns = [pa.array([current]), pa.array([frames], pa.int64()), pa.array([out.bytes], pa.int64()), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=["name", "frames", "bytes", "md5"])

        try:
            for batch in batches:
                names, _, files, offsets, sizes, plain = (c.to_pylist() for c in batch.columns)
                first = 0
                while first < len(names):
                    last = first + 1
                    while last < len(names) and (names[last], files[last]) == (names[first], files[first]):
                        last += 1
                    if names[first] != current:
                        if out is not None:
                            yield done()
                        current, out, frames, digest = names[first], _File(folder, names[first], compress=False), 0, hashlib.md5()
                        path = None  # a compressed file is read from its start again
                    if files[first] != path:
                        if source is not None:
                            source.close()
                        path, source = files[first], ranges.opened(files[first])
                    spans = list(zip(offsets[first:last], sizes[first:last], strict=True))
                    for i, payload in enumerate(ranges.payloads(source, spans), first):
                        stream, ok = units.with_start_codes(payload, plain[i])
                        if not ok:
                            raise ValueError(f"a unit of frame {files[i]}@{offsets[i]} reaches past its end")
                        out.write(stream)
                        digest.update(stream)
                        frames += 1
                    first = last
            if out is not None:
                yield done()
                out = None
        except BaseException:
            if out is not None:
                out.close(keep=False)
            raise
        finally:
            if source is not None:
                source.close()

    return ordered.mapInArrow(run, "name string, frames long, bytes long, md5 string")


def write_masked(files: DataFrame, spans: DataFrame, folder: str, check: bool = False) -> DataFrame:
    """name, bytes: masked, compressed copies ``anonymised-<stem>.ubv.gz`` of recordings of any size; compressed ones are refused.

    ``files``: file_id (the path) of every recording to copy; ``spans``: file_id, start, size, a row for each range to set to zero. A task streams a file from its place to the copy and
    puts zeros where the spans, sorted by start, pass by; contents never enter a row. With ``check`` the columns plain_bytes and md5 tell what the copy inflates to.
    """
    opening = files.select("file_id", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))
    named = spans.select("file_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    rows = opening.distinct().unionByName(named).withColumn("name", mask.anonymised_name(F.col("file_id")))
    refused = F.raise_error(F.concat(F.col("file_id"), F.lit(" is compressed"))).cast("string")
    rows = rows.withColumn("name", F.when(F.col("name").isNull(), refused).otherwise(F.col("name")))
    ordered = rows.repartition(_tasks(rows), "file_id").sortWithinPartitions("file_id", "start").select("file_id", "name", "start", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = None
        try:
            for batch in batches:
                for file, name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if start < 0:
                        if copy is not None:
                            yield copy.done()
                        copy = _Copy(file, folder, name)
                    elif copy is not None and copy.file == file:  # spans of files that are not asked for go
                        copy.zeros(start, size)
            if copy is not None:
                yield copy.done()
                copy = None
        except BaseException:
            if copy is not None:
                copy.out.close(keep=False)
            raise

    done = ordered.mapInArrow(run, "name string, bytes long, plain_bytes long, md5 string")
    return done if check else done.select("name", "bytes")


class _Table:
    """A Parquet file on its way, a row group at a time."""

    def __init__(self, folder: str, schema: pa.Schema) -> None:
        store, base = ranges.located(folder)
        self.name, self.held, self.bytes = f"{uuid.uuid4().hex}.parquet", [], 0
        self.raw = store.open_output_stream(f"{base}/{self.name}")
        self.out = pq.ParquetWriter(self.raw, schema)

    def write(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes
        if self.bytes >= ROW_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held))
            self.held, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.raw.close()


def stage_folders(rows: DataFrame, keys: list[str], staging: str) -> DataFrame:
    """path (``key=value/...``), file: Parquet files of ``rows``, which lie sorted by the keys (strings that a path may hold) in their tasks, written to ``staging``. Run by an action on the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table = None, None

        def told(done: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["path", "file"])

        def path() -> str:
            return "/".join(f"{k}={v}" for k, v in zip(keys, current, strict=True))

        for batch in batches:
            done, first = [], 0
            data = batch.select([c for c in batch.schema.names if c not in keys])
            for group, same in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                n = sum(1 for _ in same)
                if group != current:
                    if table is not None:
                        table.close()
                        done.append((path(), table.name))
                    current, table = group, _Table(staging, data.schema)
                table.write(data.slice(first, n))
                first += n
            yield told(done)
        if table is not None:
            table.close()
            yield told([(path(), table.name)])

    return rows.mapInArrow(run, "path string, file string")


def replace_folders(staged: DataFrame, staging: str, folder: str) -> None:
    """Puts staged files in place of what their folders under ``folder`` hold; other folders are not touched.

    ``staged`` is at hand (``saved``), and none of the replaced files is read for it any more. A folder of one file changes at once, by a rename over it; of one with several a
    reader may see old and new files.
    """
    groups = staged.repartition(_tasks(staged), "path").groupBy("path").agg(F.collect_list("file").alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (_, source) = ranges.located(folder), ranges.located(staging)
        for batch in batches:
            for path, names in zip(*(batch.column(c).to_pylist() for c in ("path", "files")), strict=True):
                target = f"{base}/{path}"
                store.create_dir(target)
                old = {f.base_name for f in store.get_file_info(fs.FileSelector(target)) if f.is_file}
                new = [f"part-{i:05}.parquet" for i in range(len(names))]
                for name, final in zip(sorted(names), new, strict=True):
                    try:
                        store.move(f"{source}/{name}", f"{target}/{final}")
                    except FileNotFoundError:
                        if final not in old:  # else moved by an attempt that was cut off
                            raise
                for name in old.difference(new):
                    store.delete_file(f"{target}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    groups.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


class _Copy:
    """A recording on its way to its masked copy, a piece at a time."""

    def __init__(self, file: str, folder: str, name: str) -> None:
        self.file, self.name, self.at = file, name, 0
        self.source, self.out, self.digest = ranges.Plain(file), _File(folder, name, compress=True), hashlib.md5()

    def _put(self, piece: bytes) -> None:
        self.out.write(piece)
        self.digest.update(piece)
        self.at += len(piece)

    def upto(self, stop: int) -> None:
        while self.at < stop:
            self._put(self.source.range(self.at, min(PIECE, stop - self.at)))

    def zeros(self, start: int, size: int) -> None:
        stop = min(start + size, self.source.length)
        self.upto(min(start, self.source.length))
        while self.at < stop:
            self._put(bytes(min(PIECE, stop - self.at)))

    def done(self) -> pa.RecordBatch:
        self.upto(self.source.length)
        self.source.close()
        self.out.close(keep=True)
        columns = [pa.array([self.name]), pa.array([self.out.size()], pa.int64()), pa.array([self.at], pa.int64()), pa.array([self.digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=["name", "bytes", "plain_bytes", "md5"])


def _stream_name():
    return F.concat_ws(".", F.concat_ws("_", F.substring_index("file_id", "/", -1), F.col("partition_index").cast("string"), "kind"), F.coalesce("extension", F.lit("h264")))


def write_kinds(frames: DataFrame, folder: str, order_by: str = "file_offset") -> DataFrame:
    """name, bytes: for each file and partition one stream of the chosen video track and one of audio, each only if that kind has frames.

    ``frames``: file_id, partition_index, track_id, video_track (the chosen one), payload and ``order_by``. A unit that is
    cut short fails the job.
    """
    rows = units.kinds(frames, ["file_id", "partition_index"], order_by)
    rows = units.complete(rows.withColumn("frame", F.concat_ws("@", "file_id", F.col(order_by).cast("string"))), "frame")
    return write_files(rows.withColumn("name", _stream_name()), folder, "name", order_by, "stream")
