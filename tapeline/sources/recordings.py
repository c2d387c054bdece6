"""Recordings as a data source: ``spark.read.format("recordings").option("path", ...)``, from SQL too.

Every file is a partition (small ones share one), walked by a task in constant memory with seeks past large payloads. Filters that
Spark hands over are used where they spare work: of the file's name and of the time and camera in it before a file is opened, of the track before a
record becomes a row. Rows are raw (``archive.decoded`` gives the fields); with the option ``payload`` = false payloads but clock syncs' are left out.
Set ``spark.sql.python.filterPushdown.enabled`` (``register`` does), or Spark filters afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tapeline.sources import archive, ranges

#: Bytes of small files that one task walks.
TOGETHER = 32 << 20
SCHEMA = f"{archive.RAW}, track_id int, file_name string, name_mac string, name_ms long"
# Fixed value: what a recording's name tells, the camera's address and the time in milliseconds.
NAME = re.compile(r"^([0-9A-Fa-f]{12})_.*?_?(\d{10,})\.ubv(?:\.gz)?$", re.IGNORECASE)
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, IsNotNull: lambda a, b: a is not None}
_OF_FILE = ("file_id", "file_name", "name_mac", "name_ms")


def named(path: str) -> dict:
    """What is known of a file before it is opened."""
    name = path.rsplit("/", 1)[-1]
    told = NAME.match(name)
    return {"file_id": path, "file_name": name, "name_mac": told[1].upper() if told else None, "name_ms": int(told[2]) if told else None}


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def listed(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the recordings below a folder; names that begin with a dot or an underscore are left out."""
    store, inner = ranges.located(pattern)
    scheme = pattern[: pattern.index("://") + 3] if "://" in pattern and not pattern.startswith("file:") else "file:"
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(pattern)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.patterns = [p.strip() for p in options["path"].split(";")]
        self.payload = options.get("payload", "true").lower() != "false"
        self.of_files: list[tuple[str, type, object]] = []
        self.of_tracks: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if type(f) in _COMPARE and column in _OF_FILE:
                self.of_files.append((column, type(f), value))
            elif type(f) in _COMPARE and column == "track_id":
                self.of_tracks.append((type(f), value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        known = named(path)
        return all(known[c] is not None and _COMPARE[kind](known[c], value) for c, kind, value in self.of_files)

    def partitions(self) -> Sequence[Files]:
        parts, size = [], TOGETHER
        for path, length in (x for p in self.patterns for x in listed(p)):
            if self._wanted(path):
                if size + length > TOGETHER:
                    parts.append(Files())
                    size = 0
                parts[-1].paths.append(path)
                size += length
        return parts

    def _kept(self, head: bytes | None) -> bool:
        """Error rows have no track and are kept where tracks are not asked for."""
        if head is None:
            return not self.of_tracks
        track = int.from_bytes(head[1:3], "big")
        return all(_COMPARE[kind](track, value) for kind, value in self.of_tracks)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            known, source = named(path), ranges.opened(path)
            try:
                records = ((at, head, payload, error) for at, head, payload, error in self._walked(source) if self._kept(head))
                for batch in archive.raw_batches(path, records, None, self.payload):
                    heads = batch.column("head").to_pylist()
                    track = pa.array([int.from_bytes(h[1:3], "big") if h else None for h in heads], pa.int32())
                    same = [pa.array([known[c]] * len(heads), t) for c, t in (("file_name", pa.string()), ("name_mac", pa.string()), ("name_ms", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, track, *same], names=[*batch.schema.names, "track_id", "file_name", "name_mac", "name_ms"])
            finally:
                source.close()

    def _walked(self, source: ranges.Plain | ranges.Inflated) -> Iterator[tuple]:
        """The records of a file; compression that breaks off is an error row behind those before it."""
        at = 0
        try:
            for record in archive.walk(source.read):
                at = record[0]
                yield record
        except (zlib.error, EOFError) as broken:
            yield at, None, None, {"code": "bad_gzip", "offset": at, "message": str(broken)}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
