"""Structure documents of recordings as files, one ``<recording>.metadata.json.gz`` each, written and read as they stream by.

A document is an object with the list ``partitions``, each with index, entries and header. The entries' texts come from Spark row by row; a
task puts them between the brackets in order, so neither writing nor reading ever holds a recording's entries together.
"""

from __future__ import annotations

import gzip
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import nested
from tapeline.operators.timeline import DEFAULT, Order
from tapeline.sources import archive, ranges, sinks

ENDING, TREE_ENDING = ".metadata.json.gz", ".tree.json.gz"
#: Characters read at a time.
CHUNK = 1 << 16


def write_documents(rows: DataFrame, folder: str, order: Order = DEFAULT) -> DataFrame:
    """name, entries, bytes of each document written. ``rows``: known records with partitions and wall clocks, as ``nested.structure`` takes them."""
    header = F.to_json(nested.header_of(rows))
    is_header = F.col("track_type") == "PartitionHeader"
    name = F.concat(F.substring_index(order.file, "/", -1), F.lit(ENDING))
    parts = nested.tagged(rows).select(name.alias("name"), F.col("partition_index").alias("part"), F.col(order.offset).alias("at"), is_header.alias("is_header"), F.when(is_header, header).otherwise(F.to_json("entry")).alias("text"))
    return _written(parts, ["part", "at"], folder, _Document)


def write_trees(found: DataFrame, folder: str) -> DataFrame:
    """name, entries, bytes of each tree written, a file ``<recording>.tree.json.gz`` each with the text of ``nested.tree``. ``found``: rows of ``nested.entries``.

    Labels and counts stand before the entries that they tell of: they come from ``nested.group_counts`` as rows of their own, sorted before the group's
    entries. So no recording, partition or group is held together.
    """
    of_group = [F.col(c) for c in ("partition_index", "group_rank", "group_track", "group_name")]
    name = F.concat(F.substring_index("file_id", "/", -1), F.lit(TREE_ENDING)).alias("name")
    opened = lambda fields, member: F.concat(F.regexp_replace(F.to_json(fields), "\\}$", ","), F.lit(f'"{member}":['))
    count = lambda c: F.col(c).cast("int").alias(c)
    part = F.struct(F.concat(F.lit("Partition "), F.col("partition_index").cast("string")).alias("label"), F.col("partition_index").alias("index"), count("total_entries"))
    heads = nested.group_counts(found).select(name, *of_group, F.lit(None).cast("long").alias("at"), opened(part, "groups").alias("part_head"), opened(F.struct("label", count("count")), "entries").alias("text"))
    rows = found.select(name, *of_group, F.col("file_offset").alias("at"), F.lit(None).cast("string").alias("part_head"), F.to_json(F.struct(*nested.FIELDS)).alias("text"))
    return _written(heads.unionByName(rows), ["partition_index", "group_rank", "group_track", "group_name", "at"], folder, _Tree)  # nulls, the heads, are first


def _written(rows: DataFrame, order: list[str], folder: str, kind: type[_Document | _Tree]) -> DataFrame:
    """A document of each name from its rows in order; run by an action on the result."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "name").sortWithinPartitions("name", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = None
        try:
            for batch in batches:
                for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if document is None or document.name != name:
                        if document is not None:
                            yield document.done()
                        document = kind(folder, name)
                    document.put(*row)
            if document is not None:
                yield document.done()
                document = None
        except BaseException:
            if document is not None:
                document.out.close(keep=False)
            raise

    return ordered.mapInArrow(run, "name string, entries long, bytes long")


class _Document:
    """A document on its way: pieces of text in order."""

    def __init__(self, folder: str, name: str) -> None:
        self.name, self.out, self.entries, self.part, self.header, self.first = name, sinks._File(folder, name, compress=True), 0, None, None, True
        self.out.write(b'{"partitions":[')

    def _close_part(self) -> None:
        if self.part is not None:
            self.out.write(b"]" + (b',"header":' + self.header.encode() if self.header else b"") + b"}")

    def put(self, part: int, at: int, is_header: bool, text: str) -> None:
        if part != self.part:
            self._close_part()
            self.out.write(b"," * (self.part is not None) + b'{"index":%d,"entries":[' % part)
            self.part, self.header, self.first = part, None, True
        if is_header:
            self.header = self.header or text
        else:
            self.out.write(b"," * (not self.first) + text.encode())
            self.first, self.entries = False, self.entries + 1

    def done(self) -> pa.RecordBatch:
        self._close_part()
        self.out.write(b"]}")
        self.out.close(keep=True)
        return _done(self)


class _Tree:
    """A tree on its way: the head of a group opens it, and its partition where that is a new one."""

    def __init__(self, folder: str, name: str) -> None:
        self.name, self.out, self.entries, self.part, self.first = name, sinks._File(folder, name, compress=True), 0, None, True
        self.out.write(b'{"partitions":[')

    def put(self, part: int, rank: int, track: int, group: str, at: int | None, part_head: str | None, text: str) -> None:
        if part_head is None:
            self.out.write(b"," * (not self.first) + text.encode())
            self.first, self.entries = False, self.entries + 1
            return
        if part != self.part:
            self.out.write((b"]}]}," if self.part is not None else b"") + part_head.encode())
        else:
            self.out.write(b"]},")
        self.out.write(text.encode())
        self.part, self.first = part, True

    def done(self) -> pa.RecordBatch:
        self.out.write(b"]}]}]}")  # every file has a group, as its rows are entries
        self.out.close(keep=True)
        return _done(self)


def _done(document: _Document | _Tree) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([document.name]), pa.array([document.entries]), pa.array([document.out.bytes])], names=["name", "entries", "bytes"])


class _Pull:
    """JSON values taken one by one from a stream of text."""

    def __init__(self, read) -> None:
        self.read, self.held, self.at, self.ended, self.decoder = read, "", 0, False, json.JSONDecoder()

    def _more(self) -> bool:
        text = self.read(CHUNK)
        self.ended = not text
        self.held, self.at = self.held[self.at :] + text, 0
        return not self.ended

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.held) or not self._more():
                return self.held[self.at : self.at + 1]

    def take(self, wanted: str) -> bool:
        """Whether the next character is ``wanted``, which then is gone."""
        if self.peek() != wanted:
            return False
        self.at += 1
        return True

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"{wanted} expected, found {self.peek() or 'the end'}")

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.held, self.at)
                if self.held[end : end + 1] in set(",]} \t\r\n") or self.ended or not isinstance(found, int | float):  # else a number may go on
                    text = self.held[self.at : end]
                    self.at = end
                    return found, text
            except ValueError:
                if self.ended:
                    raise
            self._more()

    def members(self) -> Iterator[str]:
        """Names of an object's members; the caller takes each value before the next name."""
        self.need("{")
        while not self.take("}"):
            yield self.value()[0]
            self.take(",")

    def colon(self) -> None:
        self.need(":")

    def items(self) -> Iterator[None]:
        """One turn for each item of a list, which the caller takes."""
        self.need("[")
        while not self.take("]"):
            yield
            self.take(",")


def entries_of(read) -> Iterator[tuple[int, int | None, str]]:
    """(partition, place, text) of each entry of a document; the header's text has no place. Other members are passed over."""
    pull = _Pull(read)
    for member in pull.members():
        pull.colon()
        if member != "partitions":
            pull.value()
            continue
        for number, _ in enumerate(pull.items()):
            index = number
            for part in pull.members():
                pull.colon()
                if part == "entries":
                    for place, _ in enumerate(pull.items()):
                        yield index, place, pull.value()[1]
                elif part == "header":
                    found, text = pull.value()
                    if found is not None:
                        yield index, None, text
                elif part == "index":
                    index = pull.value()[0]
                else:
                    pull.value()


def read_documents(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """file_id (the recording's name), partition_index, place, entry, header: a row for each entry and each header of the documents."""
    files, _ = archive.list_files(spark, patterns)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = ranges.located(path)
                name, rows = path.rsplit("/", 1)[-1].removesuffix(ENDING), []
                with store.open_input_stream(inner, compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8") as text:
                    for part, place, piece in entries_of(text.read):
                        rows.append((name, part, place, piece if place is not None else None, None if place is not None else piece))
                        if len(rows) == 5000:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_id", "partition_index", "place", "entry", "header"])

    rows = files.select("path").repartition(tasks, "path").mapInArrow(run, "file_id string, partition_index int, place long, entry string, header string")
    return rows.select("file_id", "partition_index", "place", F.from_json("entry", nested.ENTRY).alias("entry"), F.from_json("header", nested.HEADER).alias("header"))


def groups_of(read) -> Iterator[tuple[int, int, int, str, int, str]]:
    """(partition, its entries, group's place, label, place, text) of each entry of a tree; what tells of a list stands before it."""
    pull = _Pull(read)
    for _ in pull.members():
        pull.colon()
        for _ in pull.items():
            part = {}
            for member in pull.members():
                pull.colon()
                if member != "groups":
                    part[member] = pull.value()[0]
                    continue
                for group_place, _ in enumerate(pull.items()):
                    group = {}
                    for field in pull.members():
                        pull.colon()
                        if field != "entries":
                            group[field] = pull.value()[0]
                            continue
                        for place, _ in enumerate(pull.items()):
                            yield part["index"], part["total_entries"], group_place, group["label"], place, pull.value()[1]


def read_trees(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """One row per entry of the trees that the patterns name, as ``nested.parsed_tree`` gives them; ``file_id`` is the recording's name."""
    files, _ = archive.list_files(spark, patterns)
    schema = "file_id string, partition_index int, total_entries int, group_place long, label string, place long, entry string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = ranges.located(path)
                name = path.rsplit("/", 1)[-1].removesuffix(TREE_ENDING)
                with store.open_input_stream(inner, compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8") as text:
                    found = groups_of(text.read)
                    while rows := [(name, *row) for row in itertools.islice(found, 5000)]:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("path").repartition(tasks, "path").mapInArrow(run, schema)
    return rows.withColumn("e", F.from_json("entry", nested.TREE_ENTRY)).select(*names[:-1], "e.*")


def flattened(documents: DataFrame) -> DataFrame:
    """One row per entry of ``read_documents``, as ``nested.flattened`` gives them."""
    return nested.merged_fields(documents.where("place is not null").withColumn("e", F.col("entry")))
