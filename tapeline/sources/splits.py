"""Scan of recordings of any size: byte ranges of one file are walked by different tasks.

A record tells its length, so where a record starts is known for certain only from the start of the file. Three passes:

1. Every split looks at its own bytes alone. Records are aligned to four bytes; whatever has the mark and the checksum of a
   header may be a record's start, in a payload too. From each such place the chain of lengths is followed, for all places at once by
   pointer doubling, to where it leaves the split or ends, and whether something on it is broken.
2. These small maps of a file pass by in order of its splits: from offset 0 each split's map tells where the true chain leaves it, which is the
   entry of a later split. A map at a time is held.
3. Each split with an entry is walked from there, by seeks past large payloads, and gives the records that begin in it.

A file's error is known after the second pass, so every row tells whether its file is broken anywhere, and policies read nothing twice. Compressed
files can be read forward only; one task walks each in constant memory, once to see whether it is sound and once for its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import decode
from tapeline.session import saved
from tapeline.sources import archive, ranges

SPLIT = 64 << 20
#: Bytes of a split that are looked at together, and of the longest header with its size.
PIECE, LONGEST_HEADER = 4 << 20, 32
#: The end of a file that is walked by one task.
WHOLE = 2**62
#: Tasks of a pass at most.
MOST_TASKS = 20_000
MAP = "file_id string, split long, start long, stop long, places binary, exits binary, bad binary, fault string"
ENTRY = "file_id string, entry long, stop long, broken boolean, fault string"
_MAP_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
_ENTRY_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
#: Maps or entries in a batch at most.
TOGETHER = 1000


def chains(read, start: int, stop: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in [start, stop) that may be records, where the chain from each leaves the range (-1: it ends in it), and whether it meets an error there."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(start, min(stop, length), PIECE):
        own = min(at + PIECE, stop, length) - at
        data = np.frombuffer(read(at, own + LONGEST_HEADER), np.uint8)
        lead = data[: len(data) // 4 * 4].reshape(-1, 4)
        hit = np.flatnonzero((lead[:, 0] == decode.MAGIC) & (lead[:, 0] ^ lead[:, 1] ^ lead[:, 2] == lead[:, 3])) * 4
        hit = hit[(hit < own) & (len(data) - hit >= 8)]
        rest = np.concatenate([data, np.zeros(LONGEST_HEADER, np.uint8)]).astype(np.int64)
        high, low = rest[hit + 4], rest[hit + 5]
        dts_at = 8 + 4 * (low & 15 == 1)
        wide = high & decode.DTS_64 != 0
        header = dts_at + np.where(wide, 8, 4) + 4 * (high & decode.HAS_EXTRA != 0) + 4 * (high & 0x40 == 0)
        size = sum(rest[hit + header + i] << 8 * (3 - i) for i in range(4))
        end = at + hit + header + 4 + size
        cut = (len(data) - hit < header + 4) | ((size <= archive.INLINE) & (end > length))
        wrong = cut | (wide & (rest[hit + dts_at] >= 0x80)) | ((rest[hit + 1] == 0xDA) & (rest[hit + 2] == 0x7E) & (size < 8))
        found.append((at + hit, np.where(cut, -1, end + -end % 4 + 4), wrong))
    places, after, bad = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    index = np.minimum(np.searchsorted(places, after), max(0, len(places) - 1))
    inner = (after >= 0) & (after < stop)
    linked = inner & (places[index] == after) if len(places) else inner
    leads = ((target, read(target, 8)) for target in np.unique(after[inner & ~linked]).tolist())
    none = [target for target, lead in leads if len(lead) == 8 and lead[0]]  # here stands no record, nor do the records end
    bad |= inner & ~linked & np.isin(after, none)
    ends, to = np.where(inner, -1, after), np.where(linked, index, np.arange(len(places)))
    for _ in range(max(1, len(places)).bit_length()):
        bad = bad | bad[to]
        to = to[to]
    return places, ends[to], bad


def _sound(source: ranges.Inflated) -> tuple[bool, str | None]:
    """Whether the walk of a compressed file meets an error, and what is wrong with its compression."""
    bad = False
    try:
        for _, head, payload, error in archive.walk(source.read):
            bad = bad or bool(error) or archive.is_broken(head, payload)
        while source.read(source.at + len(source.held), 1):  # to the end: its checksum counts
            pass
    except (zlib.error, EOFError) as broken:
        return True, str(broken)
    return bad, None


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maps of splits; those of many small ones go in one batch, as a batch costs more than such a map."""
    held, size = [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in held], kind) for i, kind in enumerate(_MAP_KINDS)], names=["file_id", "split", "start", "stop", "places", "exits", "bad", "fault"])

    for batch in batches:
        for file, split, start, stop, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            source = ranges.opened(file)
            try:
                if ranges.is_compressed(file):
                    bad, fault = _sound(source)
                    places, exits, bads, stop = np.zeros(1, np.int64), np.full(1, -1), np.array([bad]), WHOLE
                else:
                    fault, (places, exits, bads) = None, chains(source.read, start, stop, length)
            finally:
                source.close()
            held.append((file, split, start, stop, ((places - start) // 4).astype(np.uint32).tobytes(), exits.astype(np.int64).tobytes(), bads.astype(np.uint8).tobytes(), fault))
            size += 13 * len(places)
            if len(held) == TOGETHER or size >= PIECE:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The true chain of each file, from the maps of its splits in order."""
    file, at, broken, fault, found, held = None, 0, False, None, [], []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in held], kind) for i, kind in enumerate(_ENTRY_KINDS)], names=["file_id", "entry", "stop", "broken", "fault"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["file_id"] != file:
                held += [(file, e, s, broken, fault) for e, s in found]
                if len(held) >= TOGETHER:
                    yield told()
                    held = []
                file, at, broken, fault, found = row["file_id"], 0, False, None, []
            if not row["start"] <= at < row["stop"]:
                continue  # inside a payload, or the chain has ended before
            found.append((at, row["stop"]))
            fault = row["fault"]
            places = np.frombuffer(row["places"], np.uint32)
            place = int(np.searchsorted(places, (at - row["start"]) // 4))
            if place < len(places) and places[place] == (at - row["start"]) // 4:
                broken = broken or bool(row["bad"][place])
                at = int(np.frombuffer(row["exits"], np.int64)[place])
            else:
                source = ranges.opened(file)
                lead = source.read(at, 8)
                source.close()
                broken, at = broken or (len(lead) == 8 and lead[0] != 0), -1
    held += [(file, e, s, broken, fault) for e, s in found]
    if held:
        yield told()


def _records(with_payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, entry, stop, broken, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fault is not None:
                    yield file, 0, None, None, {"code": "bad_gzip", "offset": 0, "message": fault}, True
                    continue
                source = ranges.opened(file)
                try:
                    yield from archive.raw_rows(file, archive.walk(source.read, entry, stop), broken, with_payload)
                finally:
                    source.close()

    return lambda batches: archive.batched(rows(batches))


def scan_files(spark: SparkSession, patterns: list[str], split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Decoded records and error rows of the files that the patterns name, whatever their size; ``split``: bytes of a task's range, a multiple of 4."""
    return scan_listed(saved(archive.list_files(spark, patterns)[0]), split, with_payload)  # needed twice, and each listing asks for every file's status


def scan_listed(files: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The same for listed files (path, length)."""
    spark = files.sparkSession
    whole = F.col("path").rlike(r"(?i)\.gz$")
    last = F.when(whole, 0).otherwise(F.greatest(F.call_function("div", F.col("length") - 1, F.lit(split).cast("long")), F.lit(0))).cast("long")
    sizes = files.agg(F.sum(last + 1).alias("splits"), F.sum("length").alias("bytes")).first()
    # a task for each split of the usual size; small files and small splits share tasks
    tasks = min(MOST_TASKS, sizes.splits or 1, max(spark.sparkContext.defaultParallelism, -(-(sizes.bytes or 0) // SPLIT)))
    parts = files.where("length > 0").select(F.col("path").alias("file_id"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"), "length")
    parts = parts.select("file_id", "split", (F.col("split") * split).alias("start"), ((F.col("split") + 1) * split).alias("stop"), "length")
    maps = parts.repartition(tasks, "file_id", "split").mapInArrow(_maps, MAP)  # a number of tasks of its own: the rows are few, the work is not
    entries = maps.repartition("file_id").sortWithinPartitions("file_id", "split").mapInArrow(_entries, ENTRY)
    return archive.decoded(entries.repartition(tasks, "file_id", "entry").mapInArrow(_records(with_payload), archive.RAW))
