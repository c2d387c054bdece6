"""Scan of binary recordings: one row per record.

A task walks a file's bytes and gives out raw headers and small payloads; all fields are decoded by Column expressions.
Here Spark reads the contents (``binaryFile``, so any store that Spark reads), and a file is one row, at most 2 GB long
and handled by one task; ``splits`` walks files of any size in byte ranges, and large payloads are read where they are used (``sinks.write_streams``).
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import decode
from tapeline.session import listing

#: Payloads up to this many bytes are kept in the scan.
INLINE = 1024
#: Bytes of the largest recording that is read.
LARGEST = 2**31 - 1024
RAW = "file_id string, file_offset long, head binary, payload binary, error struct<code:string,offset:bigint,message:string>, broken boolean"


def list_files(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, list[str]]:
    """path, length, modified of the files that any pattern names, once each, and the patterns that name none.

    A path that exists wins over its reading as a pattern.
    """
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    found, unmatched = [], []
    for pattern in patterns:
        path = files.Path(pattern)
        store = path.getFileSystem(conf)
        if store.exists(path):
            found.append("".join("\\" + c if c in "*?[]{}\\" else c for c in pattern))
        elif store.globStatus(path):
            found.append(pattern)
        else:
            unmatched.append(pattern)
    if not found:
        return spark.createDataFrame([], "path string, length long, modified timestamp"), unmatched
    with listing(spark):  # each file that a pattern names is a path of its own
        rows = spark.read.format("binaryFile").load(found)
    return rows.select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"]), unmatched


def read_contents(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """file_id (the path), content; compressed files are inflated in the scan.

    A cell holds ``LARGEST`` bytes at most. Larger files are not opened, by a filter that Spark pushes to the source, and
    do not fail the job; ``too_large`` tells them.
    """
    files = spark.read.format("binaryFile").load(patterns)
    return files.where(F.col("length") <= LARGEST).select(F.col("path").alias("file_id"), "content")


def too_large(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """file_id, code, offset, message of the files that ``read_contents`` leaves out."""
    files = spark.read.format("binaryFile").load(patterns).select("path", "length").where(F.col("length") > LARGEST)
    return files.select(F.col("path").alias("file_id"), F.lit("too_large").alias("code"), F.lit(0).cast("long").alias("offset"), F.concat(F.col("length").cast("string"), F.lit(" bytes")).alias("message"))


def _header_bytes(high: int, low: int) -> int:
    return 8 + (low & 0x0F == 1) * 4 + (8 if high & decode.DTS_64 else 4) + bool(high & decode.HAS_EXTRA) * 4 + (not high & 0x40) * 4


def walk(read: Callable[[int, int], bytes], at: int = 0, stop: int = 2**63) -> Iterator[tuple[int, bytes | None, bytes | None, dict | None]]:
    """(offset, header with the size field, small payload, error) of each record from ``at``, up to ``stop``, the end or the first error.

    ``read``: bytes by place and size, fewer only at the end. Payloads that are large are not read.
    """
    fail = lambda code, text: (at, None, None, {"code": code, "offset": at, "message": text})
    while at < stop:
        lead = read(at, 32)  # no header is longer
        if len(lead) < 8 or not lead[0]:
            return
        if lead[0] != decode.MAGIC:
            yield fail("bad_magic", f"0x{lead[0]:02X} is no record start")
            return
        if lead[0] ^ lead[1] ^ lead[2] != lead[3]:
            yield fail("checksum", "header bytes do not match their checksum")
            return
        header = _header_bytes(lead[4], lead[5]) + 4
        head = lead[:header]
        if len(head) < header:
            yield fail("short_header", "the file ends inside a header")
            return
        size = int.from_bytes(head[-4:], "big")
        payload = read(at + header, size) if size <= INLINE else None
        if payload is not None and len(payload) < size:
            yield fail("short_payload", "the file ends inside a payload")
            return
        yield at, head, payload, None
        at += header + size
        at += -at % 4 + 4


def is_broken(head: bytes | None, payload: bytes | None) -> bool:
    """Whether a record decodes to an error: a timestamp above 2^63, or a clock sync that is too short."""
    if head is None:
        return True
    at = 12 if head[5] & 0x0F == 1 else 8
    too_large = bool(head[4] & decode.DTS_64) and head[at] >= 0x80
    return too_large or (head[1:3] == b"\xda\x7e" and payload is not None and len(payload) < 8)


_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.struct([("code", pa.string()), ("offset", pa.int64()), ("message", pa.string())]), pa.bool_()]
_NAMES = ["file_id", "file_offset", "head", "payload", "error", "broken"]


def raw_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def raw_rows(file: str, records: Iterable[tuple], broken: bool, with_payload: bool) -> Iterator[tuple]:
    """Rows of RAW; payloads of clock syncs are always kept, as they are decoded."""
    for at, head, payload, error in records:
        yield file, at, head, payload if with_payload or head and head[1:3] == b"\xda\x7e" else None, error, broken


def batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of RAW, some thousands together, whatever files they are of."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, 10_000)):
        yield raw_batch(some)


def raw_batches(file: str, records: Iterable[tuple], broken: bool, with_payload: bool) -> Iterator[pa.RecordBatch]:
    return batched(raw_rows(file, records, broken, with_payload))


def scan(contents: DataFrame, with_payload: bool = True) -> DataFrame:
    """Decoded records and error rows of (file_id, content); ``broken`` on every row tells whether its file has an error anywhere.

    For contents that are at hand; ``splits.scan_files`` reads files of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    data = zlib.decompress(data, wbits=31) if data[:2] == b"\x1f\x8b" else data
                except zlib.error as broken:
                    yield raw_batch([(name, 0, None, None, {"code": "bad_gzip", "offset": 0, "message": str(broken)}, True)])
                    continue
                records = list(walk(lambda at, size, data=data: data[at : at + size]))  # of a content that is in memory as a whole
                yield from raw_batches(name, records, any(is_broken(head, payload) for _, head, payload, _ in records), with_payload)

    return decoded(contents.select("file_id", "content").mapInArrow(run, RAW))


def decoded(raw: DataFrame) -> DataFrame:
    """The fields of each header. Unsigned 64-bit values from 2^63 on become an error ``dts_range``."""
    head, code = F.col("head"), F.col("format_code")
    rate_at = F.lit(8)
    own_rate = decode.rate_index(code) == 1
    dts_at = rate_at + F.when(own_rate, 4).otherwise(0)
    wide = decode.has(code, decode.DTS_64)
    extra_at = dts_at + F.when(wide, 8).otherwise(4)
    more = decode.has(code, decode.HAS_EXTRA)
    duration_at = extra_at + F.when(more, 4).otherwise(0)
    rows = raw.withColumn("format_code", decode.unsigned(head, 4, 2).cast("int")).withColumn("header_bytes", decode.header_length(code))
    rows = rows.select(
        "file_id", "file_offset", decode.unsigned(head, 1, 2).cast("int").alias("track_id"), "format_code", decode.unsigned(head, 6, 2).cast("int").alias("sequence"),
        F.when(wide, decode.unsigned(head, dts_at, 8)).otherwise(decode.unsigned(head, dts_at, 4)).alias("dts"),
        F.when(own_rate, decode.unsigned(head, rate_at, 4)).otherwise(decode.table_rate(code)).alias("clock_rate"),
        F.when(more, decode.unsigned(head, extra_at, 4)).alias("extra"), F.when(~decode.has(code, 0x40), decode.unsigned(head, duration_at, 4)).alias("duration"),
        decode.unsigned(head, F.col("header_bytes"), 4).alias("data_size"), "header_bytes", decode.has(code, decode.KEYFRAME).alias("keyframe"), decode.packet_position(code).alias("packet_position"), "payload", "error", "broken",
    )
    size, header, at = F.col("data_size"), F.col("header_bytes").cast("long"), F.col("file_offset")
    rows = rows.withColumn("data_offset", decode.data_offset(at, header)).withColumn("total_size", decode.total_size(at, header, size))
    short_sync = (F.col("track_id") == 0xDA7E) & F.col("payload").isNotNull() & (F.octet_length("payload") < 8)
    told = lambda code, text: F.struct(F.lit(code).alias("code"), at.alias("offset"), text.alias("message"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("dts").isNull(), told("dts_range", F.lit("timestamp above 2^63"))).when(short_sync, told("short_sync", F.concat(F.lit("clock sync at 0x"), F.lower(F.hex(at)), F.lit(" is too short"))))
    rows = rows.withColumn("error", error)
    sync = F.when(F.col("track_id") == 0xDA7E, decode.sync_ms(F.col("payload")))
    nanos = F.when(F.col("track_id") == 0xDA7E, decode.unsigned(F.col("payload"), 4, 4))
    return rows.withColumn("sync_ms", sync).withColumn("sync_nanos", nanos).withColumn("sc_dts", F.when(sync.isNotNull(), F.col("dts"))).withColumn("sc_rate", F.when(sync.isNotNull(), F.col("clock_rate")))


def errors(records: DataFrame) -> DataFrame:
    return records.where("error is not null").select("file_id", "error.*")


def with_policy(records: DataFrame, mode: str = "drop_file") -> DataFrame:
    """``drop_file``: no rows of a file with an error; ``keep_prefix``: its rows up to the error; ``failfast``: the job fails. Rows tell for themselves, so nothing is read twice."""
    if mode == "failfast":
        text = F.concat(F.col("file_id"), F.lit(": "), F.col("error.message"))
        return records.where(F.when(F.col("error").isNotNull(), F.raise_error(text).cast("boolean")).otherwise(True)).drop("error", "broken")
    if mode == "keep_prefix":
        return records.where("error is null").drop("error", "broken")
    return records.where("not broken").drop("error", "broken")


def encoded(track: Column, code: Column, sequence: Column, dts: Column, payload: Column) -> Column:
    """Bytes of a record at an aligned offset, with a 64-bit timestamp and a rate from the table; for round trips."""
    lead = F.concat(decode.big_endian(F.lit(decode.MAGIC), 1), decode.big_endian(track, 2))
    b = [decode.unsigned(lead, i, 1) for i in range(3)]
    check = decode.big_endian(b[0].bitwiseXOR(b[1]).bitwiseXOR(b[2]), 1)
    size = F.octet_length(payload).cast("long")
    header = decode.header_length(code).cast("long")
    pad = decode.padding(F.lit(0).cast("long"), header, size).cast("int")
    back = header + 4 + size + pad
    return F.concat(lead, check, decode.big_endian(code, 2), decode.big_endian(sequence, 2), decode.big_endian(dts, 8), decode.big_endian(size, 4), payload, F.unhex(F.repeat(F.lit("00"), pad)), decode.big_endian(back, 4))
