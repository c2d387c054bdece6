"""Length-prefixed units inside frame payloads: splitting, re-framing, concatenation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import tracks

START_CODE = b"\x00\x00\x00\x01"


def _units(payload: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(place of the data, data, complete); a unit that reaches past the end is given as far as it goes."""
    at = 0
    while at < len(payload):
        size = int.from_bytes(payload[at : at + 4], "big")
        data = payload[at + 4 : at + 4 + size]
        ok = len(payload) - at >= 4 and len(data) == size
        yield at + 4, data, ok
        if not ok:
            return
        at += 4 + size


def with_start_codes(payload: bytes, plain: bool) -> tuple[bytes, bool]:
    """The stream of a frame, and whether all its units are complete; a plain payload passes."""
    if plain:
        return payload, True
    found = list(_units(payload))
    return b"".join(START_CODE + unit for _, unit, ok in found if ok), all(ok for *_, ok in found)


def split_units(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, unit, at, data, ok: one row per unit, in order; Arrow batches in and out."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, places, pieces, oks = [], [], [], [], []
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                for i, (at, data, ok) in enumerate(_units(value.as_py() or b"")):
                    keys.append(k.as_py())
                    numbers.append(i)
                    places.append(at)
                    pieces.append(data)
                    oks.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(pieces, pa.binary()), pa.array(oks, pa.bool_())], names=[key, "unit", "at", "data", "ok"])

    return frames.select(key, payload).mapInArrow(run, f"{key} {kind}, unit int, at int, data binary, ok boolean")


class SplitUnits:
    """Table function: (unit, at, data, ok) of each payload, for SQL: ``FROM frames, LATERAL split_units(payload)``."""

    def eval(self, payload: bytes | None):
        for i, (at, data, ok) in enumerate(_units(bytes(payload or b""))):
            yield i, at, data, ok


def register_functions(spark: SparkSession) -> None:
    """Makes ``split_units`` known to SQL."""
    spark.udtf.register("split_units", F.udtf(SplitUnits, returnType="unit int, at int, data binary, ok boolean", useArrow=True))


def reframed(frames: DataFrame, key: str | list[str], is_plain: str, payload: str = "payload") -> DataFrame:
    """The columns of ``key``, stream, ok: length prefixes replaced by start codes; frames with ``is_plain`` pass unchanged.

    A unit that is cut short is left out, and ``ok`` is false, so that the loss can be told or the job failed (``complete``).
    So it is where the payload is null though ``data_size``, if the frames have it, is not 0: such a payload has not been read.
    """
    keys = [key] if isinstance(key, str) else list(key)
    schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, whole = [], []
            for value, plain, missing in zip(*(batch.column(len(keys) + i) for i in range(3)), strict=True):
                stream, ok = with_start_codes(value.as_py() or b"", plain.as_py())
                out.append(stream)
                whole.append(ok and not missing.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.binary()), pa.array(whole, pa.bool_())], names=[*keys, "stream", "ok"])

    missing = F.col(payload).isNull() & (F.col("data_size") > 0) if "data_size" in frames.columns else F.lit(False)
    return frames.select(*keys, payload, is_plain, missing).mapInArrow(run, f"{schema}, stream binary, ok boolean")


def kinds(frames: DataFrame, keys: list[str], order_by: str, payload: str = "payload") -> DataFrame:
    """keys, order_by, kind (video, audio), extension, stream, ok: what the streams of each kind are made of, frame by frame.

    Only the chosen video track (``video_track``) and audio; video units are re-framed, but for OBU video, whose bytes pass as audio's do.
    """
    return reframed(of_kinds(frames), [*keys, order_by, "kind", "extension"], "plain", payload)


def of_kinds(frames: DataFrame) -> DataFrame:
    """Adds kind, plain and the columns of the track to the frames of the chosen video track and of audio; others go."""
    rows = tracks.with_tracks(frames)
    audio = tracks.is_audio(F.col("track_id"))
    rows = rows.where(audio | (tracks.is_video(F.col("track_id")) & (F.col("track_id") == F.col("video_track"))))
    return rows.withColumn("kind", F.when(audio, F.lit("audio")).otherwise(F.lit("video"))).withColumn("plain", audio | F.coalesce("is_obu", F.lit(False)))


def complete(streams: DataFrame, key: str) -> DataFrame:
    """The rows of ``reframed``, failing the job at a unit that is cut short."""
    text = F.concat(F.lit("a unit of frame "), F.col(key).cast("string"), F.lit(" reaches past its end"))
    return streams.where(F.when(F.col("ok"), True).otherwise(F.raise_error(text).cast("boolean"))).drop("ok")


def elementary_streams(payloads: DataFrame, keys: list[str], order_by: str, payload: str = "payload") -> DataFrame:
    """keys, content: payloads in file order, joined. For groups that fit a row; ``stream_chunks`` has no such bound."""
    return payloads.groupBy(*keys).agg(F.expr(f"listagg({payload}) WITHIN GROUP (ORDER BY {order_by})").alias("content"))


def stream_chunks(payloads: DataFrame, keys: list[str], order_by: str, payload: str = "payload", chunk: int = 8 << 20) -> DataFrame:
    """keys, chunk, content: payloads in file order, joined to pieces of about ``chunk`` bytes, as they stream by; a group of any size needs the memory of one piece."""
    rows = payloads.select(*keys, order_by, payload).repartition(*keys).sortWithinPartitions(*keys, order_by)
    schema = ", ".join(f"{k} {payloads.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held, size, kinds = None, 0, [], 0, None

        def pack() -> pa.RecordBatch:
            columns = [pa.array([v], k) for v, k in zip(group, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([number], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=[*keys, "chunk", "content"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(width)]
            for *values, _, data in zip(*(batch.column(i).to_pylist() for i in range(width + 2)), strict=True):
                if group is not None and (values != group or size >= chunk):
                    yield pack()
                    number = number + 1 if values == group else 0
                    held, size = [], 0
                group = values
                held.append(data or b"")
                size += len(data or b"")
        if group is not None:
            yield pack()

    return rows.mapInArrow(run, f"{schema}, chunk int, content binary")


def first_rows(frames: DataFrame, keys: list[str], order_by: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits the groups before the shuffle."""
    return frames.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))).where(F.col("place") <= n)
