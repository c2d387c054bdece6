"""Masking of payloads for sharing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import tracks

#: Partition headers with more payload than this are masked.
LARGEST_PLAIN_HEADER = 32


def is_masked(track: Column, size: Column, keep_smart_events: bool = False) -> Column:
    always = tracks.is_media(track) | track.isin(tracks.JPEG, tracks.TALKBACK)
    smart = (track == tracks.SMART) & (not keep_smart_events)
    header = (track == tracks.HEADER) & (size > LARGEST_PLAIN_HEADER)
    return (size > 0) & (always | smart | header)


def masked_payload(payload: Column, mask: Column) -> Column:
    return F.when(mask, F.unhex(F.repeat(F.lit("00"), F.octet_length(payload)))).otherwise(payload)


def mask_totals(records: DataFrame, keys: list[str], keep_smart_events: bool = False) -> DataFrame:
    mask = is_masked(F.col("track_id"), F.col("data_size"), keep_smart_events)
    return records.groupBy(*keys).agg(F.count("*").alias("seen"), F.count_if(mask).alias("zeroed"), F.sum(F.when(mask, F.col("data_size")).otherwise(F.lit(0).cast("long"))).alias("bytes_zeroed"))


def zeroed_content(content: Column, spans: Column) -> Column:
    """``content`` with the spans (array<struct<start, size>> in order, bytes) set to zero: the piece before each span and its zeros, and what is left, joined once."""
    end = lambda i: F.when(i > 0, F.get(spans, i - 1)["start"] + F.get(spans, i - 1)["size"]).otherwise(F.lit(0).cast("long"))

    def piece(x: Column, i: Column) -> Column:
        kept = F.substring(content, (end(i) + 1).cast("int"), (x["start"] - end(i)).cast("int"))
        return F.concat(F.hex(kept), F.repeat(F.lit("00"), x["size"].cast("int")))

    rest = F.substring(content, (end(F.size(spans)) + 1).cast("int"), F.lit(2**31 - 1))
    return F.unhex(F.concat(F.array_join(F.transform(spans, piece), ""), F.hex(rest)))


def anonymised_name(path: Column) -> Column:
    """Name of the masked copy of a recording; null for one that is compressed already."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.ubv$", "")
    return F.when(~path.rlike(r"(?i)\.gz$"), F.concat(F.lit("anonymised-"), stem, F.lit(".ubv.gz")))
