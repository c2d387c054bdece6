"""Bit tables of hashed 64-bit values, built by Spark and sent to all tasks; their size has a fixed bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeline.llm.shingles import U, mixed
from tapeline.llm.tasks import lean

#: 16 MB at most.
LEAST_BITS, MOST_BITS = 12, 27
PARTS = 64


def bits_for(n: int) -> int:
    """Bits of a table's index, so that at most a sixteenth of other values passes, up to the bound; beyond it more pass."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


def bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the cells of the one column of ``values``."""
    width = (1 << bits) // PARTS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(mixed(batch.column(0).to_numpy(zero_copy_only=False).view(U)) >> U(64 - bits)).astype(np.int64)
            part = found // width
            bounds = np.searchsorted(part, np.arange(PARTS + 1))
            some = np.flatnonzero(np.diff(bounds))
            packed = [(found[bounds[p] : bounds[p + 1]] - p * width).astype(np.uint32).tobytes() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["part", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tables.setdefault(part, np.zeros(width, bool))[np.frombuffer(found.as_buffer(), np.uint32)] = True
        for part, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["part", "cells"])

    schema, out = "part int, cells binary", np.zeros((PARTS, width // 8), np.uint8)
    for row in values.mapInArrow(lean(cells), schema).repartition("part").mapInArrow(lean(merge), schema).collect():  # 2^bits / 8 bytes at most
        out[row["part"]] = np.frombuffer(row["cells"], np.uint8)
    return out.reshape(-1)


def in_bits(table: np.ndarray, bits: int, hashed: np.ndarray) -> np.ndarray:
    """Which of the mixed hashes may be in the table."""
    cell = (hashed >> U(64 - bits)).astype(np.int64)
    return (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
