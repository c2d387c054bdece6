"""Decoding of binary record headers as Column expressions, and the encoding that the tests need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the low byte of a format code, and the clock rates by its low nibble (1: read from the record).
EXTENDED, KEYFRAME, HAS_CTS, RATE_PRESENT, DTS_64, HAS_EXTRA, PADDING = 0x80, 0x20, 0x10, 0x08, 0x04, 0x02, 0x01
CLOCK_RATES = (0, 0, 1000, 8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 90000, 1000000, 1000000000, 0)
# Positions of a packet by the two high bits of the high byte.
POSITIONS = ("Middle", "Last", "First", "Single")
MAGIC = 0xA0


def unsigned(data: Column, at: int | Column, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes from byte ``at`` (0-based); null where it does not fit a LONG."""
    at = at if isinstance(at, Column) else F.lit(at)
    piece = F.substring(data, at + 1, F.lit(size))
    number = F.conv(F.hex(piece), 16, 10)
    if size < 8:  # always fits
        return F.when(F.octet_length(piece) == size, number.cast("long"))
    wide = number.cast("decimal(20,0)")
    return F.when((F.octet_length(piece) == size) & (wide < F.lit(str(2**63)).cast("decimal(20,0)")), wide.cast("long"))


def high_byte(code: Column) -> Column:
    return F.shiftright(code.cast("int"), 8).bitwiseAND(0xFF)


def has(code: Column, mask: int) -> Column:
    """Whether a bit of the high byte is set."""
    return high_byte(code).bitwiseAND(mask) != 0


def packet_position(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POSITIONS)), F.shiftright(high_byte(code), 6) + 1)


def rate_index(code: Column) -> Column:
    return code.cast("int").bitwiseAND(0x0F)


def table_rate(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("long") for x in CLOCK_RATES)), rate_index(code) + 1)


def header_length(code: Column) -> Column:
    """Bytes before the payload size: the fixed part and each optional field."""
    part = lambda condition, size, other=0: F.when(condition, size).otherwise(other)
    return F.lit(8) + part(rate_index(code) == 1, 4) + part(has(code, DTS_64), 8, 4) + part(has(code, HAS_EXTRA), 4) + part(~has(code, 0x40), 4)


def magic_ok(data: Column) -> Column:
    return unsigned(data, 0, 1) == MAGIC


def checksum_ok(data: Column) -> Column:
    b = [unsigned(data, i, 1) for i in range(4)]
    return b[0].bitwiseXOR(b[1]).bitwiseXOR(b[2]) == b[3]


def padding(offset: Column, header: Column, size: Column) -> Column:
    return F.pmod(F.lit(4) - F.pmod(offset + header + 4 + size, F.lit(4)), F.lit(4))


def data_offset(offset: Column, header: Column) -> Column:
    return offset + header + 4


def total_size(offset: Column, header: Column, size: Column) -> Column:
    return header + 4 + size + padding(offset, header, size) + 4


def sync_ms(payload: Column) -> Column:
    """Wall clock of a clock-sync payload: seconds and nanoseconds; null where there are fewer than eight bytes."""
    return unsigned(payload, 0, 4) * 1000 + F.call_function("div", unsigned(payload, 4, 4), F.lit(1_000_000).cast("long"))


def big_endian(value: Column, size: int) -> Column:
    """The inverse of ``unsigned``."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))
