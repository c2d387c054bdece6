"""Clock arithmetic as Column expressions: ticks, wall clocks, timecodes, durations.

Everything is LONG arithmetic with quotient and remainder, so that no product overflows; a zero rate gives null unless told
otherwise. ``div`` on a zero divisor is an error under ANSI mode, so divisors pass through ``nullif``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def nonzero(rate: Column) -> Column:
    return F.nullif(rate.cast("long"), F.lit(0).cast("long"))


def scaled(x: Column, rate: Column, base: Column) -> Column:
    """x * rate / base, half up, without the product: whole units and the rest apart."""
    base = nonzero(base)
    return _div(x, base) * rate + _div((x % base) * rate + _div(base, F.lit(2)), base)


def wall_clock(dts: Column, rate: Column, sc_dts: Column, sc_rate: Column, wc_ms: Column) -> Column:
    """Wall clock of a frame in its own ticks: both clock readings are scaled and rounded by themselves; 0 at least."""
    rate = rate.cast("long")
    return F.greatest(dts + scaled(wc_ms, rate, F.lit(1000).cast("long")) - scaled(sc_dts, rate, sc_rate), F.lit(0).cast("long"))


def ticks_to_ms(ticks: Column, rate: Column) -> Column:
    return scaled(ticks.cast("long"), F.lit(1000).cast("long"), rate)


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def frame_in_second(ms: Column, fps: Column) -> Column:
    """1-based number of the frame within its second, rounded half up."""
    rest = F.pmod(ms, F.lit(1000).cast("long"))
    return F.least(_div(rest * fps + 500, F.lit(1000).cast("long")) + 1, fps.cast("long"))


def timecode(ms: Column, fps: Column) -> Column:
    """HH:MM:SS:FF; the rate is rounded and at least 1."""
    whole = F.greatest(F.floor(fps.cast("double") + 0.5).cast("long"), F.lit(1).cast("long"))
    return F.concat(F.date_format(F.timestamp_millis(ms), "HH:mm:ss"), F.format_string(":%02d", frame_in_second(ms, whole)))


def timecode_with_base(ms: Column, fps: Column) -> Column:
    """``Y-m-d H:M:S:FF@fps``; without a rate the plain time, without a time ``-``."""
    plain = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    rated = F.concat(plain, F.format_string(":%02d@%d", frame_in_second(ms, fps), fps.cast("long")))
    return F.when(ms.isNull(), F.lit("-")).when(fps > 0, rated).otherwise(plain)


def duration(ms: Column) -> Column:
    """HH:MM:SS.mmm with as many hour digits as it takes."""
    second, minute, hour = (F.lit(x).cast("long") for x in (1000, 60_000, 3_600_000))
    return F.format_string("%02d:%02d:%02d.%03d", _div(ms, hour), _div(ms % hour, minute), _div(ms % minute, second), ms % second)


def ticks_to_us(ticks: Column, rate: Column) -> Column:
    """Microseconds, rounded down; a zero rate sorts behind everything."""
    base, million = nonzero(rate), F.lit(1_000_000).cast("long")
    return F.coalesce(_div(ticks, base) * million + _div((ticks % base) * million, base), F.lit(2**63 - 1).cast("long"))


def rebased(ticks: Column, first: Column, base: Column, rate: int = 90_000) -> Column:
    """Ticks since the first one, moved from ``base`` to ``rate`` ticks a second; 0 at least."""
    delta = F.greatest(ticks - first, F.lit(0).cast("long"))
    return _div(delta, nonzero(base)) * rate + _div((delta % nonzero(base)) * rate, nonzero(base))


def least_known(*values: Column) -> Column:
    return F.least(*values)


def greatest_known(*values: Column) -> Column:
    return F.greatest(*values)


#: Largest value of a signed 32-bit field.
MAX32 = 2**31 - 1


def reduced_timescale(max_dts: Column, rate: Column) -> Column:
    """A timescale in which ``max_dts`` fits 32 bits with 5 % to spare; null where the rate is 0 or nothing need be done."""
    top = F.lit(MAX32).cast("long")
    rate = rate.cast("long")
    fitting = _div(_div(top * rate, nonzero(max_dts)) * 95, F.lit(100).cast("long"))
    return F.when((rate != 0) & (max_dts > top), F.least(F.greatest(fitting, F.lit(1).cast("long")), rate))
