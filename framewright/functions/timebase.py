"""Exact arithmetic on rational time bases: seconds a frame = num / den."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_A_SECOND = 1_000_000_000
NANOS_A_MILLI = 1_000_000


def div(a: Column, b: Column) -> Column:
    """Integer quotient, cut towards zero."""
    return F.call_function("div", a, b)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid's steps; two longs need 92 at most."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    turn = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, turn, lambda s: s["a"])


def reduced(num: Column, den: Column) -> Column:
    """struct<num, den> in lowest terms. 0 / 0 stays as it is."""
    common = F.greatest(gcd(num, den), F.lit(1).cast("long"))
    return F.struct(div(num.cast("long"), common).alias("num"), div(den.cast("long"), common).alias("den"))


def time_base_of_rate(rate_num: Column, rate_den: Column) -> Column:
    """Seconds a frame from frames a second, in lowest terms."""
    return reduced(rate_den, rate_num)


def duration(frames: Column, num: Column, den: Column) -> Column:
    """Seconds of so many frames, in lowest terms."""
    return reduced(frames.cast("long") * num, den)


def frame_of_nanos(nanos: Column, num: Column, den: Column) -> Column:
    """The frame nearest to a time, halves up: exact, for the time comes in whole nanoseconds."""
    wide = lambda c: c.cast("decimal(38,0)")
    unit = wide(num) * F.lit(NANOS_A_SECOND)
    return div(wide(nanos) * 2 * wide(den) + unit, unit * 2).cast("long")


def nanos_of_seconds(text: Column) -> Column:
    """Whole nanoseconds of a decimal number of seconds given as text; null if it is none."""
    return (text.try_cast("decimal(28,9)") * NANOS_A_SECOND).cast("decimal(38,0)").cast("long")


def seconds_of_frame(frame: Column, num: Column, den: Column) -> Column:
    return frame.cast("double") * num / den


def frame_of_seconds(seconds: Column, num: Column, den: Column) -> Column:
    """The frame nearest to a double, halves up."""
    return F.floor(seconds * den / num + 0.5).cast("long")


def seek_text(frame: Column, num: Column, den: Column) -> Column:
    """The middle of a frame in seconds with three decimals."""
    return F.format_string("%.3f", (frame + 0.5) * num / den)


def frame_millis(num: Column, den: Column) -> Column:
    return div(num.cast("long") * 1000, den.cast("long"))


def frame_nanos(num: Column, den: Column) -> Column:
    return div(num.cast("long") * NANOS_A_SECOND, den.cast("long"))


def millis_of_nanos(nanos: Column) -> Column:
    """Milliseconds, halves up."""
    return div(nanos + NANOS_A_MILLI // 2, F.lit(NANOS_A_MILLI).cast("long"))


def fraction(done: Column, total: Column) -> Column:
    """Progress from 0 to 1; 0 where the total isn't known."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), done.cast("double") / total)))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, cut; null where the total isn't known."""
    return F.when(total > 0, F.floor(fraction(done, total) * 100).cast("int"))


def frame_bytes(width: Column, height: Column, channels: Column) -> Column:
    return width.cast("long") * height * channels


def whole_or_double(x: Column) -> Column:
    """Text of a number as settings keep it: whole doubles without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))
