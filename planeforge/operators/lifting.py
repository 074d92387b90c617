"""Wavelet lifting along lines of a plane in long form, by windows.

A line is the rows that agree in ``lines``; ``axis`` is the 0-based place in it.  Missing neighbours are
mirrored.  ``origin`` is the line's absolute start: samples at even absolute places are low-pass.
Packed order is low before high.  The windows of one axis share one partitioning, so a pass costs one
exchange; planes with tile or image keys in ``lines`` spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rasters import f32

#: Lifting factors and scale of the 9/7 filter pair (fixed values).
ALPHA, BETA, GAMMA, DELTA, K = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001


def low_count(n: Column | int, origin: Column | int = 0) -> Column:
    """Samples at even absolute places in ``origin .. origin + n``."""
    n, o = (c if isinstance(c, Column) else F.lit(c) for c in (n, origin))
    return F.shiftright(o + n + 1, 1) - F.shiftright(o + 1, 1)


def packed_place(place: Column, n: Column | int, origin: int = 0) -> Column:
    at = place + origin
    low = F.shiftright(at, 1) - ((origin + 1) >> 1)
    high = low_count(n, origin) + F.shiftright(at - 1, 1) - (origin >> 1)
    return F.when(at % 2 == 0, low).otherwise(high).cast("bigint")


def interleaved_place(place: Column, n: Column | int, origin: int = 0) -> Column:
    lows = low_count(n, origin)
    low = (place + ((origin + 1) >> 1)) * 2 - origin
    high = (place - lows + (origin >> 1)) * 2 + 1 - origin
    return F.when(place < lows, low).otherwise(high).cast("bigint")


class _Line:
    """Windows of one axis, and the mirrored neighbours of a column."""

    def __init__(self, lines: list[str], axis: str):
        self.order = Window.partitionBy(*lines).orderBy(axis)
        self.whole = Window.partitionBy(*lines)

    def both(self, value: str) -> tuple[Column, Column]:
        before, after = F.lag(value).over(self.order), F.lead(value).over(self.order)
        return F.coalesce(before, after), F.coalesce(after, before)


def forward_53(df: DataFrame, axis: str, lines: list[str], value: str = "v", origin: int = 0) -> DataFrame:
    """Reversible 5/3; a line of one sample stays at an even origin and doubles at an odd one."""
    line, odd = _Line(lines, axis), (F.col(axis) + origin) % 2 == 1
    left, right = line.both(value)
    detail = F.when(~odd, F.col(value)).when(left.isNull(), F.col(value) * 2).otherwise(F.col(value) - F.shiftright(left + right, 1))
    step = df.withColumn("_n", F.count("*").over(line.whole)).withColumn("_d", detail)
    left, right = line.both("_d")
    smooth = F.when(odd | left.isNull(), F.col("_d")).otherwise(F.col("_d") + F.shiftright(left + right + 2, 2))
    return step.withColumn(value, smooth).withColumn(axis, packed_place(F.col(axis), F.col("_n"), origin)).drop("_n", "_d")


def fits32(v: Column) -> Column:
    return v.between(F.lit(-(1 << 31)), F.lit((1 << 31) - 1))


def _checked32(v: Column) -> Column:
    """The value, or an error where 32 bits cannot hold it; sums are 64-bit."""
    return F.when(fits32(v), v).otherwise(F.raise_error(F.concat(F.lit("5/3 inverse leaves 32 bits: "), v.cast("string"))).cast("bigint"))


def inverse_53(df: DataFrame, axis: str, lines: list[str], value: str = "v", origin: int = 0, checked: bool = False) -> DataFrame:
    """The inverse of ``forward_53``; ``checked``: a sample that leaves 32 bits at any step is an error."""
    sound = _checked32 if checked else (lambda v: v)
    line = _Line(lines, axis)
    step = df.withColumn("_n", F.count("*").over(line.whole)).withColumn(axis, interleaved_place(F.col(axis), F.col("_n"), origin))
    odd = (F.col(axis) + origin) % 2 == 1
    left, right = line.both(value)
    smooth = F.when(odd | left.isNull(), F.col(value)).otherwise(F.col(value) - F.shiftright(left + right + 2, 2))
    step = step.withColumn("_s", sound(smooth))
    left, right = line.both("_s")
    plain = F.when(~odd, F.col("_s")).when(left.isNull(), F.shiftright("_s", 1)).otherwise(F.col("_s") + F.shiftright(left + right, 1))
    return step.withColumn(value, sound(plain)).drop("_n", "_s")


def forward_53_float(df: DataFrame, axis: str, lines: list[str], value: str = "v") -> DataFrame:
    """The 5/3 line in single precision, as the simple container has it; origins are even."""
    line, odd = _Line(lines, axis), F.col(axis) % 2 == 1
    whole = lambda v: F.floor(v).cast("float")
    left, right = line.both(value)
    detail = F.when(~odd | left.isNull(), f32(F.col(value))).otherwise(f32(F.col(value)) - whole((left + right) / f32(2.0)))
    step = df.withColumn("_n", F.count("*").over(line.whole)).withColumn("_d", detail.cast("float"))
    left, right = line.both("_d")
    smooth = F.when(odd | left.isNull(), F.col("_d")).otherwise(F.col("_d") + whole((left + right + f32(2.0)) / f32(4.0)))
    return step.withColumn(value, smooth.cast("float")).withColumn(axis, packed_place(F.col(axis), F.col("_n"))).drop("_n", "_d")


def _lift(df: DataFrame, line: _Line, where: Column, factor: float, value: str) -> DataFrame:
    left, right = line.both(value)
    moved = F.col(value) + f32(factor) * (left + right)
    return df.withColumn(value, F.when(where & left.isNotNull(), moved).otherwise(F.col(value)))


def forward_97(df: DataFrame, axis: str, lines: list[str], value: str = "v", origin: int = 0) -> DataFrame:
    """Irreversible 9/7 in single precision; a line of one sample stays as it is."""
    line, odd = _Line(lines, axis), (F.col(axis) + origin) % 2 == 1
    step = df.withColumn(value, f32(F.col(value))).withColumn("_n", F.count("*").over(line.whole))
    for where, factor in ((odd, ALPHA), (~odd, BETA), (odd, GAMMA), (~odd, DELTA)):
        step = _lift(step, line, where, factor, value)
    scaled = F.when(F.col("_n") == 1, F.col(value)).when(odd, F.col(value) * f32(K)).otherwise(F.col(value) * (f32(1.0) / f32(K)).cast("float"))
    return step.withColumn(value, scaled).withColumn(axis, packed_place(F.col(axis), F.col("_n"), origin)).drop("_n")


def inverse_97(df: DataFrame, axis: str, lines: list[str], value: str = "v", origin: int = 0) -> DataFrame:
    line = _Line(lines, axis)
    step = df.withColumn(value, f32(F.col(value))).withColumn("_n", F.count("*").over(line.whole)).withColumn(axis, interleaved_place(F.col(axis), F.col("_n"), origin))
    odd = (F.col(axis) + origin) % 2 == 1
    scaled = F.when(F.col("_n") == 1, F.col(value)).when(odd, F.col(value) * (f32(1.0) / f32(K)).cast("float")).otherwise(F.col(value) * f32(K))
    step = step.withColumn(value, scaled)
    for where, factor in ((~odd, -DELTA), (odd, -GAMMA), (~odd, -BETA), (odd, -ALPHA)):
        step = _lift(step, line, where, factor, value)
    return step.drop("_n")


FORWARD = {"5/3": forward_53, "9/7": forward_97}
INVERSE = {"5/3": inverse_53, "9/7": inverse_97}


def forward_level(df: DataFrame, keys: list[str], kind: str = "5/3", y_origin: int = 0, x_origin: int = 0) -> DataFrame:
    """One 2D level: along y, then along x."""
    lift = FORWARD[kind]
    return lift(lift(df, "y", [*keys, "x"], origin=y_origin), "x", [*keys, "y"], origin=x_origin)


def inverse_level(df: DataFrame, keys: list[str], kind: str = "5/3", y_origin: int = 0, x_origin: int = 0, checked: bool = False) -> DataFrame:
    lift = INVERSE[kind]
    more = {"checked": True} if checked else {}
    return lift(lift(df, "x", [*keys, "y"], origin=x_origin, **more), "y", [*keys, "x"], origin=y_origin, **more)


def decomposes(x0: Column, y0: Column, x1: Column, y1: Column, levels: Column) -> Column:
    """Whether an area still has samples after so many levels; an area without any does not get more."""
    def left(lo: Column, hi: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("bigint"), levels.cast("int"))
        up = lambda v: F.call_function("shiftright", v.cast("bigint") + step - 1, levels.cast("int"))
        return up(hi) > up(lo)

    return left(x0, x1) & left(y0, y1)


def can_decompose(x0: int, y0: int, x1: int, y1: int, levels: int) -> bool:
    """False if the region becomes empty on the way down."""
    for _ in range(levels):
        x0, y0, x1, y1 = ((c + 1) >> 1 for c in (x0, y0, x1, y1))
        if x1 <= x0 or y1 <= y0:
            return False
    return True
