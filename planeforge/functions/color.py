"""Colour transforms and sample arithmetic as column expressions.

Integer paths shift arithmetically (floor), never divide.  Float paths stay in single precision, each
literal cast, operations in the written order, so that results do not depend on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rasters import f32

Triple = tuple[Column, Column, Column]


def level_shift(depth: int) -> int:
    if not 1 <= depth <= 16:
        raise ValueError("bit depth is not in 1..16")
    return 1 << (depth - 1)


def max_sample(depth: int) -> int:
    return 2 * level_shift(depth) - 1


def clamp(value: Column, depth: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(max_sample(depth)), value)).cast("bigint")


def clamp_float(value: Column, depth: int) -> Column:
    """Round half away from zero, clamp; NaN becomes 0."""
    rounded = F.when(value >= 0, F.floor(value + f32(0.5))).otherwise(F.ceil(value - f32(0.5)))
    return F.when(F.isnan(value), F.lit(0).cast("bigint")).otherwise(clamp(rounded, depth))


def in_range(value: Column, depth: int, name: str) -> Column:
    """The value, or an error: a sample outside its range is never passed on."""
    sound = value.between(0, max_sample(depth))
    return F.when(sound, value).otherwise(F.raise_error(F.lit(f"{name}: sample out of range")).cast("bigint"))


def rct(r: Column, g: Column, b: Column, depth: int = 8) -> Triple:
    return F.shiftright(r + g + g + b, 2) - level_shift(depth), b - g, r - g


def inverse_rct(y: Column, cb: Column, cr: Column, depth: int = 8, saturate: bool = False) -> Triple:
    g = y + level_shift(depth) - F.shiftright(cb + cr, 2)
    fit = (lambda v: clamp(v, depth)) if saturate else (lambda v: in_range(v, depth, "inverse RCT"))
    return fit(cr + g), fit(g), fit(cb + g)


def ict(r: Column, g: Column, b: Column, depth: int = 8) -> Triple:
    """Float, on level-shifted samples (coefficients are fixed values)."""
    r, g, b = (f32(c) - f32(level_shift(depth)) for c in (r, g, b))
    return (
        f32(0.299) * r + f32(0.587) * g + f32(0.114) * b,
        f32(-0.16875) * r + f32(-0.33126) * g + f32(0.5) * b,
        f32(0.5) * r - f32(0.41869) * g - f32(0.08131) * b,
    )


def inverse_ict(y: Column, cb: Column, cr: Column, depth: int = 8) -> Triple:
    up = f32(level_shift(depth))
    r = y + f32(1.402) * cr
    g = y - f32(0.34413) * cb - f32(0.71414) * cr
    b = y + f32(1.772) * cb
    return tuple(clamp_float(v + up, depth) for v in (r, g, b))


def shifted(v: Column, depth: int = 8) -> Column:
    """No component transform: the level shift alone."""
    return v - level_shift(depth)


def unshifted(v: Column, depth: int = 8, saturate: bool = False) -> Column:
    up = v + level_shift(depth)
    return clamp(up, depth) if saturate else in_range(up, depth, "level shift")


def sycc(y: Column, cb: Column, cr: Column, depth: int = 8) -> Triple:
    """Float products are truncated to integers before they are added."""
    cb, cr = (f32(c - level_shift(depth)) for c in (cb, cr))
    cut = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("bigint")
    return clamp(y + cut(f32(1.402) * cr), depth), clamp(y - cut(f32(0.344) * cb + f32(0.714) * cr), depth), clamp(y + cut(f32(1.772) * cb), depth)


def jfif(y: Column, cb: Column, cr: Column) -> Triple:
    """8-bit YCbCr in 16.16 fixed point."""
    cb, cr = cb - 128, cr - 128
    return (
        clamp(y + F.shiftright(cr * 91881 + 32768, 16), 8),
        clamp(y - F.shiftright(cb * 22554 + cr * 46802 + 32768, 16), 8),
        clamp(y + F.shiftright(cb * 116130 + 32768, 16), 8),
    )


def inverted(v: Column, depth: int = 8) -> Column:
    """White-is-zero to black-is-zero."""
    return F.lit(max_sample(depth)) - v


def bit_planes(v: Column) -> Column:
    """Bits that the magnitude needs."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v)))).cast("bigint")


def sign_extended(raw: Column, bits: int) -> Column:
    """Two's complement of ``bits`` bits as a signed number."""
    half = 1 << (bits - 1)
    return raw.bitwiseAND(F.lit(2 * half - 1)).bitwiseXOR(F.lit(half)) - half


def quantized(v: Column, step: float) -> Column:
    """``round(v / step)`` to a signed 16-bit number, single precision, half away from zero."""
    q = f32(v) / f32(step)
    away = F.when(q >= 0, F.floor(q + f32(0.5))).otherwise(F.ceil(q - f32(0.5)))
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), away)).cast("bigint")


def dead_zone(v: Column, step: Column) -> Column:
    """``sign(v) * floor(|v| / step)``."""
    return (F.signum(v) * F.floor(F.abs(v) / step)).cast("bigint")


def dead_zone_inverse(q: Column, step: Column, middle: float = 0.5) -> Column:
    return F.when(q == 0, F.lit(0.0)).otherwise((q + F.signum(q) * F.lit(middle)) * step)


def maxshift_inverse(v: Column, shift: int) -> Column:
    """Undo a region-of-interest shift: magnitudes of ``2**shift`` or more come back down."""
    return F.when(F.abs(v) >= (1 << shift), (F.signum(v) * F.shiftright(F.abs(v), shift)).cast("bigint")).otherwise(v)


def normalized(v: Column, black: float, white: float, depth: int) -> Column:
    """``(v - black) / (white - black)`` clamped to 0..1, scaled to the full range and rounded."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(black)) / F.lit(white - black)))
    return F.floor(unit * ((1 << depth) - 1) + 0.5).cast("bigint")


def half_to_sample(v: Column) -> Column:
    """A float in 0..1 to 16 bits; anything else is an error."""
    sound = ~F.isnan(v) & v.between(0.0, 1.0)
    return F.when(sound, F.floor(v.cast("double") * 65535.0 + 0.5).cast("bigint")).otherwise(F.raise_error(F.lit("sample is not in 0..1")).cast("bigint"))
