"""Multi-level transforms: plan builders over the long form, tile kernels over the block form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, lifting


def _outside(h: int, w: int) -> Column:
    return (F.col("y") >= h) | (F.col("x") >= w)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def forward_levels(df: DataFrame, height: int, width: int, levels: int, keys: list[str], kind: str = "5/3", y0: int = 0, x0: int = 0) -> DataFrame:
    """Long form.  Each level transforms the low-pass corner; its detail bands are done and leave.

    A level shuffles its corner only, once an axis, so all levels together move less than 2.7 times the plane.
    The union reads a level's exchange for its details and for the next level; it is made once.
    """
    dims = kernels.shapes(height, width, levels, y0, x0)
    names, done = [*keys, "y", "x", "v"], []
    df = df.select(*names)
    for (oy, ox, h, w), (_, _, low_h, low_w) in zip(dims, dims[1:], strict=False):
        if h and w:
            df = lifting.forward_level(df, keys, kind, oy, ox).select(*names)
            done.append(df.where(_outside(low_h, low_w)))
            df = df.where(~_outside(low_h, low_w))
    return _union([df, *done])


def inverse_levels(df: DataFrame, height: int, width: int, levels: int, keys: list[str], kind: str = "5/3", y0: int = 0, x0: int = 0, reduce: int = 0) -> DataFrame:
    """Long form, from the coarsest level up; a level joins its details to what is there, so it shuffles its corner only.

    What reduction leaves out is never read.
    """
    dims = kernels.shapes(height, width, levels, y0, x0)
    names = [*keys, "y", "x", "v"]
    source = df.select(*names)
    _, _, h, w = dims[levels]
    out = source.where(~_outside(h, w))
    for k in range(levels - 1, reduce - 1, -1):
        low_h, low_w = h, w
        oy, ox, h, w = dims[k]
        if h and w:
            details = source.where(~_outside(h, w) & _outside(low_h, low_w))
            out = lifting.inverse_level(out.union(details), keys, kind, oy, ox).select(*names)
    return out


def band_of(y: Column, x: Column, height: int, width: int, levels: int) -> Column:
    """``LL`` or kind and level of a packed place (level 1 is the finest)."""
    out = F.lit(f"LL{levels}")
    for k, (_, _, h, w) in list(enumerate(kernels.shapes(height, width, levels)))[::-1][:-1]:
        low_h, low_w = h, w
        inside = F.when((y < low_h) & (x < low_w), out).when(y < low_h, F.lit(f"HL{k}")).when(x < low_w, F.lit(f"LH{k}")).otherwise(F.lit(f"HH{k}"))
        out = inside
    return out


def transform_tiles(blocks: DataFrame, keys: list[str], levels: int, kind: str = "5/3", inverse: bool = False, reduce: int = 0) -> DataFrame:
    """Block form: ``keys..., y0, x0, h, w, samples``; each block by itself, at its own origin.

    No shuffle: rows are mapped where they are.
    """
    schema = blocks.schema
    real = kind == "9/7"

    def run(batches):
        for pdf in batches:
            made, hs, ws = [], [], []
            for y0, x0, h, w, samples in zip(pdf["y0"], pdf["x0"], pdf["h"], pdf["w"], pdf["samples"], strict=True):
                a = np.asarray(samples).reshape(h, w)
                b = kernels.synthesise(a, levels, kind, y0, x0, reduce) if inverse else kernels.analyse(a, levels, kind, y0, x0)
                made.append(b.ravel().astype(np.float32 if real else np.int64))
                hs.append(b.shape[0])
                ws.append(b.shape[1])
            yield pdf.assign(samples=pd.Series(made, index=pdf.index, dtype=object), h=hs, w=ws)

    out = ", ".join(f"`{f.name}` {'array<float>' if f.name == 'samples' and real else f.dataType.simpleString()}" for f in schema)
    return blocks.mapInPandas(run, out)


def region_windows(y0: int, x0: int, y1: int, x1: int, height: int, width: int, levels: int, kind: str = "5/3") -> list[tuple[int, int, int, int]]:
    """For each level (finest first) the low-pass and high-pass rows and columns that a region needs.

    Going down, a span needs its half plus the filter's reach: 2 samples a level for 5/3, 4 for 9/7.
    """
    reach = {"5/3": 2, "9/7": 4}[kind]
    out = []
    for _, _, h, w in kernels.shapes(height, width, levels)[1:]:
        y0, x0 = max(0, (y0 >> 1) - reach), max(0, (x0 >> 1) - reach)
        y1, x1 = min(h, ((y1 + 1) >> 1) + reach), min(w, ((x1 + 1) >> 1) + reach)
        out.append((y0, x0, y1, x1))
    return out


def decode_region(coefficients: DataFrame, height: int, width: int, levels: int, region: tuple[int, int, int, int], keys: list[str], kind: str = "5/3") -> DataFrame:
    """The samples of a region (y0, x0, y1, x1), from the coefficients it depends on and no others.

    At each level the low-pass part and the details of the level's window are put into a frame of the window's size, which
    is inverted like a small plane; what the frame's edges falsify lies outside the next window.  The filters stand
    on the coefficients themselves, so a scan gets them.
    """
    names = [*keys, "y", "x", "v"]
    dims, windows = kernels.shapes(height, width, levels), region_windows(*region, height, width, levels, kind)
    within = lambda c, lo, hi: (F.col(c) >= lo) & (F.col(c) < hi)
    y0, x0, y1, x1 = region if not levels else windows[-1]
    out = coefficients.where(within("y", y0, y1) & within("x", x0, x1)).select(*names)
    for k in range(levels, 0, -1):
        y0, x0, y1, x1 = windows[k - 1]
        (_, _, h, w), (_, _, ph, pw) = dims[k], dims[k - 1]
        high_y, high_x = (h + y0, h + min(y1, ph - h)), (w + x0, w + min(x1, pw - w))
        in_y, in_x = within("y", y0, y1), within("x", x0, x1)
        details = coefficients.where((in_y & within("x", *high_x)) | (within("y", *high_y) & in_x) | (within("y", *high_y) & within("x", *high_x))).select(*names)
        # packed places of the frame: its low-pass places first
        framed = lambda c, size, lo, hi: F.when(F.col(c) < size, F.col(c) - lo).otherwise(F.col(c) - size - lo + (hi - lo))
        low = out.withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)
        frame = low.union(details.withColumn("y", framed("y", h, y0, y1)).withColumn("x", framed("x", w, x0, x1)))
        made = lifting.inverse_level(frame, keys, kind)
        top, left, bottom, right = region if k == 1 else windows[k - 2]
        made = made.withColumn("y", F.col("y") + 2 * y0).withColumn("x", F.col("x") + 2 * x0).select(*names)
        out = made.where(within("y", top, bottom) & within("x", left, right))
    return out
