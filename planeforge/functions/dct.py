"""8x8 inverse DCT on block rows, and centred chroma upsampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``BASIS[place][frequency]``.
BASIS = np.array([[(math.sqrt(0.5) if f == 0 else 1.0) * math.cos((2 * p + 1) * f * math.pi / 16) for f in range(8)] for p in range(8)])


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """``n x 8 x 8`` dequantised coefficients to 8-bit samples."""
    sums = BASIS @ coefficients.astype(np.float64) @ BASIS.T
    return np.clip(np.floor(sums * 0.25 + 128.5 + 1e-9), 0, 255).astype(np.int64)


def inverse_blocks(blocks: DataFrame) -> DataFrame:
    """Block form in and out; whole Arrow batches of blocks in one product."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = inverse(np.stack([np.asarray(s) for s in pdf["samples"]]).reshape(-1, 8, 8)).reshape(-1, 64)
                yield pdf.assign(samples=pd.Series(list(out), index=pdf.index))

    return blocks.mapInPandas(run, blocks.schema)


def upsample_axis(df: DataFrame, axis: str, lines: list[str]) -> DataFrame:
    """Doubles a line; values are scaled by 4 (weights 1 and 3, edges repeat)."""
    order = Window.partitionBy(*lines).orderBy(axis)
    v = F.col("v")
    near = df.withColumns({"_b": F.coalesce(F.lag("v").over(order), v), "_a": F.coalesce(F.lead("v").over(order), v)})
    pair: Column = F.array(F.struct((F.col(axis) * 2).alias("p"), (F.col("_b") + v * 3).alias("w")), F.struct((F.col(axis) * 2 + 1).alias("p"), (v * 3 + F.col("_a")).alias("w")))
    return near.select(*lines, F.explode(pair).alias("s")).select(*lines, F.col("s.p").alias(axis), F.col("s.w").alias("v"))
