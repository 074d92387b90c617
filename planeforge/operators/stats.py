"""Statistics of planes and blocks, error measures, coverage, pyramids and digests."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import bit_planes

#: L2 norms of the 5/3 synthesis, by orientation and level (fixed values).
NORMS_53 = {
    "LL": (1.000, 1.500, 2.750, 5.375, 10.68, 21.34, 42.67, 85.33, 170.7, 341.3),
    "HL": (1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9),
    "LH": (1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9),
    "HH": (0.7186, 0.9218, 1.586, 3.043, 6.019, 12.01, 24.00, 47.97, 95.93),
}


def block_stats(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Non-zero count, largest magnitude, its bit planes, and the box of non-zero places (null if none)."""
    some = F.col("v") != 0
    within = lambda f, c: f(F.when(some, F.col(c)))
    found = coefficients.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(some).alias("non_zero"), F.max(F.abs("v")).alias("max_magnitude"),
        within(F.min, "x").alias("min_x"), within(F.max, "x").alias("max_x"), within(F.min, "y").alias("min_y"), within(F.max, "y").alias("max_y"),
    )
    return found.withColumn("bitplanes", bit_planes(F.col("max_magnitude")))


def energy(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    return coefficients.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("sum_v"), F.sum(F.col("v") * F.col("v")).alias("sum_v2"))


def error(a: DataFrame, b: DataFrame, keys: list[str], depth: int = 8) -> DataFrame:
    """Peak error, summed squares, count of differing samples, MSE and PSNR (null if equal)."""
    d = F.col("v") - F.col("_w")
    both = a.join(b.select(*keys, F.col("v").alias("_w")), keys)
    found = both.agg(F.count("*").alias("n"), F.coalesce(F.max(F.abs(d)), F.lit(0)).alias("peak"), F.coalesce(F.sum(d * d), F.lit(0)).alias("sse"), F.count_if(d != 0).alias("differing"))
    mse = F.col("sse") / F.col("n")
    top = float((1 << depth) - 1)
    return found.withColumn("mse", mse).withColumn("psnr", F.when(F.col("sse") > 0, F.lit(10.0) * F.log10(F.lit(top * top) / mse)))


def timings(rows: DataFrame, stage: str, time: str) -> DataFrame:
    """``stage, runs, total, least, most, permille``: each stage's times and its share of all (rounded down)."""
    per = rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("runs"), F.sum(time).alias("total"), F.min(time).alias("least"), F.max(time).alias("most"))
    return per.withColumn("permille", F.expr("total * 1000 div sum(total) over ()"))


def coverage(samples: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """One row: places covered once, several times, and never."""
    per = samples.groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("more"), (F.lit(height * width) - F.count("*")).alias("never"))


def band_weight(kind: Column, level: Column) -> Column:
    """Squared synthesis norm of a band, from the fixed table as literals."""
    out = F.lit(None).cast("double")
    for name, norms in NORMS_53.items():
        at = F.least(level if name == "LL" else level - 1, F.lit(len(norms) - 1)).cast("int")
        norm = F.get(F.array(*map(F.lit, norms)), at)
        out = F.when(kind == name, norm * norm).otherwise(out)
    return out


def pyramid(leaves: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Tag-tree values: each level holds the minimum of 2x2 below; level 0 are the leaves."""
    levels, h, w, n = [leaves.select(*keys, F.lit(0).cast("bigint").alias("level"), "y", "x", "v")], height, width, 0
    while h > 1 or w > 1:
        n, h, w = n + 1, (h + 1) // 2, (w + 1) // 2
        # each level from the leaves: no chain of stages, partial aggregation reduces before the exchange
        by = [*keys, F.shiftright("y", n).alias("y"), F.shiftright("x", n).alias("x")]
        levels.append(leaves.groupBy(*by).agg(F.min("v").alias("v")).select(*keys, F.lit(n).cast("bigint").alias("level"), "y", "x", "v"))
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def neighbours(plane: DataFrame, lines: list[str]) -> DataFrame:
    """Adds the significance (0/1 of ``s``) around each sample: ``h`` (0..2), ``ve`` (0..2), ``di`` (0..4).

    Two windows: along the row, then up and down over the row's sums; outside counts as 0.
    """
    row, col = Window.partitionBy(*lines, "y").orderBy("x"), Window.partitionBy(*lines, "x").orderBy("y")
    near = lambda c, w: F.lag(c, 1, 0).over(w) + F.lead(c, 1, 0).over(w)
    step = plane.withColumn("h", near("s", row))
    return step.withColumn("ve", near("s", col)).withColumn("di", near("h", col))


def zero_context(kind: str) -> Column:
    """Zero-coding context 0..8 of a band kind from neighbour counts ``h, ve, di``."""
    h, v, d = F.col("h"), F.col("ve"), F.col("di")
    if kind == "HH":
        s = h + v
        return F.when(d >= 3, 8).when(d == 2, F.when(s >= 1, 7).otherwise(6)).when(d == 1, F.when(s >= 2, 5).when(s == 1, 4).otherwise(3)).otherwise(F.least(s, F.lit(2)))
    if kind == "HL":
        h, v = v, h
    return (
        F.when(h == 2, 8)
        .when(h == 1, F.when(v >= 1, 7).when(d >= 1, 6).otherwise(5))
        .when(v == 2, 4)
        .when(v == 1, 3)
        .otherwise(F.least(d, F.lit(2)))
    )


def sign_context(h: Column, v: Column) -> tuple[Column, Column]:
    """Sign-coding context 9..13 and predicted bit, from contributions clamped to -1..1."""
    flip = (h < 0) | ((h == 0) & (v < 0))
    a, b = F.when(flip, -h).otherwise(h), F.when(flip, -v).otherwise(v)
    context = F.when(a == 1, b + 12).otherwise(b + 9)
    return context.cast("bigint"), flip.cast("bigint")


def plane_sha256(planes: DataFrame, keys: list[str], sample_bytes: int = 2) -> DataFrame:
    """Digest of each plane: size header, then big-endian samples in row-major order.

    A digest is sequential, so a plane meets in one group; what meets there are bytes, one binary a row,
    and a plane of up to 2 GB of samples fits.
    """
    schema = planes.select(*keys).schema
    rows = planes.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s"))
    low, high = -(1 << (8 * sample_bytes - 1)), (1 << (8 * sample_bytes - 1)) - 1
    out = F.exists("s", lambda s: ~s["v"].between(low, high))
    hexed = F.array_join(F.transform("s", lambda s: F.substring(F.lpad(F.hex(s["v"]), 16, "0"), 17 - 2 * sample_bytes, 2 * sample_bytes)), "")
    data = F.when(out, F.raise_error(F.lit("sample out of range")).cast("binary")).otherwise(F.unhex(hexed))
    rows = rows.select(*keys, "y", F.size("s").alias("n"), data.alias("data"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        digest = hashlib.sha256(struct.pack(">II", table.num_rows, table["n"][0].as_py()))
        for chunk in table["data"].chunks:
            for value in chunk:
                digest.update(value.as_buffer())
        first = table.select(keys).slice(0, 1)
        return first.append_column("sha256", pa.array([digest.hexdigest()]))

    made = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["sha256 string"])
    return rows.groupBy(*keys).applyInArrow(run, made)
