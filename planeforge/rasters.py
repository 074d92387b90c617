"""Sample planes: the rasters derived from the tables, and the two physical forms of a plane.

*Long form* has one row a sample: ``keys..., y, x, v``.  *Block form* has one row a block:
``keys..., y0, x0, h, w, samples array`` in row-major order.  Long form suits expressions, windows
and SQL; block form suits whole-tile kernels, one shuffle and one Arrow batch for a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the rasters that are derived from ``events`` and ``embeddings``.
RGB_WIDTH = 100
PLANE_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rgb_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, x, r, g, b`` (bigint, 8-bit samples), 100 wide, a row of ``events`` a pixel."""
    k = F.floor(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {RGB_WIDTH}").alias("y"),
        F.expr(f"event_id % {RGB_WIDTH}").alias("x"),
        F.pmod(k, F.lit(256)).alias("r"),
        F.pmod(F.shiftright(k, 8), F.lit(256)).alias("g"),
        F.pmod("user_id", F.lit(256)).alias("b"),
    )


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, x, v`` (bigint), 64 wide: ``floor(component * 128)``."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select("y", F.col("x").cast("bigint").alias("x"), F.floor(F.col("e").cast("double") * 128).cast("bigint").alias("v"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``index, c0, c1, c2``: 200 entries from ``part``."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").where(key < 200).select(
        key.alias("index"), (size * 5).alias("c0"), F.pmod(key * 7 + size, F.lit(256)).alias("c1"), F.pmod(key, F.lit(256)).alias("c2")
    )


def block_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_id, pass_index, bytes, cum_bytes, distortion``: coding passes from ``lineitem``."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    size = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block_id"),
        F.row_number().over(order).cast("bigint").alias("pass_index"),
        size.alias("bytes"),
        F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_bytes"),
        F.col("l_extendedprice").alias("distortion"),
    )


def to_planes(rgb: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot pixels into ``keys..., component, y, x, v``."""
    parts = F.array(*[F.struct(F.lit(k).cast("bigint").alias("component"), F.col(c).alias("v")) for k, c in enumerate(channels)])
    return rgb.select(*keys, "y", "x", F.explode(parts).alias("s")).select(*keys, "s.component", "y", "x", "s.v")


def to_pixels(planes: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Pivot ``component, y, x, v`` into one row a pixel; a pixel without a component has null there."""
    return planes.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("component") == k, F.col("v"))).alias(c) for k, c in enumerate(channels)])


def to_blocks(planes: DataFrame, height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long form to block form; blocks are those of a grid at the origin."""
    by = [*keys, (F.expr(f"y div {height}") * height).alias("y0"), (F.expr(f"x div {width}") * width).alias("x0")]
    grouped = planes.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("x") - F.min("x") + 1).alias("w"),
    )
    return grouped.select(*keys, "y0", "x0", "h", "w", F.transform("s", lambda s: s["v"]).alias("samples"))


def to_samples(blocks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Block form to long form."""
    rows = blocks.select(*keys, "y0", "x0", "w", F.posexplode("samples").alias("i", "v"))
    return rows.select(*keys, (F.col("y0") + F.expr("i div w")).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), "v")


def bench_raster(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Deterministic RGB test raster, made on the executors."""
    n = spark.range(width * height).select(F.expr(f"id div {width}").alias("y"), F.expr(f"id % {width}").alias("x"))
    r = F.expr(f"x * 255 div {max(1, width - 1)}")
    g = F.expr(f"y * 255 div {max(1, height - 1)}").bitwiseXOR(F.pmod(F.col("x") * 17 + F.col("y") * 31, F.lit(64)))
    return n.select("y", "x", r.alias("r"), g.alias("g"), (F.lit(255) - r).alias("b"))


def f32(value: float | Column) -> Column:
    """A single-precision literal or column."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def signed_ramp(spark: SparkSession, width: int, height: int, precision: int = 12) -> DataFrame:
    """A signed test plane that rises evenly through the whole range of its precision and ends at the top of it."""
    count, half = width * height, 1 << (precision - 1)
    rise = F.expr(f"id * {2 * half}L div {count}") - half
    v = F.when(F.col("id") == count - 1, F.lit(half - 1)).otherwise(rise).cast("bigint")
    return spark.range(count).select(F.expr(f"id div {width}").alias("y"), F.expr(f"id % {width}").alias("x"), v.alias("v"))
