"""Tiles, subbands, code blocks and precincts as generated relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAND_KINDS = ("LL", "HL", "LH", "HH")


@dataclass(frozen=True)
class Grid:
    """Image area ``x0..x1, y0..y1`` and a tile partition from its own origin."""

    x0: int
    y0: int
    x1: int
    y1: int
    tile_w: int
    tile_h: int
    origin_x: int = 0
    origin_y: int = 0

    def __post_init__(self) -> None:
        for image, end, origin, size in ((self.x0, self.x1, self.origin_x, self.tile_w), (self.y0, self.y1, self.origin_y, self.tile_h)):
            if size <= 0 or end <= image or origin > image or origin + size <= image:
                raise ValueError("the grid does not cover the image")

    @property
    def columns(self) -> int:
        return -(-(self.x1 - self.origin_x) // self.tile_w) - (self.x0 - self.origin_x) // self.tile_w

    @property
    def rows(self) -> int:
        return -(-(self.y1 - self.origin_y) // self.tile_h) - (self.y0 - self.origin_y) // self.tile_h

    def tile_of(self, y: Column, x: Column) -> Column:
        col = F.expr("0") + F.floor((x - self.origin_x) / self.tile_w) - (self.x0 - self.origin_x) // self.tile_w
        row = F.floor((y - self.origin_y) / self.tile_h) - (self.y0 - self.origin_y) // self.tile_h
        return (row * self.columns + col).cast("bigint")


def tiles(spark: SparkSession, grid: Grid) -> DataFrame:
    """``tile_id, col, row, x0, y0, x1, y1, edge``, row-major, clipped to the image."""
    n = spark.range(grid.columns * grid.rows).select(F.col("id").alias("tile_id"), (F.col("id") % grid.columns).alias("col"), F.expr(f"id div {grid.columns}").alias("row"))

    def span(index: str, image: int, end: int, origin: int, size: int) -> tuple[Column, Column]:
        first = F.lit(origin) + (F.col(index) + (image - origin) // size) * size
        return F.greatest(first, F.lit(image)).cast("bigint"), F.least(first + size, F.lit(end)).cast("bigint")

    (x0, x1), (y0, y1) = span("col", grid.x0, grid.x1, grid.origin_x, grid.tile_w), span("row", grid.y0, grid.y1, grid.origin_y, grid.tile_h)
    edge = (F.col("col") == 0) | (F.col("row") == 0) | (F.col("col") == grid.columns - 1) | (F.col("row") == grid.rows - 1)
    return n.select("tile_id", "col", "row", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), edge.alias("edge"))


def _ceil_shift(v: Column, shift: Column) -> Column:
    """``ceil(v / 2**shift)``."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift.cast("int"))
    return F.call_function("shiftright", v + one - 1, shift.cast("int"))


def subbands(areas: DataFrame, levels: int, keys: list[str]) -> DataFrame:
    """Bands of each area (``keys..., x0, y0, x1, y1``): ``band_index, kind, level, x, y, w, h, origin_x, origin_y``.

    Always ``1 + 3 * levels`` bands, low-pass first, then from the coarsest level HL, LH, HH; empty ones stay.
    ``x, y`` is the place in the packed plane, the origin is the band's own.
    """
    kinds = [F.struct(F.lit(0).alias("band_index"), F.lit(0).alias("k"), F.lit(levels).alias("level"))]
    for level in range(levels, 0, -1):
        kinds += [F.struct(F.lit(1 + 3 * (levels - level) + k - 1).alias("band_index"), F.lit(k).alias("k"), F.lit(level).alias("level")) for k in (1, 2, 3)]
    bands = areas.select(*keys, "x0", "y0", "x1", "y1", F.explode(F.array(*kinds)).alias("b")).select("*", "b.*").drop("b")

    def axis(lo: str, hi: str, bit: int) -> tuple[Column, Column, Column]:
        """Packed place, size and origin along one axis."""
        level, high = F.col("level"), F.col("k").bitwiseAND(F.lit(bit)) != 0
        a, b = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
        low0, low1 = _ceil_shift(a, level), _ceil_shift(b, level)
        up0, up1 = _ceil_shift(a, level - 1), _ceil_shift(b, level - 1)
        high0, high1 = F.shiftright(up0, 1), F.shiftright(up1, 1)
        if levels == 0:
            return F.lit(0), b - a, a
        return F.when(high, low1 - low0).otherwise(0), F.when(high, high1 - high0).otherwise(low1 - low0), F.when(high, high0).otherwise(low0)

    (x, w, ox), (y, h, oy) = axis("x0", "x1", 1), axis("y0", "y1", 2)
    kind = F.element_at(F.array(*map(F.lit, BAND_KINDS)), F.col("k") + 1)
    made = {"x": x, "y": y, "w": w, "h": h, "origin_x": ox, "origin_y": oy}
    return bands.select(*keys, F.col("band_index").cast("bigint").alias("band_index"), kind.alias("kind"), F.col("level").cast("bigint").alias("level"), *[c.cast("bigint").alias(n) for n, c in made.items()])


def resolution_of(levels: int) -> Column:
    return F.when(F.col("kind") == "LL", 0).otherwise(F.lit(levels) - F.col("level") + 1).cast("bigint")


def code_blocks(bands: DataFrame, width: int, height: int, keys: list[str]) -> DataFrame:
    """Blocks of each band on the grid anchored at the band's global origin, in row-major order.

    Adds ``block_x, block_y`` (grid place) and the block's packed rectangle ``bx, by, bw, bh``.
    """
    some = bands.where((F.col("w") > 0) & (F.col("h") > 0))
    span = lambda o, n, size: F.sequence(F.expr(f"{o} div {size}"), F.expr(f"({o} + {n} - 1) div {size}"))
    grid = some.withColumn("block_y", F.explode(span("origin_y", "h", height))).withColumn("block_x", F.explode(span("origin_x", "w", width)))

    def clipped(index: str, origin: str, size: str, place: str, step: int) -> tuple[Column, Column]:
        first = F.greatest(F.col(index) * step, F.col(origin))
        return F.col(place) + first - F.col(origin), F.least((F.col(index) + 1) * step, F.col(origin) + F.col(size)) - first

    (bx, bw), (by, bh) = clipped("block_x", "origin_x", "w", "x", width), clipped("block_y", "origin_y", "h", "y", height)
    return grid.withColumns({"bx": bx, "by": by, "bw": bw, "bh": bh})


def effective_block(nominal: int, precinct: int, resolution: int) -> int:
    """Blocks are no larger than a precinct (half of it above the lowest resolution)."""
    return min(nominal, precinct if resolution == 0 else precinct // 2)


def resolutions(areas: DataFrame, levels: int, precincts: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Per area and resolution: region, precinct size, first precinct and counts; empty ones have none.

    ``precincts`` gives (width, height) from the lowest resolution on; the last entry holds for the rest.
    """
    rows = F.array(*[
        F.struct(F.lit(r).alias("resolution"), F.lit(levels - r).alias("d"), F.lit(precincts[min(r, len(precincts) - 1)][0]).alias("pw"), F.lit(precincts[min(r, len(precincts) - 1)][1]).alias("ph"))
        for r in range(levels + 1)
    ])
    base = areas.select(*keys, "x0", "y0", "x1", "y1", F.explode(rows).alias("r")).select("*", "r.*").drop("r")
    region = {f"r{c}": _ceil_shift(F.col(c).cast("bigint"), F.col("d")) for c in ("x0", "y0", "x1", "y1")}
    base = base.select(*keys, F.col("resolution").cast("bigint").alias("resolution"), F.col("d").cast("bigint").alias("d"), F.col("pw").cast("bigint").alias("pw"), F.col("ph").cast("bigint").alias("ph"), *[c.alias(n) for n, c in region.items()])
    some = (F.col("rx1") > F.col("rx0")) & (F.col("ry1") > F.col("ry0"))
    first = lambda lo, p: F.when(some, F.expr(f"{lo} div {p}")).otherwise(0)
    count = lambda lo, hi, p: F.when(some, F.expr(f"({hi} + {p} - 1) div {p} - {lo} div {p}")).otherwise(0)
    return base.withColumns({"px0": first("rx0", "pw"), "py0": first("ry0", "ph"), "pnx": count("rx0", "rx1", "pw"), "pny": count("ry0", "ry1", "ph")})


def precincts(plan: DataFrame) -> DataFrame:
    """One row a precinct: index, grid place and clipped rectangle (absolute, half-open)."""
    rows = plan.where("pnx > 0 and pny > 0").withColumn("precinct_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pnx") * F.col("pny") - 1)))
    rows = rows.withColumns({"precinct_x": F.col("px0") + F.col("precinct_index") % F.col("pnx"), "precinct_y": F.col("py0") + F.expr("precinct_index div pnx")})
    return rows.withColumns({
        "qx0": F.greatest("rx0", F.col("precinct_x") * F.col("pw")), "qy0": F.greatest("ry0", F.col("precinct_y") * F.col("ph")),
        "qx1": F.least("rx1", (F.col("precinct_x") + 1) * F.col("pw")), "qy1": F.least("ry1", (F.col("precinct_y") + 1) * F.col("ph")),
    })


def intersects(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Half-open rectangles ``x, y, w, h``; an empty one meets nothing."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    some = (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0)
    return some & (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def nominal_bit_planes(kind: Column, depth: int) -> Column:
    """Reversible path: bit depth, the band's gain, and one."""
    return (F.when(kind == "LL", 0).when(kind == "HH", 2).otherwise(1) + depth + 1).cast("bigint")
