"""Tiles, subbands, code blocks, precincts, packet orders and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, progression
from ..rasters import embedding_plane, rgb_events, to_planes
from .registry import PLANE, RGB, ints, query

GRID = geometry.Grid(5, 3, 137, 99, 32, 24, 1, 2)
_TILES = """tiles AS (SELECT CAST(r * 5 + c AS BIGINT) AS tile_id, CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS "row", CAST(greatest(5, 1 + c * 32) AS BIGINT) AS x0, CAST(greatest(3, 2 + r * 24) AS BIGINT) AS y0,
  CAST(least(137, 1 + (c + 1) * 32) AS BIGINT) AS x1, CAST(least(99, 2 + (r + 1) * 24) AS BIGINT) AS y1 FROM range(0, 5) t(c), range(0, 5) u(r))"""


@query("tile_grid", f"WITH {_TILES} SELECT *, (col IN (0, 4) OR \"row\" IN (0, 4)) AS edge FROM tiles")
def tile_grid(spark, d):
    return geometry.tiles(spark, GRID).select(*ints(tile_id="tile_id", col="col", row="row", x0="x0", y0="y0", x1="x1", y1="y1"), "edge")


@query("edge_tiles", f"WITH {_TILES} SELECT tile_id, x1 - x0 AS w, y1 - y0 AS h FROM tiles WHERE col IN (0, 4) OR \"row\" IN (0, 4)")
def edge_tiles(spark, d):
    return geometry.tiles(spark, GRID).where("edge").select(*ints(tile_id="tile_id", w=F.col("x1") - F.col("x0"), h=F.col("y1") - F.col("y0")))


@query("tile_counts", "SELECT CAST(w AS BIGINT) AS w, CAST((200 + w - 1) // w AS BIGINT) AS cols, CAST((120 + w - 1) // w AS BIGINT) AS \"rows\", w >= 200 AS single FROM (SELECT unnest([16, 33, 64, 100, 200, 256]) AS w)")
def tile_counts(spark, d):
    rows = []
    for w in (16, 33, 64, 100, 200, 256):
        grid = geometry.Grid(0, 0, 200, 120, w, w)
        rows.append((w, grid.columns, grid.rows, grid.columns * grid.rows == 1))
    return spark.createDataFrame(rows, "w bigint, cols bigint, rows bigint, single boolean")


@query("tile_stats", f"WITH {RGB} SELECT (y // 32) * 4 + x // 32 AS tile_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS sum_r, min(g) AS min_g, max(b) AS max_b FROM rgb GROUP BY ALL")
def tile_stats(spark, d):
    tile = F.expr("(y div 32) * 4 + x div 32")
    return rgb_events(spark, d).groupBy(tile.alias("tile_id")).agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.min("g").alias("min_g"), F.max("b").alias("max_b"))


@query("tile_select", f"WITH {RGB} SELECT y, x, r, g, b FROM rgb WHERE y // 32 = 1 AND x // 32 = 2")
def tile_select(spark, d):
    """One tile: the index becomes bounds, so the filter is a range on the pixel's own columns."""
    return rgb_events(spark, d).where("y >= 32 and y < 64 and x >= 64 and x < 96").select("y", "x", "r", "g", "b")


@query("tile_paste", f"WITH {RGB} SELECT y, x, r, g, b FROM rgb")
def tile_paste(spark, d):
    """Tiles taken apart to their own coordinates and put together again."""
    apart = rgb_events(spark, d).select(F.expr("y div 32").alias("ty"), F.expr("x div 32").alias("tx"), (F.col("y") % 32).alias("ly"), (F.col("x") % 32).alias("lx"), "r", "g", "b")
    parts = [apart.where(F.col("tx") == k) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.select(*ints(y=F.col("ty") * 32 + F.col("ly"), x=F.col("tx") * 32 + F.col("lx"), r="r", g="g", b="b"))


@query("region_crop", f"WITH {RGB} SELECT y - 7 AS y, x - 11 AS x, r, g, b FROM rgb WHERE y >= 7 AND y < 40 AND x >= 11 AND x < 73")
def region_crop(spark, d):
    return rgb_events(spark, d).where("y >= 7 and y < 40 and x >= 11 and x < 73").select(*ints(y=F.col("y") - 7, x=F.col("x") - 11, r="r", g="g", b="b"))


@query("component_select", f"WITH {RGB} SELECT y, x, g AS v FROM rgb")
def component_select(spark, d):
    return to_planes(rgb_events(spark, d)).where("component = 1").select("y", "x", "v")


@query("region_tiles", f"WITH {_TILES} SELECT tile_id FROM tiles WHERE x0 < 70 AND x1 > 30 AND y0 < 60 AND y1 > 50")
def region_tiles(spark, d):
    """Tiles that a region touches: the pruning set of a region read."""
    box = tuple(F.lit(v) for v in (30, 50, 40, 10))
    tile = (F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return geometry.tiles(spark, GRID).where(geometry.intersects(tile, box)).select("tile_id")


LEVELS = 3
_UP = "((v + (1 << {0}) - 1) >> {0})"


def _cd(v: str, s: str) -> str:
    return f"(({v} + (1 << {s}) - 1) >> {s})"


def _axis(a: str, b: str, high: str) -> list[str]:
    low0, low1 = _cd(a, "l"), _cd(b, "l")
    up0, up1 = _cd(a, "(l - 1)"), _cd(b, "(l - 1)")
    return [f"CASE WHEN {high} THEN {low1} - {low0} ELSE 0 END", f"CASE WHEN {high} THEN ({up1} >> 1) - ({up0} >> 1) ELSE {low1} - {low0} END", f"CASE WHEN {high} THEN {up0} >> 1 ELSE {low0} END"]


def _bands(levels: int) -> str:
    x, y = (_axis(*p) for p in (("x0", "x1", "k IN (1, 3)"), ("y0", "y1", "k IN (2, 3)")))
    return f"""kinds AS (SELECT 0 AS band_index, 0 AS k, {levels} AS l UNION ALL SELECT 1 + 3 * ({levels} - l) + k - 1, k, l FROM range(1, {levels + 1}) t(l), range(1, 4) u(k)),
bands AS (SELECT tile_id, CAST(band_index AS BIGINT) AS band_index, ['LL', 'HL', 'LH', 'HH'][k + 1] AS kind, CAST(l AS BIGINT) AS level, CAST({x[0]} AS BIGINT) AS x, CAST({y[0]} AS BIGINT) AS y, CAST({x[1]} AS BIGINT) AS w, CAST({y[1]} AS BIGINT) AS h,
  CAST({x[2]} AS BIGINT) AS origin_x, CAST({y[2]} AS BIGINT) AS origin_y FROM tiles, kinds)"""


@query("subbands", f"WITH {_TILES}, {_bands(LEVELS)} SELECT * FROM bands")
def subbands(spark, d):
    return geometry.subbands(geometry.tiles(spark, GRID), LEVELS, ["tile_id"])


_BLOCKS = f"""blocks AS (SELECT tile_id, band_index, CAST(j AS BIGINT) AS block_y, CAST(i AS BIGINT) AS block_x, x + greatest(i * 8, origin_x) - origin_x AS bx, y + greatest(j * 4, origin_y) - origin_y AS "by",
  least((i + 1) * 8, origin_x + w) - greatest(i * 8, origin_x) AS bw, least((j + 1) * 4, origin_y + h) - greatest(j * 4, origin_y) AS bh
  FROM bands, range(0, 40) t(i), range(0, 40) u(j) WHERE w > 0 AND h > 0 AND (i + 1) * 8 > origin_x AND i * 8 < origin_x + w AND (j + 1) * 4 > origin_y AND j * 4 < origin_y + h)"""


@query("code_blocks", f"WITH {_TILES}, {_bands(LEVELS)}, {_BLOCKS} SELECT * FROM blocks")
def code_blocks(spark, d):
    bands = geometry.subbands(geometry.tiles(spark, GRID), LEVELS, ["tile_id"])
    return geometry.code_blocks(bands, 8, 4, ["tile_id"]).select(*ints(tile_id="tile_id", band_index="band_index", block_y="block_y", block_x="block_x", bx="bx", by="by", bw="bw", bh="bh"))


@query(
    "block_coverage",
    f"WITH {_TILES}, {_bands(LEVELS)}, {_BLOCKS} SELECT t.tile_id, (x1 - x0) * (y1 - y0) AS area, CAST(s AS BIGINT) AS covered FROM tiles t JOIN (SELECT tile_id, sum(bw * bh) AS s FROM blocks GROUP BY 1) USING (tile_id)",
)
def block_coverage(spark, d):
    """Blocks of a tile cover its packed plane exactly: areas agree (and each block's box is disjoint by the grid)."""
    tiles = geometry.tiles(spark, GRID)
    blocks = geometry.code_blocks(geometry.subbands(tiles, LEVELS, ["tile_id"]), 8, 4, ["tile_id"])
    covered = blocks.groupBy("tile_id").agg(F.sum(F.col("bw") * F.col("bh")).cast("bigint").alias("covered"))
    return tiles.select("tile_id", *ints(area=(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).join(covered, "tile_id")


@query("nominal_bitplanes", "SELECT unnest(['LL', 'HL', 'LH', 'HH']) AS kind, CAST(unnest([9, 10, 10, 11]) AS BIGINT) AS planes")
def nominal_bitplanes(spark, d):
    return spark.createDataFrame([(k,) for k in geometry.BAND_KINDS], "kind string").select("kind", geometry.nominal_bit_planes(F.col("kind"), 8).alias("planes"))


@query("effective_blocks", "SELECT CAST(r AS BIGINT) AS resolution, CAST(least(64, CASE WHEN r = 0 THEN p ELSE p // 2 END) AS BIGINT) AS w FROM (SELECT r, [32, 64, 128, 256][r + 1] AS p FROM range(0, 4) t(r))")
def effective_blocks(spark, d):
    return spark.createDataFrame([(r, geometry.effective_block(64, p, r)) for r, p in enumerate((32, 64, 128, 256))], "resolution bigint, w bigint")


PRECINCTS = [(8, 8), (16, 8), (16, 16)]
_PLAN = f"""res AS (SELECT tile_id, CAST(r AS BIGINT) AS resolution, CAST({LEVELS} - r AS BIGINT) AS d, CAST([8, 16, 16, 16][r + 1] AS BIGINT) AS pw, CAST([8, 8, 16, 16][r + 1] AS BIGINT) AS ph, {", ".join(_cd(c, f"({LEVELS} - r)") + f" AS r{c}" for c in ("x0", "y0", "x1", "y1"))} FROM tiles, range(0, {LEVELS + 1}) t(r)),
plan AS (SELECT *, rx0 // pw AS px0, ry0 // ph AS py0, CASE WHEN rx1 > rx0 AND ry1 > ry0 THEN (rx1 + pw - 1) // pw - rx0 // pw ELSE 0 END AS pnx, CASE WHEN rx1 > rx0 AND ry1 > ry0 THEN (ry1 + ph - 1) // ph - ry0 // ph ELSE 0 END AS pny FROM res),
prec AS (SELECT tile_id, resolution, d, pw, ph, CAST(i AS BIGINT) AS precinct_index, px0 + i % pnx AS precinct_x, py0 + i // pnx AS precinct_y, rx0, ry0, rx1, ry1 FROM plan, range(0, 400) t(i) WHERE i < pnx * pny)"""


def _precincts(spark, tiles=None):
    tiles = geometry.tiles(spark, GRID) if tiles is None else tiles
    return geometry.precincts(geometry.resolutions(tiles, LEVELS, PRECINCTS, ["tile_id"]))


@query("precinct_plan", f"WITH {_TILES}, {_PLAN} SELECT tile_id, resolution, pnx, pny, CASE WHEN pnx > 0 THEN px0 ELSE 0 END AS px0, CASE WHEN pnx > 0 THEN py0 ELSE 0 END AS py0, pnx * pny * 3 * 2 AS packets FROM plan")
def precinct_plan(spark, d):
    plan = geometry.resolutions(geometry.tiles(spark, GRID), LEVELS, PRECINCTS, ["tile_id"])
    return plan.select(*ints(tile_id="tile_id", resolution="resolution", pnx="pnx", pny="pny", px0="px0", py0="py0", packets=F.col("pnx") * F.col("pny") * 6))


@query(
    "precinct_rects",
    f"WITH {_TILES}, {_PLAN} SELECT tile_id, resolution, precinct_index, greatest(rx0, precinct_x * pw) - rx0 AS x, greatest(ry0, precinct_y * ph) - ry0 AS y, least(rx1, (precinct_x + 1) * pw) - greatest(rx0, precinct_x * pw) AS w, least(ry1, (precinct_y + 1) * ph) - greatest(ry0, precinct_y * ph) AS h FROM prec",
)
def precinct_rects(spark, d):
    return _precincts(spark).select(*ints(tile_id="tile_id", resolution="resolution", precinct_index="precinct_index", x=F.col("qx0") - F.col("rx0"), y=F.col("qy0") - F.col("ry0"), w=F.col("qx1") - F.col("qx0"), h=F.col("qy1") - F.col("qy0")))


_PACKETS = f"""packets AS (SELECT tile_id, resolution, precinct_index, CAST(c AS BIGINT) AS component, CAST(l AS BIGINT) AS layer, (precinct_y * ph) << d AS y_ref, (precinct_x * pw) << d AS x_ref FROM prec, range(0, 3) t(c), range(0, 2) u(l))"""
_COLUMNS = ("tile_id", "sequence", "resolution", "precinct_index", "component", "layer")


def _order_sql(order: str) -> str:
    return f"WITH {_TILES}, {_PLAN}, {_PACKETS} SELECT tile_id, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY {', '.join(progression.ORDERS[order])}) - 1 AS BIGINT) AS sequence, resolution, precinct_index, component, layer FROM packets"


def _packets(spark):
    return progression.packets(_precincts(spark), 3, 2, ["tile_id"])


def _register_orders() -> None:
    for order in progression.ORDERS:

        def run(spark, d, order=order):
            return progression.in_order(_packets(spark), order, ["tile_id"]).select(*ints(**{c: c for c in _COLUMNS}))

        query(f"packets_{order.lower()}", _order_sql(order))(run)


_register_orders()


@query("rpcl_closed_form", f"WITH {_TILES}, {_PLAN}, {_PACKETS} SELECT CAST(row_number() OVER (ORDER BY resolution, precinct_index, component, layer) - 1 AS BIGINT) AS sequence, resolution, precinct_index, component, layer FROM packets WHERE tile_id = 6")
def rpcl_closed_form(spark, d):
    """The place in RPCL order without a sort."""
    tile = geometry.tiles(spark, GRID).where("tile_id = 6")
    plan = geometry.resolutions(tile, LEVELS, PRECINCTS, ["tile_id"]).orderBy("resolution").select((F.col("pnx") * F.col("pny")).alias("n"))
    counts = [r["n"] for r in plan.collect()]  # one number a resolution, 33 at most
    rows = progression.packets(_precincts(spark, tile), 3, 2, ["tile_id"])
    place = progression.rpcl_sequence(counts, F.col("resolution"), F.col("precinct_index"), F.col("component"), F.col("layer"), 3, 2)
    return rows.select(*ints(sequence=place, resolution="resolution", precinct_index="precinct_index", component="component", layer="layer"))


@query("packet_permutation", f"WITH {_TILES}, {_PLAN}, {_PACKETS}, o AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY resolution, precinct_index, component, layer) - 1 AS a, row_number() OVER (PARTITION BY tile_id ORDER BY layer, resolution, component, precinct_index) - 1 AS b FROM packets) SELECT tile_id, CAST(a AS BIGINT) AS rpcl, CAST(b AS BIGINT) AS lrcp FROM o")
def packet_permutation(spark, d):
    both = progression.in_order(progression.in_order(_packets(spark), "RPCL", ["tile_id"]).withColumnRenamed("sequence", "rpcl"), "LRCP", ["tile_id"])
    return both.select(*ints(tile_id="tile_id", rpcl="rpcl", lrcp="sequence"))


_SAMPLED = """comp AS (SELECT * FROM (VALUES (0, 1, 1), (1, 2, 2), (2, 2, 1)) v(c, sx, sy)),
tiles AS (SELECT c AS tile_id, sx, sy, (5 + sx - 1) // sx AS x0, (3 + sy - 1) // sy AS y0, (77 + sx - 1) // sx AS x1, (61 + sy - 1) // sy AS y1 FROM comp)"""


def _sampled_sql(order: str) -> str:
    keys = ", ".join(progression.SAMPLED_ORDERS[order])
    return f"""WITH {_SAMPLED}, {_PLAN}, pk AS (SELECT CAST(p.tile_id AS BIGINT) AS component, resolution, precinct_index, CAST(l AS BIGINT) AS layer, greatest((precinct_y * ph * sy) << d, 3) AS y_ref, greatest((precinct_x * pw * sx) << d, 5) AS x_ref FROM prec p JOIN tiles ON tiles.tile_id = p.tile_id, range(0, 2) t(l))
    SELECT CAST(row_number() OVER (ORDER BY {keys}{"" if "precinct_index" in keys else ", precinct_index"}) - 1 AS BIGINT) AS sequence, resolution, precinct_index, component, layer FROM pk"""


def _sampled(spark):
    rows = [(c, sx, sy, -(-5 // sx), -(-3 // sy), -(-77 // sx), -(-61 // sy)) for c, sx, sy in ((0, 1, 1), (1, 2, 2), (2, 2, 1))]
    areas = spark.createDataFrame(rows, "component bigint, x_step bigint, y_step bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    plan = geometry.resolutions(areas, LEVELS, PRECINCTS, ["component", "x_step", "y_step"])
    return progression.sampled_packets(geometry.precincts(plan), 2, 5, 3)


def _register_sampled() -> None:
    for order in progression.SAMPLED_ORDERS:

        def run(spark, d, order=order):
            return progression.in_order(_sampled(spark), order, [], sampled=True).select(*ints(sequence="sequence", resolution="resolution", precinct_index="precinct_index", component="component", layer="layer"))

        query(f"packets_sampled_{order.lower()}", _sampled_sql(order))(run)


_register_sampled()

RECORDS = [(0, "RLCP", 0, 2, 0, 3, 1), (1, "LRCP", 0, 4, 0, 2, 2), (2, "PCRL", 0, 4, 0, 3, 2)]


@query(
    "poc_schedule",
    f"""WITH {_TILES}, {_PLAN}, {_PACKETS}, rec AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RECORDS)}) v(rec, ord, rs, re, cs, ce, le)),
    cov AS (SELECT *, row_number() OVER (PARTITION BY tile_id, resolution, precinct_index, component, layer ORDER BY rec) AS n FROM packets JOIN rec ON resolution >= rs AND resolution < re AND component >= cs AND component < ce AND layer < le)
    SELECT tile_id, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY rec, CASE ord WHEN 'RLCP' THEN [resolution, layer, component, precinct_index, 0] WHEN 'LRCP' THEN [layer, resolution, component, precinct_index, 0] ELSE [y_ref, x_ref, component, resolution, layer] END) - 1 AS BIGINT) AS sequence,
      resolution, precinct_index, component, layer FROM cov WHERE n = 1""",
)
def poc_schedule(spark, d):
    records = spark.createDataFrame(RECORDS, "record bigint, order string, r_start bigint, r_end bigint, c_start bigint, c_end bigint, layer_end bigint")
    return progression.composed(_packets(spark), records, ["tile_id"]).select(*ints(**{c: c for c in _COLUMNS}))


@query("poc_coverage", f"WITH {_TILES}, {_PLAN}, {_PACKETS} SELECT tile_id, resolution, precinct_index, component, layer FROM packets WHERE NOT ((resolution < 2 AND layer < 1) OR component < 2)")
def poc_coverage(spark, d):
    """What an incomplete schedule leaves out."""
    records = spark.createDataFrame(RECORDS[:2], "record bigint, order string, r_start bigint, r_end bigint, c_start bigint, c_end bigint, layer_end bigint")
    rows = _packets(spark)
    return progression.uncovered(rows, progression.composed(rows, records, ["tile_id"]), ["tile_id"]).select(*ints(**{c: c for c in _COLUMNS if c != "sequence"}))


@query(
    "block_packet_join",
    f"""WITH {_TILES}, {_bands(LEVELS)}, {_BLOCKS}, {_PLAN}, bb AS (SELECT b.*, s.kind, s.origin_x, s.origin_y, s.x AS sx, s.y AS sy, s.w AS sw, s.h AS sh, CASE WHEN s.kind = 'LL' THEN 0 ELSE {LEVELS} - s.level + 1 END AS resolution FROM blocks b JOIN bands s USING (tile_id, band_index)),
    qq AS (SELECT *, greatest(rx0, precinct_x * pw) AS qx0, greatest(ry0, precinct_y * ph) AS qy0, least(rx1, (precinct_x + 1) * pw) AS qx1, least(ry1, (precinct_y + 1) * ph) AS qy1 FROM prec),
    jj AS (SELECT bb.*, precinct_index, CASE WHEN kind = 'LL' THEN qx0 WHEN kind IN ('HL', 'HH') THEN qx0 // 2 ELSE (qx0 + 1) // 2 END AS ax0, CASE WHEN kind = 'LL' THEN qx1 WHEN kind IN ('HL', 'HH') THEN qx1 // 2 ELSE (qx1 + 1) // 2 END AS ax1,
      CASE WHEN kind = 'LL' THEN qy0 WHEN kind IN ('LH', 'HH') THEN qy0 // 2 ELSE (qy0 + 1) // 2 END AS ay0, CASE WHEN kind = 'LL' THEN qy1 WHEN kind IN ('LH', 'HH') THEN qy1 // 2 ELSE (qy1 + 1) // 2 END AS ay1
      FROM bb JOIN qq ON bb.tile_id = qq.tile_id AND bb.resolution = qq.resolution)
    SELECT tile_id, resolution, precinct_index, band_index, block_y, block_x FROM jj
    WHERE greatest(ax0, origin_x) < least(ax1, origin_x + sw) AND greatest(ay0, origin_y) < least(ay1, origin_y + sh)
      AND ax0 < bx - sx + origin_x + bw AND bx - sx + origin_x < ax1 AND ay0 < "by" - sy + origin_y + bh AND "by" - sy + origin_y < ay1""",
)
def block_packet_join(spark, d):
    """Blocks to precincts without a range join.

    Precinct spans are powers of two, at least as large as a block, so a block lies in one precinct (or,
    where blocks are larger, in a run of them): the precinct follows from the block's place by division,
    and generated rows meet the precincts in an equi-join.
    """
    tiles = geometry.tiles(spark, GRID)
    blocks = geometry.code_blocks(geometry.subbands(tiles, LEVELS, ["tile_id"]), 8, 4, ["tile_id"]).withColumn("resolution", geometry.resolution_of(LEVELS))
    sizes = F.array(*[F.struct(F.lit(PRECINCTS[min(r, 2)][0]).alias("pw"), F.lit(PRECINCTS[min(r, 2)][1]).alias("ph")) for r in range(LEVELS + 1)])
    size = F.element_at(sizes, (F.col("resolution") + 1).cast("int"))
    half = F.when(F.col("kind") == "LL", 1).otherwise(2)
    blocks = blocks.withColumns({"gw": F.floor(size["pw"] / half), "gh": F.floor(size["ph"] / half), "gx": F.col("bx") - F.col("x") + F.col("origin_x"), "gy": F.col("by") - F.col("y") + F.col("origin_y")})
    span = lambda g, n, p: F.explode(F.sequence(F.expr(f"{g} div {p}"), F.expr(f"({g} + {n} - 1) div {p}")))
    placed = blocks.withColumn("precinct_x", span("gx", "bw", "gw")).withColumn("precinct_y", span("gy", "bh", "gh"))
    known = _precincts(spark, tiles).select("tile_id", "resolution", "precinct_x", "precinct_y", "precinct_index")
    return placed.join(known, ["tile_id", "resolution", "precinct_x", "precinct_y"]).select(*ints(tile_id="tile_id", resolution="resolution", precinct_index="precinct_index", band_index="band_index", block_y="block_y", block_x="block_x"))


@query("tile_work_order", f"WITH {_TILES} SELECT tile_id, CAST(row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, tile_id) AS BIGINT) AS place FROM tiles")
def tile_work_order(spark, d):
    """Largest tiles first; the tile grid is a small relation, so one task ranks it."""
    from pyspark.sql import Window

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return geometry.tiles(spark, GRID).select("tile_id", *ints(place=F.row_number().over(Window.orderBy(area.desc(), "tile_id"))))


@query("upsample_nearest", f"WITH {PLANE} SELECT y * 2 + i AS y, x * 2 + j AS x, v FROM plane, range(0, 2) t(i), range(0, 2) u(j)")
def upsample_nearest(spark, d):
    """Every source sample makes its four copies: an explode, not a join."""
    two = F.sequence(F.lit(0), F.lit(1))
    rows = embedding_plane(spark, d).withColumn("i", F.explode(two)).withColumn("j", F.explode(two))
    return rows.select(*ints(y=F.col("y") * 2 + F.col("i"), x=F.col("x") * 2 + F.col("j"), v="v"))


@query(
    "chroma_window",
    f"""WITH {RGB}, c AS (SELECT y // 2 AS cy, x // 2 AS cx, g AS cb FROM rgb WHERE y % 2 = 0 AND x % 2 = 0)
    SELECT y, x, r AS luma, cb FROM rgb JOIN c ON cy = y // 2 AND cx = x // 2 WHERE y >= 7 AND y < 20 AND x >= 11 AND x < 40""",
)
def chroma_window(spark, d):
    """A window widened to the chroma grid, joined there, cut back to itself."""
    rgb = rgb_events(spark, d)
    wide = rgb.where("y >= 6 and y < 20 and x >= 10 and x < 40")
    chroma = wide.where("y % 2 = 0 and x % 2 = 0").select(F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx"), F.col("g").alias("cb"))
    joined = wide.withColumn("cy", F.expr("y div 2")).withColumn("cx", F.expr("x div 2")).join(chroma, ["cy", "cx"])
    return joined.where("y >= 7 and x >= 11").select("y", "x", F.col("r").alias("luma"), "cb")
