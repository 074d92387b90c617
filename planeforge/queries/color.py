"""Colour transforms and sample arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, curves
from ..rasters import embedding_plane, palette, rgb_events, to_pixels, to_planes
from .registry import PALETTE, PLANE, RGB, ints, query, reals

_RCT = "((r + 2 * g + b) >> 2) - 128 AS yy, b - g AS cb, r - g AS cr"
_CLAMP = "CAST(greatest(0, least(255, {0})) AS BIGINT)"


def _clamped(expression: str) -> str:
    return _CLAMP.format(expression)


def _rounded(expression: str) -> str:
    """Half away from zero, in single precision, then clamped."""
    return _clamped(f"CASE WHEN {expression} >= 0 THEN floor({expression} + 0.5::FLOAT) ELSE ceil({expression} - 0.5::FLOAT) END")


@query("rct_forward", f"WITH {RGB} SELECT y, x, yy AS c0, cb AS c1, cr AS c2 FROM (SELECT y, x, {_RCT} FROM rgb)")
def rct_forward(spark, d):
    c = color.rct(F.col("r"), F.col("g"), F.col("b"))
    return rgb_events(spark, d).select("y", "x", *ints(c0=c[0], c1=c[1], c2=c[2]))


@query("rct_inverse_roundtrip", f"WITH {RGB} SELECT y, x, r, g, b FROM rgb")
def rct_inverse_roundtrip(spark, d):
    c = color.rct(F.col("r"), F.col("g"), F.col("b"))
    mixed = rgb_events(spark, d).select("y", "x", *ints(c0=c[0], c1=c[1], c2=c[2]))
    back = color.inverse_rct(F.col("c0"), F.col("c1"), F.col("c2"))
    return mixed.select("y", "x", *ints(r=back[0], g=back[1], b=back[2]))


@query(
    "rct_saturated",
    f"""WITH {RGB}, q AS (SELECT y, x, (yy // 16) * 16 AS yy, (cb // 16) * 16 AS cb, (cr // 16) * 16 AS cr FROM (SELECT y, x, {_RCT} FROM rgb)),
    i AS (SELECT *, yy + 128 - ((cb + cr) >> 2) AS gg FROM q)
    SELECT y, x, {_clamped("cr + gg")} AS r, {_clamped("gg")} AS g, {_clamped("cb + gg")} AS b FROM i""",
)
def rct_saturated(spark, d):
    coarse = [F.expr(f"{n} div 16") * 16 for n in ("c0", "c1", "c2")]
    c = color.rct(F.col("r"), F.col("g"), F.col("b"))
    mixed = rgb_events(spark, d).select("y", "x", *ints(c0=c[0], c1=c[1], c2=c[2])).select("y", "x", *ints(c0=coarse[0], c1=coarse[1], c2=coarse[2]))
    back = color.inverse_rct(F.col("c0"), F.col("c1"), F.col("c2"), saturate=True)
    return mixed.select("y", "x", *ints(r=back[0], g=back[1], b=back[2]))


_RGBA = f"WITH {RGB}, a AS (SELECT *, (r * 3 + g) % 256 AS alpha FROM rgb)"


@query("rct_alpha", f"{_RGBA} SELECT y, x, yy AS c0, cb AS c1, cr AS c2, alpha - 128 AS c3 FROM (SELECT y, x, alpha, {_RCT} FROM a)")
def rct_alpha(spark, d):
    c = color.rct(F.col("r"), F.col("g"), F.col("b"))
    return rgb_events(spark, d).select("y", "x", *ints(c0=c[0], c1=c[1], c2=c[2], c3=color.shifted(F.pmod(F.col("r") * 3 + F.col("g"), F.lit(256)))))


@query("rct_alpha_inverse", f"{_RGBA} SELECT y, x, CAST(c AS BIGINT) AS component, CASE c WHEN 0 THEN r WHEN 1 THEN g WHEN 2 THEN b ELSE alpha END AS v FROM a, range(0, 4) t(c)")
def rct_alpha_inverse(spark, d):
    mixed = rct_alpha(spark, d)
    back = color.inverse_rct(F.col("c0"), F.col("c1"), F.col("c2"))
    plain = mixed.select("y", "x", *ints(r=back[0], g=back[1], b=back[2], a=color.unshifted(F.col("c3"))))
    return to_planes(plain, ("r", "g", "b", "a")).select("y", "x", "component", "v")


_F = "CAST({} AS FLOAT)".format
_ICT = f"""(SELECT y, x, {_F("r")} - 128::FLOAT AS r, {_F("g")} - 128::FLOAT AS g, {_F("b")} - 128::FLOAT AS b FROM rgb)"""
_ICT3 = f"""SELECT y, x, 0.299::FLOAT * r + 0.587::FLOAT * g + 0.114::FLOAT * b AS c0, -0.16875::FLOAT * r + -0.33126::FLOAT * g + 0.5::FLOAT * b AS c1,
    0.5::FLOAT * r - 0.41869::FLOAT * g - 0.08131::FLOAT * b AS c2 FROM {_ICT}"""


@query("ict_forward", f"WITH {RGB} SELECT y, x, c0::DOUBLE AS c0, c1::DOUBLE AS c1, c2::DOUBLE AS c2 FROM ({_ICT3})")
def ict_forward(spark, d):
    c = color.ict(F.col("r"), F.col("g"), F.col("b"))
    return rgb_events(spark, d).select("y", "x", *reals(c0=c[0], c1=c[1], c2=c[2]))


@query(
    "ict_inverse",
    f"""WITH {RGB}, c AS ({_ICT3}), i AS (SELECT y, x, c0 + 1.402::FLOAT * c2 + 128::FLOAT AS r, c0 - 0.34413::FLOAT * c1 - 0.71414::FLOAT * c2 + 128::FLOAT AS g, c0 + 1.772::FLOAT * c1 + 128::FLOAT AS b FROM c)
    SELECT y, x, {_rounded("r")} AS r, {_rounded("g")} AS g, {_rounded("b")} AS b FROM i""",
)
def ict_inverse(spark, d):
    c = color.ict(F.col("r"), F.col("g"), F.col("b"))
    mixed = rgb_events(spark, d).select("y", "x", *[v.alias(n) for v, n in zip(c, ("c0", "c1", "c2"), strict=True)])
    back = color.inverse_ict(F.col("c0"), F.col("c1"), F.col("c2"))
    return mixed.select("y", "x", *ints(r=back[0], g=back[1], b=back[2]))


@query("level_shift", f"WITH {RGB} SELECT y, x, CAST(c AS BIGINT) AS component, (CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END) - 128 AS v FROM rgb, range(0, 3) t(c)")
def level_shift(spark, d):
    return to_planes(rgb_events(spark, d)).select("y", "x", "component", *ints(v=color.shifted(F.col("v"))))


@query("level_shift_float", f"WITH {RGB} SELECT y, x, (r::FLOAT - 128::FLOAT)::DOUBLE AS c0, (g::FLOAT - 128::FLOAT)::DOUBLE AS c1, (b::FLOAT - 128::FLOAT)::DOUBLE AS c2 FROM rgb")
def level_shift_float(spark, d):
    up = F.lit(128).cast("float")
    return rgb_events(spark, d).select("y", "x", *reals(c0=F.col("r").cast("float") - up, c1=F.col("g").cast("float") - up, c2=F.col("b").cast("float") - up))


@query("clamp_sample", f"WITH {PLANE} SELECT y, x, {_rounded('v::FLOAT * 4.5::FLOAT')} AS v FROM plane")
def clamp_sample(spark, d):
    return embedding_plane(spark, d).select("y", "x", *ints(v=color.clamp_float(F.col("v").cast("float") * F.lit(4.5).cast("float"), 8)))


@query("bitplane_count", f"WITH {PLANE} SELECT y, x, abs(v) AS magnitude, CAST(CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) + 1 END AS BIGINT) AS planes FROM plane")
def bitplane_count(spark, d):
    return embedding_plane(spark, d).select("y", "x", *ints(magnitude=F.abs("v"), planes=color.bit_planes(F.col("v"))))


@query("depth_limits", "SELECT CAST(d AS BIGINT) AS depth, CAST(power(2, d - 1) AS BIGINT) AS shift, CAST(power(2, d) - 1 AS BIGINT) AS top FROM range(1, 17) t(d)")
def depth_limits(spark, d):
    one = F.lit(1).cast("bigint")
    return spark.range(1, 17).select(*ints(depth="id", shift=F.call_function("shiftleft", one, F.col("id").cast("int") - 1), top=F.call_function("shiftleft", one, F.col("id").cast("int")) - 1))


@query(
    "sample_range_audit",
    f"""WITH {RGB}, s AS (SELECT CAST(c AS BIGINT) AS component, (CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END) AS v FROM rgb, range(0, 3) t(c))
    SELECT component, CAST(count(*) FILTER (v < 0 OR v > 127) AS BIGINT) AS outside, min(v) AS low, max(v) AS high FROM s GROUP BY component""",
)
def sample_range_audit(spark, d):
    return to_planes(rgb_events(spark, d)).groupBy("component").agg(F.count_if(~F.col("v").between(0, 127)).alias("outside"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("sign_extension", f"WITH {RGB} SELECT y, x, CASE WHEN r >= 128 THEN r - 256 ELSE r END AS s8, CASE WHEN k >= 32768 THEN k - 65536 ELSE k END AS s16 FROM (SELECT *, r + 256 * g AS k FROM rgb)")
def sign_extension(spark, d):
    return rgb_events(spark, d).select("y", "x", *ints(s8=color.sign_extended(F.col("r"), 8), s16=color.sign_extended(F.col("r") + F.col("g") * 256, 16)))


@query("gray_inversion", f"WITH {RGB} SELECT y, x, 255 - r AS v FROM rgb")
def gray_inversion(spark, d):
    return rgb_events(spark, d).select("y", "x", *ints(v=color.inverted(F.col("r"))))


def _trunc(e: str) -> str:
    return f"CAST(trunc({e}) AS BIGINT)"


_SYCC = f"""{_clamped("yy + " + _trunc("1.402::FLOAT * cr"))} AS r, {_clamped("yy - " + _trunc("0.344::FLOAT * cb + 0.714::FLOAT * cr"))} AS g, {_clamped("yy + " + _trunc("1.772::FLOAT * cb"))} AS b"""


@query("sycc444_to_rgb", f"WITH {RGB} SELECT y, x, {_SYCC} FROM (SELECT y, x, r AS yy, (g - 128)::FLOAT AS cb, (b - 128)::FLOAT AS cr FROM rgb)")
def sycc444_to_rgb(spark, d):
    c = color.sycc(F.col("r"), F.col("g"), F.col("b"))
    return rgb_events(spark, d).select("y", "x", *ints(r=c[0], g=c[1], b=c[2]))


#: Image origin (5, 3): an odd origin, so the first row has no chroma, nor the first column of even pairs.
_ORIGIN_X, _ORIGIN_Y = 5, 3


def chroma_place(step_x: int, step_y: int, origin_x: int, origin_y: int):
    """Row and column of a pixel's chroma sample; null where an odd origin leaves it without one."""
    ex, ey = origin_x % step_x, origin_y % step_y
    y, x = F.col("y"), F.col("x")
    row = F.when(y >= ey, F.floor((y - ey) / step_y))
    first = F.when(F.pmod(y - ey, F.lit(step_y)) != 0, F.lit(0))
    col = F.when(x >= ex, F.floor((x - ex) / step_x)).otherwise(first)
    return row.cast("bigint"), col.cast("bigint")


@query(
    "sycc420_to_rgb",
    f"""WITH {RGB}, c AS (SELECT y // 2 AS cy, x // 2 AS cx, g AS cb, b AS cr FROM rgb WHERE y % 2 = 0 AND x % 2 = 0),
    p AS (SELECT y, x, r AS yy, CASE WHEN y < 1 THEN NULL ELSE (y - 1) // 2 END AS cy, CASE WHEN x >= 1 THEN (x - 1) // 2 WHEN y >= 1 AND (y - 1) % 2 = 1 THEN 0 END AS cx FROM rgb),
    j AS (SELECT p.y, p.x, yy, (coalesce(c.cb, 0) - 128)::FLOAT AS cb, (coalesce(c.cr, 0) - 128)::FLOAT AS cr FROM p LEFT JOIN c ON p.cy = c.cy AND p.cx = c.cx)
    SELECT y, x, {_SYCC} FROM j""",
)
def sycc420_to_rgb(spark, d):
    rgb = rgb_events(spark, d)
    chroma = rgb.where("y % 2 = 0 and x % 2 = 0").select(F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx"), F.col("g").alias("cb"), F.col("b").alias("cr"))
    row, col = chroma_place(2, 2, _ORIGIN_X, _ORIGIN_Y)
    joined = rgb.select("y", "x", F.col("r").alias("yy"), row.alias("cy"), col.alias("cx")).join(chroma, ["cy", "cx"], "left")
    zero = F.lit(0)
    c = color.sycc(F.col("yy"), F.coalesce("cb", zero), F.coalesce("cr", zero))
    return joined.select("y", "x", *ints(r=c[0], g=c[1], b=c[2]))


@query(
    "jpeg_ycc_to_rgb",
    f"""WITH {RGB} SELECT y, x, {_clamped("r + ((91881 * cr + 32768) >> 16)")} AS r, {_clamped("r - ((22554 * cb + 46802 * cr + 32768) >> 16)")} AS g, {_clamped("r + ((116130 * cb + 32768) >> 16)")} AS b
    FROM (SELECT y, x, r, g - 128 AS cb, b - 128 AS cr FROM rgb)""",
)
def jpeg_ycc_to_rgb(spark, d):
    yy, cb, cr = F.col("r"), F.col("g") - 128, F.col("b") - 128
    fixed = (yy + F.shiftright(cr * 91881 + 32768, 16), yy - F.shiftright(cb * 22554 + cr * 46802 + 32768, 16), yy + F.shiftright(cb * 116130 + 32768, 16))
    return rgb_events(spark, d).select("y", "x", *ints(r=color.clamp(fixed[0], 8), g=color.clamp(fixed[1], 8), b=color.clamp(fixed[2], 8)))


@query("palette_expand", f"WITH {PALETTE}, i AS (SELECT event_id // 100 AS y, event_id % 100 AS x, event_id % 200 AS idx FROM events) SELECT y, x, c0, c1, c2 FROM i JOIN pal USING (idx)")
def palette_expand(spark, d):
    pixels = rgb_events(spark, d).select("y", "x", F.pmod(F.col("y") * 100 + F.col("x"), F.lit(200)).alias("index"))
    # a palette has 1024 entries at most by its format, so it may be broadcast
    joined = pixels.join(F.broadcast(palette(spark, d)), "index", "left")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("index is not in the palette")).cast("bigint"))
    return joined.select("y", "x", *ints(c0=known("c0"), c1=known("c1"), c2=known("c2")))


@query("packed_pixels", f"WITH {RGB} SELECT y, x, CAST(k AS BIGINT) AS k, (r >> (6 - 2 * k)) & 3 AS v, ((r >> (6 - 2 * k)) & 3) * 85 AS scaled FROM rgb, range(0, 4) t(k)")
def packed_pixels(spark, d):
    """Four 2-bit samples of a byte, and scaled to 8 bits."""
    rows = rgb_events(spark, d).select("y", "x", "r", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    v = F.call_function("shiftright", F.col("r"), F.lit(6) - F.col("k") * 2).bitwiseAND(F.lit(3))
    return rows.select("y", "x", *ints(k="k", v=v, scaled=v * 85))


_CURVE3 = [2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045]


@query("icc_parametric", f"WITH {RGB} SELECT y, x, round(CASE WHEN u >= 0.04045 THEN power({_CURVE3[1]!r} * u + {_CURVE3[2]!r}, 2.4) ELSE {_CURVE3[3]!r} * u END, 9) AS v FROM (SELECT y, x, r / 255.0::DOUBLE AS u FROM rgb)")
def icc_parametric(spark, d):
    return rgb_events(spark, d).select("y", "x", *reals(v=F.round(curves.parametric(F.col("r") / 255.0, 3, _CURVE3), 9)))


_TABLE = [0, 1000, 5000, 12000, 30000, 65535]


@query(
    "icc_table_curve",
    f"""WITH {RGB}, t AS (SELECT * FROM (VALUES {", ".join(f"({k}, {e})" for k, e in enumerate(_TABLE))}) v(k, e)), u AS (SELECT y, x, g / 255.0::DOUBLE * 5 AS p FROM rgb)
    SELECT u.y, u.x, round(CASE WHEN hi.e IS NULL THEN lo.e / 65535.0::DOUBLE ELSE lo.e / 65535.0::DOUBLE + (hi.e / 65535.0::DOUBLE - lo.e / 65535.0::DOUBLE) * (p - floor(p)) END, 9) AS v
    FROM u JOIN t lo ON lo.k = CAST(floor(p) AS BIGINT) LEFT JOIN t hi ON hi.k = lo.k + 1""",
)
def icc_table_curve(spark, d):
    return rgb_events(spark, d).select("y", "x", *reals(v=F.round(curves.table_curve(F.col("g") / 255.0, _TABLE), 9)))


@query("icc_curve_monotone", "SELECT CAST(count(*) FILTER (v < before) AS BIGINT) AS falls, CAST(count(*) AS BIGINT) AS n FROM (SELECT v, lag(v) OVER (ORDER BY i) AS before FROM (SELECT i, power(i / 256.0::DOUBLE, 2.2) AS v FROM range(0, 257) t(i)))")
def icc_curve_monotone(spark, d):
    from pyspark.sql import Window

    rows = spark.range(257).select("id", curves.parametric(F.col("id") / 256.0, 0, [2.2]).alias("v"))  # 257 points, one task
    before = F.lag("v").over(Window.orderBy("id"))
    return rows.select("v", before.alias("before")).agg(F.count_if(F.col("v") < F.col("before")).alias("falls"), F.count("*").alias("n"))


def _inverse_srgb_sql() -> list[list[float]]:
    return curves.invert(curves.SRGB).tolist()


def _row(m, k, names) -> str:
    return " + ".join(f"{m[k][j]!r} * {n}" for j, n in enumerate(names))


_M = [[0.6, 0.3, 0.1], [0.25, 0.7, 0.05], [0.02, 0.1, 0.7]]
_UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format
_ENC = f"CASE WHEN {{0}} < {curves.SRGB_C * curves.SRGB_D!r} THEN {{0}} / {curves.SRGB_C!r} ELSE (power({{0}}, {1.0 / curves.SRGB_GAMMA!r}) - {curves.SRGB_B!r}) / {curves.SRGB_A!r} END".format
_SAMPLE = "CAST(floor({} * 255.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)".format


@query(
    "icc_to_srgb",
    f"""WITH {RGB}, l AS (SELECT y, x, power(r / 255.0::DOUBLE, 1.8) AS r, power(g / 255.0::DOUBLE, 1.8) AS g, power(b / 255.0::DOUBLE, 1.8) AS b FROM rgb),
    z AS (SELECT y, x, {", ".join(f"{_row(_M, k, 'rgb')} AS z{k}" for k in range(3))} FROM l),
    s AS (SELECT y, x, {", ".join(f"{_UNIT(_row(_inverse_srgb_sql(), k, ('z0', 'z1', 'z2')))} AS s{k}" for k in range(3))} FROM z)
    SELECT y, x, {", ".join(f"{_SAMPLE(_UNIT(_ENC(f's{k}')))} AS {n}" for k, n in enumerate("rgb"))} FROM s""",
)
def icc_to_srgb(spark, d):
    c = curves.to_srgb((F.col("r"), F.col("g"), F.col("b")), _M, lambda v: F.pow(v, F.lit(1.8)))
    return rgb_events(spark, d).select("y", "x", *ints(r=c[0], g=c[1], b=c[2]))


@query("dng_normalize", f"WITH {RGB} SELECT y, x, CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (k - 1024.0::DOUBLE) / 48976.0::DOUBLE)) * 65535 + 0.5::DOUBLE) AS BIGINT) AS v FROM (SELECT y, x, r + 256 * g AS k FROM rgb)")
def dng_normalize(spark, d):
    return rgb_events(spark, d).select("y", "x", *ints(v=color.normalized((F.col("r") + F.col("g") * 256).cast("double"), 1024.0, 50000.0, 16)))


@query("dng_linearize", f"WITH {RGB}, t AS (SELECT k, (k * k) // 64 AS e FROM range(0, 200) t(k)) SELECT y, x, CAST(e AS BIGINT) AS v FROM rgb JOIN t ON t.k = least(r, 199)")
def dng_linearize(spark, d):
    """A linearisation table of a fixed size, read past its end at the last entry."""
    table = F.array(*[F.lit(k * k // 64) for k in range(200)])
    return rgb_events(spark, d).select("y", "x", *ints(v=F.get(table, F.least(F.col("r"), F.lit(199)).cast("int"))))


@query("dng_camera_matrix", "SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, ([0.6, 0.3, 0.1, 0.25, 0.7, 0.05, 0.02, 0.1, 0.7][3 * r + c + 1])::DOUBLE / ([0.5, 1.0, 0.625][c + 1])::DOUBLE AS v FROM range(0, 3) t(r), range(0, 3) u(c)")
def dng_camera_matrix(spark, d):
    m = curves.camera_to_xyz(_M, [0.5, 1.0, 0.625])
    return spark.createDataFrame([(r, c, float(m[r, c])) for r in range(3) for c in range(3)], "r bigint, c bigint, v double")


@query("exr_half_samples", f"WITH {RGB} SELECT y, x, CAST(floor((r / 256.0::DOUBLE) * 65535.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS v FROM rgb")
def exr_half_samples(spark, d):
    return rgb_events(spark, d).select("y", "x", *ints(v=color.half_to_sample((F.col("r") / 256.0).cast("float"))))


@query("scalar_quantize", f"WITH {PLANE} SELECT y, x, CAST(sign(v) * floor(abs(v) / 2.5::DOUBLE) AS BIGINT) AS q, CASE WHEN sign(v) * floor(abs(v) / 2.5::DOUBLE) = 0 THEN 0.0::DOUBLE ELSE (sign(v) * floor(abs(v) / 2.5::DOUBLE) + sign(v) * 0.5::DOUBLE) * 2.5::DOUBLE END AS back FROM plane")
def scalar_quantize(spark, d):
    step = F.lit(2.5)
    rows = embedding_plane(spark, d).select("y", "x", color.dead_zone(F.col("v"), step).alias("q"))
    return rows.select("y", "x", "q", *reals(back=color.dead_zone_inverse(F.col("q"), step)))


@query("roi_maxshift", f"WITH {PLANE}, s AS (SELECT y, x, CASE WHEN y % 2 = 0 THEN v * 256 ELSE v END AS v FROM plane) SELECT y, x, CAST(CASE WHEN abs(v) >= 256 THEN sign(v) * (abs(v) >> 8) ELSE v END AS BIGINT) AS v FROM s")
def roi_maxshift(spark, d):
    rows = embedding_plane(spark, d).withColumn("v", F.when(F.col("y") % 2 == 0, F.col("v") * 256).otherwise(F.col("v")))
    return rows.select("y", "x", *ints(v=color.maxshift_inverse(F.col("v"), 8)))


@query("interleave_rgb", f"WITH {RGB} SELECT y, x, r, g, b FROM rgb")
def interleave_rgb(spark, d):
    return to_pixels(to_planes(rgb_events(spark, d))).select("y", "x", "r", "g", "b")


@query(
    "bench_raster",
    """SELECT y, x, x * 255 // 639 AS r, xor(y * 255 // 479, (17 * x + 31 * y) & 63) AS g, 255 - x * 255 // 639 AS b
    FROM (SELECT i // 640 AS y, i % 640 AS x FROM range(0, 640 * 480) t(i))""",
)
def bench_raster(spark, d):
    from ..rasters import bench_raster as made

    return made(spark, 640, 480).select(*ints(y="y", x="x", r="r", g="g", b="b"))


_BASIS = "(CASE WHEN {f} = 0 THEN sqrt(0.5::DOUBLE) ELSE 1.0::DOUBLE END) * cos((2 * {p} + 1) * {f} * pi() / 16.0::DOUBLE)".format


@query(
    "dct8_inverse",
    f"""WITH {PLANE}, t AS (SELECT y AS blk, x // 8 AS fv, x % 8 AS fu, v * (x // 8 + x % 8 + 1) AS c FROM plane),
    h AS (SELECT blk, fv, px, sum(c * {_BASIS(f="fu", p="px")}) AS s FROM t, range(0, 8) r(px) GROUP BY ALL),
    w AS (SELECT blk, py, px, sum(s * {_BASIS(f="fv", p="py")}) AS s FROM h, range(0, 8) r(py) GROUP BY ALL)
    SELECT blk AS block, CAST(py AS BIGINT) AS y, CAST(px AS BIGINT) AS x, CAST(greatest(0, least(255, floor(s * 0.25::DOUBLE + 128.5::DOUBLE + 1e-9::DOUBLE))) AS BIGINT) AS v FROM w""",
)
def dct8_inverse(spark, d):
    """Dequantised 8x8 blocks (a row of the plane is one) to samples: both passes inside the row, no basis join."""
    from ..functions.dct import inverse_blocks
    from ..rasters import to_blocks, to_samples

    plane = embedding_plane(spark, d).select(F.col("y").alias("block"), F.expr("x div 8").alias("y"), (F.col("x") % 8).alias("x"), "v")
    scaled = plane.withColumn("v", F.col("v") * (F.col("y") + F.col("x") + 1))
    return to_samples(inverse_blocks(to_blocks(scaled, 8, 8, ("block",))), ("block",)).select(*ints(block="block", y="y", x="x", v="v"))


def _weight(axis: str, near: str) -> str:
    """1 or 3 quarters of the first and second neighbour by the place's parity."""
    return f"CASE WHEN {axis} % 2 = 0 THEN {1 if near == 'first' else 3} ELSE {3 if near == 'first' else 1} END"


@query(
    "jpeg_upsample",
    f"""WITH {RGB}, m AS (SELECT max(y) AS top FROM rgb), g AS (SELECT y * 2 + i AS yy, x * 2 + j AS xx, y AS cy, x AS cx FROM rgb, range(0, 2) t(i), range(0, 2) u(j)),
    k AS (SELECT yy, xx, CASE WHEN yy % 2 = 0 THEN greatest(cy - 1, 0) ELSE cy END AS y0, CASE WHEN yy % 2 = 0 THEN cy ELSE least(cy + 1, top) END AS y1,
      CASE WHEN xx % 2 = 0 THEN greatest(cx - 1, 0) ELSE cx END AS x0, CASE WHEN xx % 2 = 0 THEN cx ELSE least(cx + 1, 99) END AS x1 FROM g, m)
    SELECT k.yy AS y, k.xx AS x, (({_weight("yy", "first")}) * (({_weight("xx", "first")}) * a.r + ({_weight("xx", "second")}) * b.r) + ({_weight("yy", "second")}) * (({_weight("xx", "first")}) * e.r + ({_weight("xx", "second")}) * f.r) + 8) // 16 AS v
    FROM k JOIN rgb a ON a.y = y0 AND a.x = x0 JOIN rgb b ON b.y = y0 AND b.x = x1 JOIN rgb e ON e.y = y1 AND e.x = x0 JOIN rgb f ON f.y = y1 AND f.x = x1""",
)
def jpeg_upsample(spark, d):
    """2x2 chroma upsampling, weights 1/4 and 3/4 on centred samples: along rows, then along columns."""
    from ..functions.dct import upsample_axis

    chroma = rgb_events(spark, d).select("y", "x", F.col("r").alias("v"))
    tall = upsample_axis(upsample_axis(chroma, "x", ["y"]), "y", ["x"])
    return tall.select(*ints(y="y", x="x", v=F.expr("(v + 8) div 16")))
