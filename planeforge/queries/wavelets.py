"""Wavelet transforms, selections that go through them, and the simple codec."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import color
from ..operators import lifting, stats
from ..plans import wavelets
from ..rasters import embedding_plane, rgb_events, table, to_blocks, to_planes, to_samples
from ..session import written
from .registry import PLANE, RGB, ints, query, reals

_A, _B, _C, _D, _K = lifting.ALPHA, lifting.BETA, lifting.GAMMA, lifting.DELTA, lifting.K


def _near(v: str, n: int) -> str:
    """Mirrored neighbours as columns l, r."""
    return f"coalesce(lag({v}) OVER w{n}, lead({v}) OVER w{n}) AS l, coalesce(lead({v}) OVER w{n}, lag({v}) OVER w{n}) AS r"


def _packed(axis: str, origin: int) -> str:
    low = f"((({axis} + {origin}) >> 1) - {(origin + 1) >> 1})"
    lows = f"((({origin} + n + 1) >> 1) - {(origin + 1) >> 1})"
    return f"CASE WHEN ({axis} + {origin}) % 2 = 0 THEN {low} ELSE {lows} + (({axis} + {origin} - 1) >> 1) - {origin >> 1} END"


def _plain(axis: str, origin: int) -> str:
    lows = f"((({origin} + n + 1) >> 1) - {(origin + 1) >> 1})"
    return f"CASE WHEN {axis} < {lows} THEN ({axis} + {(origin + 1) >> 1}) * 2 - {origin} ELSE ({axis} - {lows} + {origin >> 1}) * 2 + 1 - {origin} END"


def line53(src: str, dst: str, axis: str, other: str, keys: str = "", origin: int = 0) -> str:
    """CTEs ``dst``: one forward 5/3 pass along an axis of ``keys, y, x, v``."""
    part = f"PARTITION BY {keys}{other}"
    odd = f"({axis} + {origin}) % 2 = 1"
    return f"""{dst}_1 AS (SELECT {keys}y, x, v, count(*) OVER ({part}) AS n, {_near("v", 0)} FROM {src} WINDOW w0 AS ({part} ORDER BY {axis})),
{dst}_2 AS (SELECT {keys}y, x, n, CASE WHEN NOT {odd} THEN v WHEN l IS NULL THEN 2 * v ELSE v - ((l + r) >> 1) END AS v FROM {dst}_1),
{dst}_3 AS (SELECT {keys}y, x, v, n, {_near("v", 0)} FROM {dst}_2 WINDOW w0 AS ({part} ORDER BY {axis})),
{dst} AS (SELECT {keys}{other}, CAST({_packed(axis, origin)} AS BIGINT) AS {axis}, CASE WHEN {odd} OR l IS NULL THEN v ELSE v + ((l + r + 2) >> 2) END AS v FROM {dst}_3)"""


def line97(src: str, dst: str, axis: str, other: str) -> str:
    part, out, last = f"PARTITION BY {other}", [f"{dst}_0 AS (SELECT y, x, v::FLOAT AS v, count(*) OVER (PARTITION BY {other}) AS n FROM {src})"], f"{dst}_0"
    for k, (parity, factor) in enumerate(((1, _A), (0, _B), (1, _C), (0, _D)), 1):
        out.append(f"{dst}_{k}n AS (SELECT y, x, v, n, {_near('v', 0)} FROM {last} WINDOW w0 AS ({part} ORDER BY {axis}))")
        out.append(f"{dst}_{k} AS (SELECT y, x, n, CASE WHEN {axis} % 2 = {parity} AND l IS NOT NULL THEN v + {factor!r}::FLOAT * (l + r) ELSE v END AS v FROM {dst}_{k}n)")
        last = f"{dst}_{k}"
    out.append(f"{dst} AS (SELECT {other}, CAST({_packed(axis, 0)} AS BIGINT) AS {axis}, CASE WHEN n = 1 THEN v WHEN {axis} % 2 = 1 THEN v * {_K!r}::FLOAT ELSE v * (1::FLOAT / {_K!r}::FLOAT) END AS v FROM {last})")
    return ",\n".join(out)


def level53(src: str, dst: str, keys: str = "", y0: int = 0, x0: int = 0) -> str:
    return line53(src, f"{dst}_v", "y", "x", keys, y0) + ",\n" + line53(f"{dst}_v", dst, "x", "y", keys, x0)


_H = "(SELECT max(y) + 1 FROM plane)"
_BAND = "CASE WHEN y < lh AND x < lw THEN 'LL1' WHEN y < lh THEN 'HL1' WHEN x < lw THEN 'LH1' ELSE 'HH1' END"
_YCC = "ycc AS (SELECT CAST(c AS BIGINT) AS component, y, x, CASE c WHEN 0 THEN ((r + 2 * g + b) >> 2) - 128 WHEN 1 THEN b - g ELSE r - g END AS v FROM rgb, range(0, 3) t(c))"


@query(
    "dwt53_level1_energy",
    f"""WITH {RGB}, {_YCC}, {level53("ycc", "t", "component, ")}, e AS (SELECT *, (max(y) OVER () + 2) // 2 AS lh, 50 AS lw FROM t)
    SELECT component, {_BAND} AS band, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * v) AS BIGINT) AS sum_v2 FROM e GROUP BY ALL""",
)
def dwt53_level1_energy(spark, d):
    """Flagship: colour transform, one wavelet level, energy of each component and subband."""
    rgb = rgb_events(spark, d)
    c = color.rct(F.col("r"), F.col("g"), F.col("b"))
    planes = to_planes(rgb.select("y", "x", *ints(c0=c[0], c1=c[1], c2=c[2])), ("c0", "c1", "c2"))
    height = _height(rgb)
    moved = lifting.forward_level(planes, ["component"])
    return stats.energy(moved.withColumn("band", wavelets.band_of(F.col("y"), F.col("x"), height, 100, 1)), ["component", "band"]).select("component", "band", *ints(n="n", sum_v="sum_v", sum_v2="sum_v2"))


def _height(df) -> int:
    """Rows of a raster: one number, which the geometry needs before the plan can be built."""
    top = df.agg(F.max("y")).first()[0]
    return 0 if top is None else int(top) + 1


@query("dwt53_odd_origin", f"WITH {PLANE}, {level53('plane', 't', '', 3, 5)} SELECT y, x, v FROM t")
def dwt53_odd_origin(spark, d):
    return lifting.forward_level(embedding_plane(spark, d), [], "5/3", 3, 5).select(*ints(y="y", x="x", v="v"))


@query("dwt53_roundtrip", f"WITH {PLANE} SELECT y, x, v FROM plane")
def dwt53_roundtrip(spark, d):
    return lifting.inverse_level(lifting.forward_level(embedding_plane(spark, d), []), []).select(*ints(y="y", x="x", v="v"))


@query("dwt53_columns", f"WITH {PLANE}, {line53('plane', 't', 'y', 'x')} SELECT y, x, v FROM t")
def dwt53_columns(spark, d):
    return lifting.forward_53(embedding_plane(spark, d), "y", ["x"]).select(*ints(y="y", x="x", v="v"))


@query("dwt53_columns_inverse", f"WITH {PLANE} SELECT y, x, v FROM plane")
def dwt53_columns_inverse(spark, d):
    return lifting.inverse_53(lifting.forward_53(embedding_plane(spark, d), "y", ["x"]), "y", ["x"]).select(*ints(y="y", x="x", v="v"))


def _levels53(levels: int, heights: str, width: int) -> tuple[str, str]:
    """CTEs of a multi-level transform; returns them and the last one's name.  The corner is cut out and put back."""
    out, src, w = [], "plane", width
    sizes = [heights]
    for k in range(1, levels + 1):
        h = sizes[-1]
        corner = f"c{k}"
        out.append(f"{corner} AS (SELECT y, x, v FROM {src} WHERE y < {h} AND x < {w})")
        out.append(level53(corner, f"f{k}"))
        out.append(f"p{k} AS (SELECT y, x, v FROM f{k} UNION ALL SELECT y, x, v FROM {src} WHERE NOT (y < {h} AND x < {w}))")
        src, w = f"p{k}", (w + 1) // 2
        sizes.append(f"(({h} + 1) // 2)")
    # each step once, not once for every use of it
    return re.sub(r"(\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", ",\n".join(out)), src


_ML, _LAST = _levels53(3, _H, 64)


@query("dwt53_multilevel", f"WITH {PLANE}, {_ML} SELECT y, x, v FROM {_LAST}")
def dwt53_multilevel(spark, d):
    plane = embedding_plane(spark, d)
    return wavelets.forward_levels(plane, _height(plane), 64, 3, []).select(*ints(y="y", x="x", v="v"))


@query("dwt53_multilevel_roundtrip", f"WITH {PLANE} SELECT y, x, v FROM plane")
def dwt53_multilevel_roundtrip(spark, d):
    plane = embedding_plane(spark, d)
    h = _height(plane)
    return wavelets.inverse_levels(wavelets.forward_levels(plane, h, 64, 2, []), h, 64, 2, []).select(*ints(y="y", x="x", v="v"))


_R1, _ = _levels53(1, _H, 64)


@query("dwt53_reduced", f"WITH {PLANE}, {_R1} SELECT y, x, v FROM p1 WHERE y < ({_H} + 1) // 2 AND x < 32")
def dwt53_reduced(spark, d):
    """Three levels forward, inverse without the finest: the first level's low-pass plane."""
    plane = embedding_plane(spark, d)
    h = _height(plane)
    return wavelets.inverse_levels(wavelets.forward_levels(plane, h, 64, 3, []), h, 64, 3, [], reduce=1).select(*ints(y="y", x="x", v="v"))


@query("dwt53_checked", f"WITH {PLANE} SELECT y, x, v FROM plane")
def dwt53_checked(spark, d):
    """The inverse that errs where a sample leaves 32 bits: on coefficients of a plane it gives the plane."""
    return lifting.inverse_level(lifting.forward_level(embedding_plane(spark, d), []), [], checked=True).select(*ints(y="y", x="x", v="v"))


@query(
    "dwt53_overflow",
    f"""WITH {PLANE}, p AS (SELECT y, x % 2 AS x, x // 2 AS pair, v * 16777216 AS v FROM plane), q AS (SELECT y, pair, max(CASE WHEN x = 0 THEN v END) AS lo, max(CASE WHEN x = 1 THEN v END) AS hi FROM p GROUP BY 1, 2),
    r AS (SELECT y, pair, lo - ((2 * hi + 2) >> 2) AS s, hi FROM q)
    SELECT y, pair, s BETWEEN -2147483648 AND 2147483647 AND hi + s BETWEEN -2147483648 AND 2147483647 AS fits FROM r""",
)
def dwt53_overflow(spark, d):
    """Pairs of large coefficients as lines of two: whether their inverse fits 32 bits, without the error."""
    rows = embedding_plane(spark, d).select("y", F.expr("x div 2").alias("pair"), (F.col("x") % 2).alias("x"), (F.col("v") * 16777216).alias("v"))
    made = lifting.inverse_53(rows, "x", ["y", "pair"])
    return made.groupBy("y", "pair").agg(F.bool_and(lifting.fits32(F.col("v"))).alias("fits")).select(*ints(y="y", pair="pair"), "fits")


_TILED = "tl AS (SELECT y // 32 AS ty, x // 32 AS tx, y % 32 AS y, x % 32 AS x, v FROM plane)"


@query(
    "dwt53_tiles",
    f"""WITH {PLANE}, {_TILED}, {level53("tl", "t", "ty, tx, ")} SELECT ty * 32 + y AS y, tx * 32 + x AS x, v FROM t""",
)
def dwt53_tiles(spark, d):
    """Block form: every 32x32 tile in one numpy kernel, one exchange for the tiling."""
    blocks = to_blocks(embedding_plane(spark, d), 32, 32)
    return to_samples(wavelets.transform_tiles(blocks, [], 1)).select(*ints(y="y", x="x", v="v"))


@query("dwt53_tiles_roundtrip", f"WITH {PLANE} SELECT y, x, v FROM plane")
def dwt53_tiles_roundtrip(spark, d):
    blocks = wavelets.transform_tiles(to_blocks(embedding_plane(spark, d), 32, 32), [], 3)
    return to_samples(wavelets.transform_tiles(blocks, [], 3, inverse=True)).select(*ints(y="y", x="x", v="v"))


_L97 = line97("plane", "q", "y", "x") + ",\n" + line97("q", "t", "x", "y")


@query("dwt97_level1", f"WITH {PLANE}, {_L97} SELECT y, x, v::DOUBLE AS v FROM t")
def dwt97_level1(spark, d):
    return lifting.forward_level(embedding_plane(spark, d), [], "9/7").select(*ints(y="y", x="x"), *reals(v="v"))


@query("dwt97_columns", f"WITH {PLANE}, {line97('plane', 'q', 'y', 'x')} SELECT y, x, v::DOUBLE AS v FROM q")
def dwt97_columns(spark, d):
    return lifting.forward_97(embedding_plane(spark, d), "y", ["x"]).select(*ints(y="y", x="x"), *reals(v="v"))


@query("dwt97_roundtrip_error", f"WITH {PLANE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS beyond FROM plane")
def dwt97_roundtrip_error(spark, d):
    """Samples that the inverse misses by a thousandth or more: none."""
    plane = embedding_plane(spark, d)
    back = lifting.inverse_level(lifting.forward_level(plane, [], "9/7"), [], "9/7").select("y", "x", F.col("v").alias("w"))
    return plane.join(back, ["y", "x"]).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("v") - F.col("w")) >= 0.001).alias("beyond"))


_LF = """{dst}_1 AS (SELECT y, x, v::FLOAT AS v, coalesce(lag(v) OVER w0, lead(v) OVER w0)::FLOAT AS l, coalesce(lead(v) OVER w0, lag(v) OVER w0)::FLOAT AS r FROM {src} WINDOW w0 AS (PARTITION BY y ORDER BY x)),
{dst}_2 AS (SELECT y, x, CASE WHEN x % 2 = 1 THEN v - floor((l + r) / 2::FLOAT) ELSE v END AS v FROM {dst}_1),
{dst}_3 AS (SELECT y, x, v, coalesce(lag(v) OVER w0, lead(v) OVER w0) AS l, coalesce(lead(v) OVER w0, lag(v) OVER w0) AS r FROM {dst}_2 WINDOW w0 AS (PARTITION BY y ORDER BY x)),
{dst} AS (SELECT y, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 32 + x // 2 END AS x, CASE WHEN x % 2 = 0 THEN v + floor((l + r + 2::FLOAT) / 4::FLOAT) ELSE v END AS v FROM {dst}_3)""".format


@query("dwt53_float_line", f"WITH {PLANE}, {_LF(src='plane', dst='t')} SELECT y, CAST(x AS BIGINT) AS x, v::DOUBLE AS v FROM t")
def dwt53_float_line(spark, d):
    """The single-precision 5/3 line of the simple container: floors of float sums."""
    lines = embedding_plane(spark, d).withColumn("v", F.col("v").cast("float"))
    return lifting.forward_53_float(lines, "x", ["y"]).select(*ints(y="y", x="x"), *reals(v="v"))


@query("dwt53_float_columns", f"WITH {PLANE}, h AS (SELECT y, x, v::FLOAT + 0.25::FLOAT * (x % 4)::FLOAT AS v FROM plane), {_LF(src='h', dst='t')} SELECT y, CAST(x AS BIGINT) AS x, v::DOUBLE AS v FROM t")
def dwt53_float_columns(spark, d):
    """The same on samples with fractions, where the float line is not the integer one."""
    lines = embedding_plane(spark, d).withColumn("v", F.col("v").cast("float") + F.lit(0.25).cast("float") * (F.col("x") % 4).cast("float"))
    return lifting.forward_53_float(lines, "x", ["y"]).select(*ints(y="y", x="x"), *reals(v="v"))


@query("pack_unpack", "SELECT CAST(n AS BIGINT) AS n, CAST(o AS BIGINT) AS origin, CAST(i AS BIGINT) AS place, CAST(row_number() OVER (PARTITION BY n, o ORDER BY (i + o) % 2, i) - 1 AS BIGINT) AS packed, CAST((o + n + 1) // 2 - (o + 1) // 2 AS BIGINT) AS lows FROM range(1, 18) t(n), range(0, 6) u(o), range(0, 18) w(i) WHERE i < n")
def pack_unpack(spark, d):
    out = None
    for origin in range(6):
        rows = spark.range(1, 18).withColumnRenamed("id", "n").withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        part = rows.select("n", *ints(origin=F.lit(origin), place="place", packed=lifting.packed_place(F.col("place"), F.col("n"), origin), lows=lifting.low_count(F.col("n"), origin)))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "decomposable",
    """SELECT p_partkey AS part, CAST(l AS BIGINT) AS levels, (w + x0 + (1 << l) - 1) // (1 << l) - (x0 + (1 << l) - 1) // (1 << l) > 0 AND (h + y0 + (1 << l) - 1) // (1 << l) - (y0 + (1 << l) - 1) // (1 << l) > 0 AS possible
    FROM (SELECT p_partkey, p_partkey % 13 AS x0, p_size % 7 AS y0, 1 + p_partkey % 37 AS w, 1 + p_size % 29 AS h FROM part), range(0, 9) t(l)""",
)
def decomposable(spark, d):
    """Whether an area has samples left after so many levels."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), *ints(x0=F.col("p_partkey") % 13, y0=F.col("p_size") % 7, w=1 + F.col("p_partkey") % 37, h=1 + F.col("p_size") % 29))
    rows = rows.withColumn("levels", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return rows.select("part", *ints(levels="levels"), lifting.decomposes(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"), F.col("levels")).alias("possible"))


@query(
    "simple_codec_quantized",
    f"""WITH {PLANE}, s AS (SELECT y, x, greatest(0, least(255, v + 128)) - 128 AS v FROM plane), {level53("s", "t")},
    q AS (SELECT y, x, v::FLOAT / 2.5::FLOAT AS q FROM t)
    SELECT y, x, CAST(greatest(-32768, least(32767, CASE WHEN q >= 0 THEN floor(q + 0.5::FLOAT) ELSE ceil(q - 0.5::FLOAT) END)) AS BIGINT) AS q FROM q""",
)
def simple_codec_quantized(spark, d):
    """Shift, one level, quantise: the simple codec's payload."""
    gray = embedding_plane(spark, d).withColumn("v", color.clamp(F.col("v") + 128, 8) - 128)
    return lifting.forward_level(gray, []).select(*ints(y="y", x="x", q=color.quantized(F.col("v"), 2.5)))


@query("simple_codec_roundtrip", f"WITH {PLANE} SELECT y, x, CAST(greatest(0, least(255, v + 128)) AS BIGINT) AS v FROM plane")
def simple_codec_roundtrip(spark, d):
    """Step 1 on the reversible path loses nothing."""
    gray = embedding_plane(spark, d).withColumn("v", color.clamp(F.col("v") + 128, 8) - 128)
    coded = lifting.forward_level(gray, []).withColumn("v", color.quantized(F.col("v"), 1.0))
    return lifting.inverse_level(coded, []).select(*ints(y="y", x="x", v=color.clamp(F.col("v") + 128, 8)))


@query("region_through_dwt", f"WITH {PLANE} SELECT y, x, v FROM plane WHERE y >= 100 AND y < 140 AND x >= 20 AND x < 37")
def region_through_dwt(spark, d):
    """A region decoded from stored coefficients: the scans read what it depends on."""
    plane = embedding_plane(spark, d)
    h = _height(plane)
    coded = written(wavelets.forward_levels(plane, h, 64, 2, []), "coefficients")
    return wavelets.decode_region(coded, h, 64, 2, (100, 20, 140, 37), []).select(*ints(y="y", x="x", v="v"))


@query("resolution_selector", f"WITH {PLANE}, {_ML} SELECT y, x, v FROM {_LAST} WHERE y < ((({_H} + 1) // 2) + 1) // 2 AND x < 16")
def resolution_selector(spark, d):
    """Levels kept by a filter below the inverse: what two dropped levels leave of the coefficients."""
    plane = embedding_plane(spark, d)
    h = _height(plane)
    coded = wavelets.forward_levels(plane, h, 64, 3, [])
    return coded.where((F.col("y") < ((h + 1) // 2 + 1) // 2) & (F.col("x") < 16)).select(*ints(y="y", x="x", v="v"))
