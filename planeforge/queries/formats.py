"""Formats, containers, marker segments and coders over the tables: what is written must be read back.

Images are the strips of the tables' rasters; every strip goes through each format.
"""

from __future__ import annotations

import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import jvm
from ..functions import curves
from ..operators import geometry, t2
from ..plans import codec
from ..rasters import embedding_plane, rgb_events, signed_ramp, table, to_blocks, to_planes
from ..session import scratch, written
from ..sources import codestream, images, jp2, jpeg, markers, png, tiff
from ..sources.codestream import Options
from .codec import STRIP
from .registry import PLANE, RGB, ints, query

_FILES = "path string, content binary"
_FILE_TYPE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _strip():
    """The number of the strip that a file's name tells."""
    return F.regexp_extract("path", r"(\d+)\.[a-z0-9]+$", 1).cast("bigint")


def strips(spark, d, channels, layout: str, precision: int = 8, signed: bool = False, alpha_mode: str | None = None) -> DataFrame:
    """Strips of 50 rows as images; ``channels`` are expressions over ``y, x, r, g, b``."""
    names = [f"c{k}" for k in range(len(channels))]
    made = rgb_events(spark, d).select("y", "x", *[F.expr(c).cast("bigint").alias(n) for c, n in zip(channels, names, strict=True)])
    planes = to_planes(made, tuple(names)).withColumn("strip", F.expr(f"y div {STRIP}")).withColumn("y", F.col("y") % STRIP)
    blocks = to_blocks(planes, STRIP, 100, ("strip", "component"))
    plane = F.struct(
        F.col("component").cast("int").alias("component"), F.lit(precision).alias("precision"), F.lit(signed).alias("signed"), F.lit(1).alias("x_step"), F.lit(1).alias("y_step"), F.lit(0).alias("x0"), F.lit(0).alias("y0"),
        F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), "samples",
    )
    gathered = blocks.groupBy("strip").agg(F.sort_array(F.collect_list(plane)).alias("planes"))
    null = F.lit(None)
    return gathered.select(
        F.concat(F.lit("strip"), F.lpad(F.col("strip").cast("string"), 6, "0"), F.lit(".raw")).alias("path"), F.lit(layout).alias("layout"), F.lit(alpha_mode).cast("string").alias("alpha_mode"), F.lit(False).alias("white_is_zero"), F.lit(0).alias("origin_x"), F.lit(0).alias("origin_y"),
        *[null.cast("binary").alias(n) for n in ("icc", "exif", "xmp", "iptc")], "planes",
    )


def rows_of(decoded: DataFrame, *more) -> DataFrame:
    """``y, x, component, v`` of strips."""
    names = decoded.select(*more).columns if more else []
    rows = images.samples_of(decoded, _strip().alias("_strip"), *more)
    return rows.select(*names, *ints(y=F.col("_strip") * STRIP + F.col("y"), x="x", component="component", v="v"))


def mapped(rows: DataFrame, make, out: str = _FILES, schema: pa.Schema = _FILE_TYPE) -> DataFrame:
    """``make`` gives the rows that one row becomes; few of either are held at a time."""

    def run(batches):
        for batch in images.portions(batches):
            made = (x for row in batch.to_pylist() for x in make(row))
            while part := list(itertools.islice(made, 4096)):
                yield pa.RecordBatch.from_pylist(part, schema=schema)

    return rows.mapInArrow(run, out)


def samples_sql(*channels: str) -> str:
    parts = " UNION ALL ".join(f"SELECT y, x, CAST({k} AS BIGINT) AS component, CAST({c} AS BIGINT) AS v FROM rgb" for k, c in enumerate(channels))
    return f"WITH {RGB} {parts}"


def _roundtrip(name: str, kind: str, channels: tuple[str, ...], layout: str, **more) -> None:
    """Registers a query that writes strips in a format and reads them back."""

    @query(name, samples_sql(*channels))
    def run(spark, d):
        return rows_of(images.decode_images(images.encode_images(strips(spark, d, channels, layout, **more), kind), kind=kind))


_RGB8, _GRAY16 = ("r", "g", "b"), ("r + 256 * g",)
_RGBA8 = (*_RGB8, "(r + g) % 256")
_roundtrip("tiff_rgb_roundtrip", "tif", _RGB8, "rgb")
_roundtrip("tiff_gray16_roundtrip", "tif", _GRAY16, "gray", precision=16)
_roundtrip("tiff_alpha_roundtrip", "tif", _RGBA8, "rgba", alpha_mode="unassociated")
_roundtrip("bmp_roundtrip", "bmp", _RGB8, "rgb")
_roundtrip("png_rgb_roundtrip", "png", _RGB8, "rgb")
_roundtrip("png_alpha16_roundtrip", "png", ("r + 256 * g", "g + 256 * b"), "graya", precision=16, alpha_mode="unassociated")
_roundtrip("pgm_roundtrip", "pgm", ("g",), "gray")
_roundtrip("pgx_signed_roundtrip", "pgx", ("r * 16 + g % 16 - 2048",), "planar", precision=12, signed=True)
_roundtrip("zraw_roundtrip", "zraw", ("r + 256 * g - 32768", "b * 128 - 16384"), "planar", precision=16, signed=True)
_roundtrip("jp2_rgb_roundtrip", "jp2", _RGB8, "rgb")
_roundtrip("jp2_alpha_roundtrip", "jp2", _RGBA8, "rgba", alpha_mode="unassociated")
_roundtrip("jp2_gray16_roundtrip", "jp2", _GRAY16, "gray", precision=16)


@query(
    "png_filters_roundtrip",
    f"WITH {RGB} SELECT CAST(f AS BIGINT) AS filter, y, x, CAST(c AS BIGINT) AS component, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb, range(0, 3) t(c), range(0, 5) u(f)",
)
def png_filters_roundtrip(spark, d):
    """None, Sub, Up, Average and Paeth: every strip under every filter."""
    rows = strips(spark, d, _RGB8, "rgb").withColumn("filter", F.explode(F.array(*map(F.lit, range(5)))))
    files = mapped(rows, lambda row: [{"path": f"{row['filter']}/{row['path'][:-4]}.png", "content": png.write_png(images.from_row(row), filter_type=row["filter"])}])
    return rows_of(images.decode_images(files), F.substring("path", 1, 1).cast("bigint").alias("filter"))


@query(
    "tiff_directories",
    f"""WITH {RGB}, s AS (SELECT y // 50 AS strip, CAST(max(y % 50) + 1 AS BIGINT) AS h FROM rgb GROUP BY 1)
    SELECT strip, CAST(tag AS BIGINT) AS tag, CAST(CASE tag WHEN 256 THEN 100 WHEN 257 THEN h WHEN 258 THEN 8 WHEN 259 THEN 1 WHEN 262 THEN 2 WHEN 277 THEN 3 ELSE h * 300 END AS BIGINT) AS value
    FROM s, (VALUES (256), (257), (258), (259), (262), (277), (279)) t(tag)""",
)
def tiff_directories(spark, d):
    """The tags of a directory, first values; no sample is read."""
    files = images.encode_images(strips(spark, d, _RGB8, "rgb"), "tif")
    wanted = (256, 257, 258, 259, 262, 277, 279)

    def tags(row):
        ifd = tiff.directories(row["content"])[0]
        return [{"path": row["path"], "tag": t, "value": int(ifd[t].values[0])} for t in wanted]

    out = mapped(files, tags, "path string, tag bigint, value bigint", pa.schema([("path", pa.string()), ("tag", pa.int64()), ("value", pa.int64())]))
    return out.select(_strip().alias("strip"), "tag", "value")


@query("tiff_icc_tag", f"WITH {RGB} SELECT DISTINCT y // 50 AS strip, CAST(k AS BIGINT) AS place, CAST(65536 * (k % 4) // 8 + (y // 50) % 1000 AS BIGINT) AS fixed FROM rgb, range(0, 9) t(k)")
def tiff_icc_tag(spark, d):
    """A profile in the ICC tag, its colorants read back from the file."""

    def made(row):
        raster = images.from_row(row)
        n = int(row["path"][5:11]) % 1000
        raster.icc = curves.build_linear_profile(np.array([(65536 * (k % 4) // 8 + n) / 65536 for k in range(9)]).reshape(3, 3))
        return [{"path": f"{row['path'][:-4]}.tif", "content": tiff.write_tiff(raster)}]

    files = mapped(strips(spark, d, _RGB8, "rgb"), made)

    def read(row):
        matrix, _ = curves.parse_profile(row["icc"])
        return [{"path": row["path"], "place": k, "fixed": int(round(v * 65536))} for k, v in enumerate(matrix.ravel())]

    out = mapped(images.decode_images(files).select("path", "icc"), read, "path string, place bigint, fixed bigint", pa.schema([("path", pa.string()), ("place", pa.int64()), ("fixed", pa.int64())]))
    return out.select(_strip().alias("strip"), "place", "fixed")


def _flat_jpegs(spark, d, quantiser: int, restart: int) -> DataFrame:
    def made(row):
        plane = images.from_row(row).planes[0].samples
        meta = {"exif": b"II*\0" + row["path"].encode(), "xmp": b"<x>" + row["path"].encode() + b"</x>", "iptc": b"\x1c\x02\x05" + struct.pack(">H", len(row["path"])) + row["path"].encode()}
        return [{"path": f"{row['path'][:-4]}.jpg", "content": jpeg.write_flat((plane * 8 - 1024) // quantiser, quantiser, restart, meta)}]

    return mapped(strips(spark, d, ("r",), "gray"), made)


@query("jpeg_flat_blocks", f"WITH {RGB} SELECT CAST(q AS BIGINT) AS quantiser, y, x, r AS low, r AS high, CAST(64 AS BIGINT) AS n FROM rgb, (VALUES (1), (2), (8)) t(q)")
def jpeg_flat_blocks(spark, d):
    """Marker walk, Huffman codes, DC prediction with restarts, dequantisation and inverse DCT: a block a pixel."""
    out = None
    for quantiser, restart in ((1, 0), (2, 7), (8, 64)):
        found = images.cell_ranges(_flat_jpegs(spark, d, quantiser, restart), 8).select(_strip().alias("strip"), F.explode("cells").alias("c"))
        part = found.select(F.lit(quantiser).cast("bigint").alias("quantiser"), *ints(y=F.col("strip") * STRIP + F.col("c.y"), x="c.x", low="c.low", high="c.high", n="c.n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "jpeg_metadata",
    f"""WITH {RGB}, s AS (SELECT DISTINCT y // 50 AS strip, 'strip' || lpad(CAST(y // 50 AS VARCHAR), 6, '0') || '.raw' AS p FROM rgb)
    SELECT strip, CAST(4 + strlen(p) AS BIGINT) AS exif_bytes, sha256('<x>' || p || '</x>') AS xmp, CAST(5 + strlen(p) AS BIGINT) AS iptc_bytes FROM s""",
)
def jpeg_metadata(spark, d):
    """APP1 (Exif, XMP) and APP13 (IPTC) on the way through."""
    found = images.decode_images(_flat_jpegs(spark, d, 1, 0))
    return found.select(_strip().alias("strip"), *ints(exif_bytes=F.octet_length("exif")), F.sha2("xmp", 256).alias("xmp"), *ints(iptc_bytes=F.octet_length("iptc")))


_DNG = "CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({v} * 16 - 100) / 2900.0::DOUBLE)) * 65535 + 0.5::DOUBLE) AS BIGINT)".format


def _dngs(spark, d) -> DataFrame:
    def made(row):
        samples = np.dstack([p.samples for p in images.from_row(row).planes])
        return [{"path": f"{row['path'][:-4]}.dng", "content": tiff.write_linear_dng(samples * 16, 100, 3000)}]

    return mapped(strips(spark, d, _RGB8, "rgb"), made)


@query("dng_roundtrip", samples_sql(*(_DNG(v=c) for c in _RGB8)))
def dng_roundtrip(spark, d):
    """LinearRaw, normalised between its levels to the full range."""
    return rows_of(images.decode_images(_dngs(spark, d)))


@query(
    "dng_directories",
    f"WITH {RGB}, s AS (SELECT y // 50 AS strip, CAST(max(y % 50) + 1 AS BIGINT) AS h FROM rgb GROUP BY 1) SELECT strip, CAST(tag AS BIGINT) AS tag, CAST(CASE tag WHEN 257 THEN h ELSE value END AS BIGINT) AS value FROM s, (VALUES (256, 100), (257, 0), (262, 34892), (50714, 100), (50717, 3000)) t(tag, value)",
)
def dng_directories(spark, d):
    def tags(row):
        ifd = tiff.dng_info(row["content"])[0]
        return [{"path": row["path"], "tag": t, "value": int(ifd[t][0])} for t in (256, 257, 262, 50714, 50717)]

    out = mapped(_dngs(spark, d), tags, "path string, tag bigint, value bigint", pa.schema([("path", pa.string()), ("tag", pa.int64()), ("value", pa.int64())]))
    return out.select(_strip().alias("strip"), "tag", "value")


_HALF = "CAST(floor((r * 4 + g % 4) * 65535 / 1024.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


@query("exr_roundtrip", samples_sql(_HALF, _HALF.replace("r * 4 + g % 4", "b * 4"), _HALF.replace("r * 4 + g % 4", "1020 - g * 4")))
def exr_roundtrip(spark, d):
    """HALF channels: samples that are 1024ths of the range are held exactly."""
    half = "floor(({}) * 65535 / 1024D + 0.5D)".format
    images_ = strips(spark, d, (half("r * 4 + g % 4"), half("b * 4"), half("1020 - g * 4")), "rgb", precision=16)
    return rows_of(images.decode_images(images.encode_images(images_, "exr")))


@query(
    "exr_chromaticities",
    f"WITH {RGB} SELECT DISTINCT y // 50 AS strip, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS BIGINT) AS hundredths FROM rgb, (VALUES (0, 0, 44), (0, 1, 39), (0, 2, 14), (1, 0, 22), (1, 1, 72), (1, 2, 6), (2, 0, 1), (2, 1, 10), (2, 2, 71)) t(i, j, v)",
)
def exr_chromaticities(spark, d):
    """The primaries of a file, adapted to D50: those of Rec. 709, rounded to hundredths."""
    files = images.encode_images(strips(spark, d, _RGB8, "rgb", precision=16), "exr")

    def made(row):
        matrix = images.READERS["exr"](row["content"]).matrix
        return [{"path": row["path"], "i": i, "j": j, "hundredths": int(round(matrix[i][j] * 100))} for i in range(3) for j in range(3)]

    out = mapped(files, made, "path string, i bigint, j bigint, hundredths bigint", pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("i", "j", "hundredths"))]))
    return out.select(_strip().alias("strip"), "i", "j", "hundredths")


_PALETTE = ("(r % 16) * 16", "255 - (r % 16) * 16", "(r % 16) * (r % 16)")


@query("jp2_palette_roundtrip", samples_sql(*_PALETTE))
def jp2_palette_roundtrip(spark, d):
    """Indexes with a palette and component mapping in the container; colours come out."""
    palette = np.array([[16 * k, 255 - 16 * k, k * k] for k in range(16)])

    def made(row):
        return [{"path": f"{row['path'][:-4]}.jp2", "content": jp2.wrap(row["stream"], palette=palette)}]

    coded = images.streams(strips(spark, d, ("r % 16",), "gray"), Options(levels=1))
    return rows_of(images.decode_images(mapped(coded, made), kind="jp2"))


def _containers(spark, d) -> DataFrame:
    def made(row):
        name = row["path"].encode()
        return [{"path": f"{row['path'][:-4]}.jp2", "content": jp2.attach(images.boxed(row), {"xmp": b"<x>" + name + b"</x>", "exif": b"MM\0*" + name})}]

    return mapped(images.streams(strips(spark, d, _RGB8, "rgb"), Options(levels=2, tile_w=64, tile_h=32, layers=2, rates=(4.0,), progression="LRCP")), made)


@query(
    "jp2_metadata",
    f"""WITH {RGB}, s AS (SELECT DISTINCT y // 50 AS strip, 'strip' || lpad(CAST(y // 50 AS VARCHAR), 6, '0') || '.raw' AS p FROM rgb)
    SELECT strip, k AS kind, sha256(CASE k WHEN 'xmp' THEN '<x>' || p || '</x>' ELSE 'MM' || chr(0) || '*' || p END) AS sha256 FROM s, (VALUES ('xmp'), ('exif')) t(k)""",
)
def jp2_metadata(spark, d):
    """Metadata boxes that were attached, found again."""
    import hashlib

    def made(row):
        return [{"path": row["path"], "kind": k, "sha256": hashlib.sha256(v).hexdigest()} for k, v in jp2.parse(row["content"]).metadata.items()]

    out = mapped(_containers(spark, d), made, "path string, kind string, sha256 string", pa.schema([(n, pa.string()) for n in ("path", "kind", "sha256")]))
    return out.select(_strip().alias("strip"), "kind", "sha256")


_BOXES = ("jP  ", "ftyp", "jp2h", "ihdr", "colr", "uuid", "uuid", "jp2c")


@query("jp2_boxes", f"WITH {RGB} SELECT DISTINCT y // 50 AS strip, CAST(n AS BIGINT) AS place, k AS kind FROM rgb, (VALUES {', '.join(f'({n}, {k!r})' for n, k in enumerate(_BOXES))}) t(n, k)")
def jp2_boxes(spark, d):
    """Boxes in file order, those of the header box behind it."""

    def made(row):
        found = sorted(jp2.boxes(row["content"]), key=lambda b: b.offset)
        return [{"path": row["path"], "place": n, "kind": b.kind} for n, b in enumerate(found)]

    out = mapped(_containers(spark, d), made, "path string, place bigint, kind string", pa.schema([("path", pa.string()), ("place", pa.int64()), ("kind", pa.string())]))
    return out.select(_strip().alias("strip"), "place", "kind")


@query(
    "jp2_info",
    f"""WITH {RGB}, s AS (SELECT y // 50 AS strip, max(y % 50) + 1 AS h FROM rgb GROUP BY 1)
    SELECT strip, CAST(100 AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(3 AS BIGINT) AS components, CAST(2 * ((h + 31) // 32) AS BIGINT) AS tiles, CAST(2 AS BIGINT) AS levels, CAST(2 AS BIGINT) AS layers, 'LRCP' AS progression, true AS reversible FROM s""",
)
def jp2_info(spark, d):
    """What a header says, no packet being read."""
    found = images.infos(_containers(spark, d))
    return found.select(_strip().alias("strip"), *ints(width="width", height="height", components="components", tiles="tiles", levels="levels", layers="layers"), "progression", "reversible")


@query("signed_ramp", "SELECT i // 37 AS y, i % 37 AS x, CAST(CASE WHEN i = 37 * 29 - 1 THEN 2047 ELSE i * 4096 // (37 * 29) - 2048 END AS BIGINT) AS v FROM range(0, 37 * 29) t(i)")
def signed_ramp_query(spark, d):
    return signed_ramp(spark, 37, 29).select(*ints(y="y", x="x", v="v"))


@query(
    "signed_pgx_file",
    "SELECT CAST(p AS BIGINT) AS precision, i // 37 AS y, i % 37 AS x, CAST(CASE WHEN i = 37 * 29 - 1 THEN (1 << (p - 1)) - 1 ELSE i * (1 << p) // (37 * 29) - (1 << (p - 1)) END AS BIGINT) AS v FROM range(0, 37 * 29) t(i), (VALUES (8), (12), (24)) u(p)",
)
def signed_pgx_file(spark, d):
    """The ramp through a file of each sample width."""
    from ..sources import plain
    from ..sources.raster import Plane, Raster

    out = None
    for precision in (8, 12, 24):
        rows = signed_ramp(spark, 37, 29, precision).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s")).select(F.transform("s", lambda s: s["v"]).alias("samples"))

        def made(row, precision=precision):
            raster = Raster([Plane(np.array(row["samples"]).reshape(29, 37), precision, True)], "planar")
            return [{"path": "ramp.pgx", "content": plain.write_pgx(raster)}]

        part = images.samples_of(images.decode_images(mapped(rows, made))).select(F.lit(precision).cast("bigint").alias("precision"), *ints(y="y", x="x", v="v"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- profiles and matrices ----

_ENTRY = "(n_nationkey * 7 + {k} * 13) % 97 / 128.0::DOUBLE + CASE WHEN {k} % 4 = 0 THEN 1 ELSE 0 END".format


@query("icc_profile_build", "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(k AS BIGINT) AS place, CAST(round((" + _ENTRY(k="k") + ") * 65536) AS BIGINT) AS fixed FROM nation, range(0, 9) t(k)")
def icc_profile_build(spark, d):
    """A profile written with a matrix, its colorants read back as the fixed-point numbers they are."""

    def made(row):
        n = row["n_nationkey"]
        m = np.array([(n * 7 + k * 13) % 97 / 128 + (k % 4 == 0) for k in range(9)]).reshape(3, 3)
        back, found = curves.parse_profile(curves.build_linear_profile(m))
        assert all(c.sampled(np.array([0.25]))[0] == 0.25 for c in found)
        return [{"nation": n, "place": k, "fixed": int(round(back.ravel()[k] * 65536))} for k in range(9)]

    return mapped(table(spark, d, "nation").select("n_nationkey"), made, "nation bigint, place bigint, fixed bigint", pa.schema([(n, pa.int64()) for n in ("nation", "place", "fixed")]))


@query(
    "matrix_inverse",
    """WITH m AS (SELECT n_nationkey AS n, n_nationkey + 2.0::DOUBLE AS a, 1.0::DOUBLE AS b, n_nationkey % 3 + 0.0::DOUBLE AS c, n_nationkey + 3.0::DOUBLE AS e, n_nationkey + 4.0::DOUBLE AS i FROM nation),
    -- (a b c; 0 e b; b 0 i)
    d AS (SELECT *, a * e * i + b * (b * b - c * e) AS det FROM m)
    SELECT CAST(n AS BIGINT) AS nation, CAST(k AS BIGINT) AS place, CAST(round(CASE k WHEN 0 THEN e * i WHEN 1 THEN -b * i WHEN 2 THEN b * b - c * e WHEN 3 THEN b * b WHEN 4 THEN a * i - b * c WHEN 5 THEN -a * b WHEN 6 THEN -e * b WHEN 7 THEN b * b ELSE a * e END / det * 1e9) AS BIGINT) AS billionths
    FROM d, range(0, 9) t(k)""",
)
def matrix_inverse(spark, d):
    def made(row):
        n = row["n_nationkey"]
        back = curves.invert(np.array([[n + 2, 1, n % 3], [0, n + 3, 1], [1, 0, n + 4]], dtype=float)).ravel()
        return [{"nation": n, "place": k, "billionths": int(np.floor(abs(back[k]) * 1e9 + 0.5) * (1 if back[k] >= 0 else -1))} for k in range(9)]

    return mapped(table(spark, d, "nation").select("n_nationkey"), made, "nation bigint, place bigint, billionths bigint", pa.schema([(n, pa.int64()) for n in ("nation", "place", "billionths")]))


# ---- entropy and packet coding ----

_DOCS = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents"


@query("mq_roundtrip", _DOCS.replace("SELECT", "SELECT CAST(p AS BIGINT) AS predictable,") + ", range(0, 2) t(p)")
def mq_roundtrip(spark, d):
    """Every bit of every text through the MQ coder, eight contexts, with both ends of a segment."""
    jvm.register(spark)
    texts = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    out = None
    for end in (0, 1):
        back = jvm.mq_decode(jvm.mq_encode(F.col("data"), bool(end)), F.octet_length("data"))
        part = texts.select(F.lit(end).cast("bigint").alias("predictable"), "doc_id", back.alias("back"))
        part = part.select("predictable", "doc_id", *ints(bytes=F.octet_length("back")), F.sha2("back", 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


_STYLES = (0, 1, 2, 4, 5, 8, 16, 32, 63)


@query("block_styles_roundtrip", f"WITH {PLANE} SELECT CAST(s AS BIGINT) AS style, y, x, v FROM plane, (VALUES {', '.join(f'({s})' for s in _STYLES)}) t(s)")
def block_styles_roundtrip(spark, d):
    """Code blocks of 16x16 in each style (bypass, reset, termination, causal, predictable, marks): all passes, both ways."""
    jvm.register(spark)
    blocks = to_blocks(embedding_plane(spark, d), 16, 16).withColumn("samples", jvm.pack(F.col("samples")))
    packed = blocks.withColumn("style", F.explode(F.array(*map(F.lit, _STYLES))))
    coded = packed.withColumn("c", jvm.encode_block(F.col("samples"), F.col("h"), F.col("w"), F.lit("HL"), F.col("style")))
    back = coded.withColumn("b", jvm.decode_block(F.col("c.payload"), F.col("c.segments"), F.col("c.planes"), F.col("h"), F.col("w"), F.lit("HL"), F.col("style")))
    lists = back.select("style", "y0", "x0", "w", jvm.unpack(F.col("b.q")).alias("q"))
    rows = lists.select("style", "y0", "x0", "w", F.posexplode("q").alias("i", "v"))
    return rows.select(*ints(style="style", y=F.col("y0") + F.expr("i div w"), x=F.col("x0") + F.col("i") % F.col("w"), v="v"))


@query(
    "block_truncated",
    f"""WITH {PLANE}, k AS (SELECT y // 16 AS row, x // 16 AS col, CASE WHEN max(abs(v)) > 0 THEN floor(log2(max(abs(v)))) ELSE -1 END AS top FROM plane GROUP BY 1, 2)
    SELECT y, x, CAST(CASE WHEN abs(v) >= 2 ** top THEN sign(v) * 2 ** top ELSE 0 END AS BIGINT) AS v FROM plane JOIN k ON y // 16 = k.row AND x // 16 = k.col WHERE top >= 0""",
)
def block_truncated(spark, d):
    """The first pass alone: the highest plane of a block, and nothing else, is known."""
    jvm.register(spark)
    blocks = to_blocks(embedding_plane(spark, d), 16, 16)
    packed = blocks.withColumn("samples", jvm.pack(F.col("samples")))
    # each pass ends a segment, so the first segment is the first pass
    coded = packed.withColumn("c", jvm.encode_block(F.col("samples"), F.col("h"), F.col("w"), F.lit("LL"), F.lit(4))).where("c.planes > 0")
    back = coded.withColumn("b", jvm.decode_block(F.col("c.payload"), F.substring(F.col("c.segments"), 1, 8), F.col("c.planes"), F.col("h"), F.col("w"), F.lit("LL"), F.lit(4)))
    lists = back.select("y0", "x0", "w", jvm.unpack(F.col("b.q")).alias("q"))
    rows = lists.select("y0", "x0", "w", F.posexplode("q").alias("i", "v"))
    return rows.select(*ints(y=F.col("y0") + F.expr("i div w"), x=F.col("x0") + F.col("i") % F.col("w"), v="v"))


@query("header_bits_roundtrip", "SELECT o_orderkey, o_custkey % 4096 AS a, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders")
def header_bits_roundtrip(spark, d):
    """Numbers as bits of a packet header, with a stuffed bit behind every byte of ones."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (1, 2))
            out = t2.HeaderWriter()
            for p, q in zip(a, b, strict=True):
                out.bits(0xFFF, 12)
                out.bits(p, 12)
                out.bits(q, 32)
            back = t2.HeaderReader(out.finish())
            found = [(back.bits(12), back.bits(12), back.bits(32)) for _ in a]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for _, x, _ in found], pa.int64()), pa.array([x if m == 0xFFF else -1 for m, _, x in found], pa.int64())], names=["o_orderkey", "a", "b"])

    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4096).alias("a"), F.floor("o_totalprice").cast("bigint").alias("b"))
    return rows.mapInArrow(run, "o_orderkey bigint, a bigint, b bigint")


@query("tag_tree_roundtrip", f"WITH {PLANE} SELECT y, x, abs(v) % 12 AS v FROM plane")
def tag_tree_roundtrip(spark, d):
    """Grids of 13x11 values as tag trees, told bound by bound as packets do."""
    blocks = to_blocks(embedding_plane(spark, d).withColumn("v", F.abs("v") % 12), 11, 13)

    def made(row):
        w, h = row["w"], row["h"]
        tree, out = t2.TagTree(w, h), t2.HeaderWriter()
        tree.fill(row["samples"])
        places = [(x, y) for y in range(h) for x in range(w)]
        for bound in (3, 7, 12):
            for x, y in places:
                tree.write(out, x, y, bound)
        back, source = t2.TagTree(w, h), t2.HeaderReader(out.finish())
        for bound in (3, 7, 12):
            for x, y in places:
                back.read(source, x, y, bound)
        return [{"y": row["y0"] + y, "x": row["x0"] + x, "v": back.value(x, y)} for x, y in places]

    return mapped(blocks, made, "y bigint, x bigint, v bigint", pa.schema([(n, pa.int64()) for n in ("y", "x", "v")]))


@query("packets_roundtrip", samples_sql(*_RGB8))
def packets_roundtrip(spark, d):
    """Precincts, three layers, several segments a block and packet lengths: headers and states from packet to packet.

    The layers' cuts are those of whole images, over all tiles, and the encoder reads its packets back.
    """
    options = Options(levels=2, tile_w=64, tile_h=32, layers=3, rates=(8.0, 3.0), progression="PCRL", precincts=((16, 16), (32, 16)), block_w=8, block_h=8, style=5, packet_lengths=True, audit=True)
    found = codec.decode(codec.encode(strips(spark, d, _RGB8, "rgb"), options))
    strip = F.regexp_extract("path", r"(\d+)\.raw$", 1).cast("bigint")
    rows = found.select(strip.alias("strip"), "component", "y0", "x0", "w", F.posexplode("samples").alias("i", "v"))
    return rows.select(*ints(y=F.col("strip") * STRIP + F.col("y0") + F.expr("i div w"), x=F.col("x0") + F.col("i") % F.col("w"), component="component", v="v"))


@query("component_overrides", samples_sql(*_RGB8))
def component_overrides(spark, d):
    """Streams whose general quantisers and style are wrong for every component, each of which has its own."""

    def made(row):
        data = row["stream"]
        parts = {m: (at, b) for at, m, b in codestream.segments(data)}
        at, cod = parts[codestream.COD]
        place, qcd = parts[codestream.QCD]
        segment = lambda m, b: struct.pack(">HH", m, len(b) + 2) + b
        own = b"".join(segment(codestream.COC, bytes([c, 0]) + cod[5:]) + segment(codestream.QCC, bytes([c]) + qcd) for c in range(3))
        wrong = segment(codestream.COD, cod[:8] + bytes([cod[8] ^ 4]) + cod[9:]) + segment(codestream.QCD, bytes([qcd[0]]) + bytes(8 for _ in qcd[1:]))
        return [{"path": f"{row['path'][:-4]}.j2k", "content": data[:at] + wrong + own + data[place + 4 + len(qcd) :]}]

    coded = images.streams(strips(spark, d, _RGB8, "rgb"), Options(levels=2, block_w=32, block_h=32))
    return rows_of(images.decode_images(mapped(coded, made), kind="j2k"))


@query("tiles_share_layers", f"WITH {RGB}, s AS (SELECT DISTINCT y // 50 AS strip FROM rgb) SELECT strip, CAST(l AS BIGINT) AS layer, true AS held FROM s, range(0, 2) t(l)")
def tiles_share_layers(spark, d):
    """One threshold for all tiles of an image: what each layer takes stays within the image's target."""
    options = Options(levels=2, tile_w=32, tile_h=32, layers=3, rates=(6.0, 2.5), block_w=8, block_h=8)
    coded = codec.code_blocks(codec.image_blocks(strips(spark, d, _RGB8, "rgb"), options))
    cuts = codec.image_cuts(coded, options)
    total = coded.groupBy("path").agg(F.sum(F.octet_length("payload")).alias("total"))

    def taken(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                points = codestream.block_hull(codec._coded_block(row), row["weight"])
                rows += [{"path": row["path"], "layer": k, "bytes": max((p[1] for p in points if p[3] >= cut), default=0)} for k, cut in enumerate(row["cuts"])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("layer", pa.int64()), ("bytes", pa.int64())]))

    used = coded.join(F.broadcast(cuts), "path").mapInArrow(taken, "path string, layer bigint, bytes bigint").groupBy("path", "layer").agg(F.sum("bytes").alias("bytes")).join(total, "path")
    rate = F.when(F.col("layer") == 0, F.lit(6.0)).otherwise(F.lit(2.5))
    return used.select(_strip().alias("strip"), "layer", (F.col("bytes") <= F.greatest(F.lit(1), F.ceil(F.col("total") / rate))).alias("held"))


# ---- marker segments ----

_GROUPS = "g AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)"


def _nations(spark, d) -> DataFrame:
    """``nation, keys``: customers of each nation in order (a nation stands for a stream)."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sort_array(F.collect_list("c_custkey")).alias("keys"))


#: Tiles of a stream at most, as two index bytes number them; a nation of more is several streams.
_TILES = 1 << 16


def _ranked(spark, d) -> DataFrame:
    """``nation, key, k``: the customers of each nation and their places in order, however large a nation is.

    Sorted by ranges; places are counted inside a partition and go on from what lies before it (a row a partition and nation).
    """
    order = ["nation", "key"]
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_custkey").alias("key"))
    # written once: a second sampling could cut the ranges elsewhere
    parts = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    before = Window.partitionBy("nation").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("nation", "_p").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(F.col("nation").alias("_nation"), F.col("_p").alias("_part"), "_start")
    place = F.row_number().over(Window.partitionBy("nation", "_p").orderBy("key")) - 1
    counted = parts.withColumn("_k", place).join(F.broadcast(starts), F.col("nation").eqNullSafe(F.col("_nation")) & (F.col("_p") == F.col("_part")))
    return counted.select("nation", "key", (F.col("_start") + F.col("_k")).cast("bigint").alias("k"))


def _runs(spark, d, size: int) -> DataFrame:
    """``nation, run, keys``: the customers of a nation in order, ``size`` to a row."""
    run = F.expr(f"k div {size}").alias("run")
    return _ranked(spark, d).groupBy("nation", run).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "key"))), lambda s: s["key"]).alias("keys"))


@query("tlm_roundtrip", f"WITH {_GROUPS} SELECT CAST(w AS BIGINT) AS index_bytes, CAST(nation AS BIGINT) AS nation, CAST(k AS BIGINT) AS tile, 14 + c_custkey AS length FROM g, range(0, 3) t(w) WHERE w <> 1 OR k < 256")
def tlm_roundtrip(spark, d):
    """Tile-part lengths in numbered segments of 20 entries, in the widths that hold them; a row a segment."""

    def made(row):
        for width in range(3):
            first = 20 * row["run"]
            entries = [(first + k, 14 + v) for k, v in enumerate(row["keys"]) if width != 1 or first + k < 256]
            stream = first // _TILES * _TILES  # two index bytes number the tiles of one stream
            while entries:
                here = [(k - stream, n) for k, n in entries if k - stream < _TILES]
                body = markers.write_tlm(here, row["run"] % 256, width, 4)
                for t, n in markers.parse_tlm(body, row["run"] % 256, here[0][0]):
                    yield {"index_bytes": width, "nation": row["nation"], "tile": stream + t, "length": n}
                entries, stream = entries[len(here) :], stream + _TILES

    return mapped(_runs(spark, d, 20), made, "index_bytes bigint, nation bigint, tile bigint, length bigint", pa.schema([(n, pa.int64()) for n in ("index_bytes", "nation", "tile", "length")]))


@query("plm_roundtrip", f"WITH {_GROUPS} SELECT CAST(nation AS BIGINT) AS nation, CAST(k // 40 AS BIGINT) AS part, CAST(k % 40 AS BIGINT) AS packet, c_custkey * 37 AS length FROM g")
def plm_roundtrip(spark, d):
    """Packet lengths of all tile-parts, groups running over from segment to segment."""

    def made(row):
        groups = [[37 * v for v in row["keys"][at : at + 40]] for at in range(0, len(row["keys"]), 40)]
        most = max(100, sum(6 * len(g) + 1 for g in groups) // 200)
        collector = markers.PlmCollector()
        for body in markers.write_plm(groups, most):
            collector.append(body)
        return [{"nation": row["nation"], "part": p, "packet": k, "length": n} for p, g in enumerate(collector.lengths()) for k, n in enumerate(g)]

    return mapped(_nations(spark, d), made, "nation bigint, part bigint, packet bigint, length bigint", pa.schema([(n, pa.int64()) for n in ("nation", "part", "packet", "length")]))


_PACKED = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS place, sha256(text) AS sha256 FROM conversations"


def _talks(spark, d) -> DataFrame:
    """``conv_id, texts``: turns in order, standing for the packet headers of tile-parts."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("texts"))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("sha256", pa.string())])


@query("ppm_roundtrip", _PACKED)
def ppm_roundtrip(spark, d):
    """Packed headers of all tile-parts in the main header, cut into segments anywhere."""
    import hashlib

    def made(row):
        groups = [t.encode() for t in row["texts"]]
        collector = markers.PpmCollector()
        for body in markers.write_ppm(groups, max(50, sum(map(len, groups)) // 100)):
            collector.append(body)
        return [{"conv_id": row["conv_id"], "place": k, "sha256": hashlib.sha256(g).hexdigest()} for k, g in enumerate(collector.finish())]

    return mapped(_talks(spark, d), made, "conv_id bigint, place bigint, sha256 string", _DIGESTS)


@query("ppt_roundtrip", "SELECT conv_id, CAST(0 AS BIGINT) AS place, sha256(string_agg(text, '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def ppt_roundtrip(spark, d):
    """Packed headers of one tile-part, numbered segments put together."""
    import hashlib

    def made(row):
        whole = "".join(row["texts"]).encode()
        size = max(1, -(-len(whole) // 200))
        bodies = [bytes([k]) + whole[at : at + size] for k, at in enumerate(range(0, len(whole), size))]
        return [{"conv_id": row["conv_id"], "place": 0, "sha256": hashlib.sha256(markers.collect_ppt(bodies)).hexdigest()}]

    return mapped(_talks(spark, d), made, "conv_id bigint, place bigint, sha256 string", _DIGESTS)


@query(
    "poc_roundtrip",
    "SELECT p_partkey AS part, CAST(wide AS BIGINT) AS components, p_partkey % 5 AS r_start, p_partkey % 3 AS c_start, CAST(1 + p_size % 20 AS BIGINT) AS layer_end, p_partkey % 5 + 1 AS r_end, CAST(wide AS BIGINT) AS c_end, p_partkey % 5 AS ord FROM part, (VALUES (4), (256), (300)) t(wide)",
)
def poc_roundtrip(spark, d):
    """Progression change records with one- and two-byte components."""

    def made(row):
        n, out = row["p_partkey"], []
        for wide in (4, 256, 300):
            record = markers.Record(n % 5, n % 3, 1 + row["p_size"] % 20, n % 5 + 1, wide, codestream.PROGRESSIONS[n % 5])
            for r in markers.parse_poc(markers.write_poc([record], wide, 6, 20), wide, 6, 20):
                out.append({"part": n, "components": wide, "r_start": r.r_start, "c_start": r.c_start, "layer_end": r.layer_end, "r_end": r.r_end, "c_end": r.c_end, "ord": codestream.PROGRESSIONS.index(r.order)})
        return out

    names = ("part", "components", "r_start", "c_start", "layer_end", "r_end", "c_end", "ord")
    return mapped(table(spark, d, "part").select("p_partkey", "p_size"), made, ", ".join(f"{n} bigint" for n in names), pa.schema([(n, pa.int64()) for n in names]))


@query(
    "profile_signalling",
    """WITH c AS (SELECT o_orderkey, o_orderkey % 2 AS announced, (o_orderkey // 2) % 3 AS cap, (o_orderkey // 6) % 3 AS prf, (o_orderkey // 18) % 2 AS swapped FROM orders)
    SELECT o_orderkey, cap < 2 AND prf < 2 AND (cap = 1) = (announced = 1) AND NOT (swapped = 1 AND cap >= 1 AND prf >= 1) AS sound FROM c""",
)
def profile_signalling(spark, d):
    """CAP and PRF: once at most, in order, straight behind SIZ, and CAP exactly if SIZ announces it."""

    def run(batches):
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                announced, cap, prf, swapped = key % 2, key // 2 % 3, key // 6 % 3, key // 18 % 2
                first, second = [(markers.CAP, bytes(4))] * cap, [(markers.PRF, b"\0\1")] * prf
                listed = [(codestream.SIZ, b""), *(second + first if swapped else first + second), (codestream.COD, b"")]
                try:
                    markers.check_profile(listed, 0x4000 * announced)
                    out.append(True)
                except ValueError:
                    out.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], names=["o_orderkey", "sound"])

    return table(spark, d, "orders").select("o_orderkey").mapInArrow(run, "o_orderkey bigint, sound boolean")


@query(
    "metadata_rules",
    """SELECT doc_id, starts_with(text, 'II*') OR starts_with(text, 'MM') AND false AS exif, contains(text, '<') AND contains(text, '>') AS xmp FROM documents""",
)
def metadata_rules(spark, d):
    """Which texts may stand as Exif (a TIFF header) or as XMP (a root element)."""

    def sound(kind, data):
        try:
            jp2.validate_metadata({kind: data})
            return True
        except ValueError:
            return False

    schema = pa.schema([("doc_id", pa.int64()), ("exif", pa.bool_()), ("xmp", pa.bool_())])
    return mapped(table(spark, d, "documents").select("doc_id", "text"), lambda r: [{"doc_id": r["doc_id"], "exif": sound("exif", r["text"].encode()), "xmp": sound("xmp", r["text"].encode())}], "doc_id bigint, exif boolean, xmp boolean", schema)


# ---- geometry, bands, files, runtime ----


@query(
    "band_resolutions",
    "SELECT CAST(l AS BIGINT) AS levels, CAST(b AS BIGINT) AS band_index, CAST(CASE WHEN b = 0 THEN 0 ELSE (b + 2) // 3 END AS BIGINT) AS resolution FROM range(0, 6) t(l), range(0, 16) u(b) WHERE b <= 3 * l",
)
def band_resolutions(spark, d):
    """The resolution that each band of a decomposition belongs to."""
    out = None
    for levels in range(6):
        area = spark.createDataFrame([(0, 0, 0, 64, 64)], "area bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
        bands = geometry.subbands(area, levels, ["area"])
        part = bands.select(F.lit(levels).cast("bigint").alias("levels"), "band_index", geometry.resolution_of(levels).alias("resolution"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "component_blocks",
    f"""WITH {RGB}, s AS (SELECT y // 50 AS strip, max(y % 50) + 1 AS h FROM rgb GROUP BY 1)
    SELECT strip, CAST(c AS BIGINT) AS component, CAST(((100 + 15) // 16) * ((h + 15) // 16) AS BIGINT) AS blocks, CAST(100 * h AS BIGINT) AS samples FROM s, range(0, 3) t(c)""",
)
def component_blocks(spark, d):
    """What a component's grid of code blocks lays out: blocks and the samples they cover, each once."""
    found = codec.image_blocks(strips(spark, d, _RGB8, "rgb"), Options(levels=0, block_w=16, block_h=16))
    return found.groupBy(_strip().alias("strip"), F.col("component").cast("bigint").alias("component")).agg(F.count("*").alias("blocks"), F.sum(F.col("w") * F.col("h")).alias("samples"))


@query("rct_partition_independence", f"WITH {RGB} SELECT y, x, (r + 2 * g + b) // 4 - 128 AS yv, b - g AS cb, r - g AS cr FROM rgb")
def rct_partition_independence(spark, d):
    """The colour transform dealt out over many tasks: the runtime's parallelism changes nothing."""
    from ..functions import color

    dealt = rgb_events(spark, d).repartition(23, "x")
    luma, cb, cr = color.rct(F.col("r"), F.col("g"), F.col("b"))
    return dealt.select(*ints(y="y", x="x", yv=luma, cb=cb, cr=cr))


@query(
    "timing_summary",
    """SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total, CAST(min(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS least, CAST(max(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS most,
    CAST(sum(CAST(floor(value * 100) AS BIGINT)) * 1000 // (SELECT sum(CAST(floor(value * 100) AS BIGINT)) FROM events) AS BIGINT) AS permille FROM events GROUP BY event_type""",
)
def timing_summary(spark, d):
    """Runs, total, extremes and share of each stage's times (the events' values stand for times)."""
    from ..operators.stats import timings

    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 100).cast("bigint").alias("time"))
    return timings(rows, "stage", "time")


@query("band_sink_tiff", samples_sql(*_RGB8))
def band_sink_tiff(spark, d):
    """The whole raster through the band sink into one TIFF, parts written where the rows are."""
    from ..streaming import bands

    pixels = rgb_events(spark, d)
    height = pixels.agg(F.max("y")).first()[0] + 1
    target = scratch(spark, "bands")
    bands.write_tiff_parts(bands.tile_rows(pixels), target, height, 100, 3)
    files = bands.assembled(spark, target)
    return images.samples_of(images.decode_images(files, kind="tif")).select(*ints(y="y", x="x", component="component", v="v"))


@query("palette_band_sink", samples_sql(*_PALETTE))
def palette_band_sink(spark, d):
    """Index bands in, colour bands out."""
    from ..streaming import bands

    pixels = rgb_events(spark, d).withColumn("i", F.col("r") % 16)
    height = pixels.agg(F.max("y")).first()[0] + 1
    target = scratch(spark, "bands")
    palette = np.array([[16 * k, 255 - 16 * k, k * k] for k in range(16)])
    bands.write_tiff_parts(bands.tile_rows(pixels, ("i",)), target, height, 100, 1, palette=palette)
    return images.samples_of(images.decode_images(bands.assembled(spark, target), kind="tif")).select(*ints(y="y", x="x", component="component", v="v"))


@query("command_line_convert", samples_sql(*_RGB8))
def command_line_convert(spark, d):
    """Files of one format converted to two others in turn by the command line, in a shared folder."""
    from ..__main__ import main

    base = scratch(spark, "files")
    base = base if re.match(r"[a-z0-9]+:", base) else f"file://{base}"
    images.write_files(images.encode_images(strips(spark, d, _RGB8, "rgb"), "tif"), f"{base}/tif")
    main(["convert", f"{base}/tif", f"{base}/bmp", "--to", "bmp"])
    main(["convert", f"{base}/bmp", f"{base}/png", "--to", "png"])
    return rows_of(images.read_images(spark, f"{base}/png"))


@query("command_line_codec", samples_sql(*_RGB8))
def command_line_codec(spark, d):
    """Files encoded and decoded by the command line."""
    from ..__main__ import main

    base = scratch(spark, "files")
    base = base if re.match(r"[a-z0-9]+:", base) else f"file://{base}"
    images.write_files(images.encode_images(strips(spark, d, _RGB8, "rgb"), "tif"), f"{base}/tif")
    main(["encode", f"{base}/tif", f"{base}/j2k", "--levels", "2", "--tile", "64x32"])
    main(["decode", f"{base}/j2k", f"{base}/rows"])
    rows = spark.read.parquet(f"{base}/rows").select(_strip().alias("strip"), "component", "y0", "x0", "w", F.posexplode("samples").alias("i", "v"))
    return rows.select(*ints(y=F.col("strip") * STRIP + F.col("y0") + F.expr("i div w"), x=F.col("x0") + F.col("i") % F.col("w"), component="component", v="v"))


@query(
    "packet_counts_stream",
    """WITH p AS (SELECT user_id AS tile, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS part, 1 + event_id % 7 AS packets FROM events)
    SELECT tile, CAST(part AS BIGINT) AS part, CAST(coalesce(sum(packets) OVER (PARTITION BY tile ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM p""",
)
def packet_counts_stream(spark, d):
    """Packets before each tile-part, counted as the parts come."""
    from ..streaming import state
    from .streams import _finished

    order = Window.partitionBy("user_id").orderBy("event_id")
    parts = table(spark, d, "events").select(F.col("user_id").alias("tile"), (F.row_number().over(order) - 1).alias("part"), (1 + F.col("event_id") % 7).cast("int").alias("packets"))
    folder = scratch(spark, "parts")
    parts.write.parquet(folder)
    found = _finished(spark, state.packet_counts(spark.readStream.schema(parts.schema).parquet(folder)), "append", "counts")
    return found.select(*ints(tile="tile", part="part", before="before"))
