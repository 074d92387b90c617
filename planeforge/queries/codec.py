"""Coders over the tables: what goes in must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entropy
from ..plans import codec
from ..rasters import rgb_events, table, to_blocks, to_planes
from ..sources.codestream import Options, Selection
from .registry import RGB, ints, query

STRIP = 50


def _images(spark, d):
    """Each strip of 50 rows of the RGB raster as an image of its own."""
    planes = to_planes(rgb_events(spark, d)).withColumn("strip", F.expr(f"y div {STRIP}")).withColumn("y", F.col("y") % STRIP)
    blocks = to_blocks(planes, STRIP, 100, ("strip", "component"))
    plane = F.struct(
        F.col("component").cast("int").alias("component"), F.lit(8).alias("precision"), F.lit(False).alias("signed"), F.lit(1).alias("x_step"), F.lit(1).alias("y_step"), F.lit(0).alias("x0"), F.lit(0).alias("y0"),
        F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), "samples",
    )
    gathered = blocks.groupBy("strip").agg(F.sort_array(F.collect_list(plane)).alias("planes"))
    null = F.lit(None)
    return gathered.select(
        F.concat(F.lit("strip"), F.lpad(F.col("strip").cast("string"), 6, "0"), F.lit(".j2k")).alias("path"), F.lit("rgb").alias("layout"), null.cast("string").alias("alpha_mode"), F.lit(False).alias("white_is_zero"), F.lit(0).alias("origin_x"), F.lit(0).alias("origin_y"),
        *[null.cast("binary").alias(n) for n in ("icc", "exif", "xmp", "iptc")], "planes",
    )


def _pixels(tiles):
    strip = F.regexp_extract("path", r"(\d+)\.j2k$", 1).cast("bigint")
    rows = tiles.select(strip.alias("strip"), "component", "y0", "x0", "w", F.posexplode("samples").alias("i", "v"))
    return rows.select(*ints(y=F.col("strip") * STRIP + F.col("y0") + F.expr("i div w"), x=F.col("x0") + F.col("i") % F.col("w"), component="component", v="v"))


_SAMPLES = f"WITH {RGB} SELECT y, x, CAST(c AS BIGINT) AS component, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb, range(0, 3) t(c)"


@query("codestream_roundtrip", _SAMPLES)
def codestream_roundtrip(spark, d):
    """Lossless encode and decode, tiles and layers, block by block on the cluster."""
    options = Options(levels=2, tile_w=64, tile_h=32, layers=2, rates=(4.0,), block_w=32, block_h=32)
    return _pixels(codec.decode(codec.encode(_images(spark, d), options)))


@query("codestream_region", _SAMPLES + " WHERE y % 50 >= 32 AND x < 64")
def codestream_region(spark, d):
    """The tiles that a region of each image touches; no other block is decoded."""
    options = Options(levels=1, tile_w=64, tile_h=32, progression="LRCP")
    files = codec.encode(_images(spark, d), options)
    return _pixels(codec.decode(files, Selection(region=(10, 40, 20, 5))))


@query("codestream_lossy_bounded", f"WITH {RGB} SELECT CAST(count(*) * 3 AS BIGINT) AS n, CAST(0 AS BIGINT) AS beyond FROM rgb")
def codestream_lossy_bounded(spark, d):
    """9/7 with a fine step: no sample is off by more than 4."""
    files = codec.encode(_images(spark, d), Options(levels=2, reversible=False, step=1 / 1024))
    back = _pixels(codec.decode(files)).withColumnRenamed("v", "w")
    plain = to_planes(rgb_events(spark, d))
    return plain.join(back, ["component", "y", "x"]).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("v") - F.col("w")) > 4).alias("beyond"))


@query(
    "payload_statistics",
    f"""WITH {RGB}, s AS (SELECT y // 50 AS strip, y % 50 // 16 AS by_, x // 16 AS bx, CAST(c AS BIGINT) AS component, CASE c WHEN 0 THEN ((r + 2 * g + b) >> 2) - 128 WHEN 1 THEN b - g ELSE r - g END AS v FROM rgb, range(0, 3) t(c)),
    k AS (SELECT component, CAST(0 AS BIGINT) AS band, CAST(length(ltrim(bin(max(abs(v))), '0')) AS BIGINT) AS planes FROM s GROUP BY strip, by_, bx, component)
    SELECT component, band, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(CASE WHEN planes > 0 THEN 3 * planes - 2 ELSE 0 END) AS BIGINT) AS passes, true AS coded, CAST(max(planes) AS BIGINT) AS planes FROM k GROUP BY ROLLUP (component, band)""",
)
def payload_statistics(spark, d):
    """Blocks, passes and planes for each component and band, with totals; bytes there are wherever there are passes."""
    coded = codec.code_blocks(codec.image_blocks(_images(spark, d), Options(levels=0, block_w=16, block_h=16)))
    found = codec.block_statistics(coded)
    return found.select(*ints(component="component", band="band", blocks="blocks", passes="passes"), ((F.col("bytes") > 0) == (F.col("passes") > 0)).alias("coded"), *ints(planes="planes"))


@query("packet_counts", f"WITH {RGB}, s AS (SELECT y // 50 AS s, max(y % 50) + 1 AS h FROM rgb GROUP BY 1) SELECT s AS strip, CAST(k AS BIGINT) AS tile, CAST(3 * 3 * 2 AS BIGINT) AS packets FROM s, range(0, 4) t(k) WHERE k < 2 * ((h + 31) // 32)")
def packet_counts(spark, d):
    """Resolutions x components x layers x precincts of each tile, as written and read back."""
    options = Options(levels=2, tile_w=64, tile_h=32, layers=2, rates=(4.0,))
    parts = codec.tile_parts(codec.code_blocks(codec.image_blocks(_images(spark, d), options)), options)
    return parts.select(*ints(strip=F.regexp_extract("path", r"(\d+)\.j2k$", 1), tile="tile", packets="packets"))


_DOCS = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS raw_len, sha256(text) AS sha256 FROM documents"


def _roundtrip(spark, d, method):
    texts = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    coded = entropy.encode_column(texts, "doc_id", "data", method)
    return entropy.decode_column(coded, "doc_id").select("doc_id", *ints(raw_len=F.octet_length("data")), F.sha2("data", 256).alias("sha256"))


@query("entropy_auto_roundtrip", _DOCS)
def entropy_auto_roundtrip(spark, d):
    return _roundtrip(spark, d, None)


@query("entropy_bit_rle_roundtrip", _DOCS)
def entropy_bit_rle_roundtrip(spark, d):
    return _roundtrip(spark, d, "bit_rle")


@query("entropy_arith_roundtrip", _DOCS)
def entropy_arith_roundtrip(spark, d):
    return _roundtrip(spark, d, "arith")


@query("simple_container_roundtrip", f"WITH {RGB} SELECT y, x, r AS v FROM rgb")
def simple_container_roundtrip(spark, d):
    """The simple container: 5/3 with step 1 is lossless."""
    from ..sources import images

    gray = _images(spark, d).withColumn("planes", F.slice("planes", 1, 1)).withColumn("layout", F.lit("gray"))
    back = images.samples_of(images.decode_images(_simple(gray)))
    strip = F.regexp_extract("path", r"(\d+)\.zj2k$", 1).cast("bigint")
    return back.select(*ints(y=strip * STRIP + F.col("y"), x="x", v="v"))


def _simple(gray):
    import re

    import pyarrow as pa

    from ..sources import images, plain

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = plain.write_simple(images.from_row(row), 3, "5/3", 1.0)
                yield pa.RecordBatch.from_pylist([{"path": re.sub(r"\.[^.]*$", ".zj2k", row["path"]), "content": data}], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return gray.mapInArrow(run, "path string, content binary")
