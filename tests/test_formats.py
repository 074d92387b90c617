"""Image formats: round trips, refusals, and images as tables."""

import struct
import zlib

import numpy as np
import pytest

from planeforge.sources import codestream, exr, images, jp2, jpeg, plain, png, tiff
from planeforge.sources.codestream import Options, Selection
from planeforge.sources.raster import FormatError, Plane, Raster, interleaved

RNG = np.random.default_rng(11)


def image(h, w, n, depth=8):
    more = {"alpha_mode": "unassociated"} if n in (2, 4) else {}
    return interleaved(RNG.integers(0, 1 << depth, (h, w, n)), depth, **more)


def equal(a, b):
    return len(a.planes) == len(b.planes) and all((p.samples == q.samples).all() and p.precision == q.precision for p, q in zip(a.planes, b.planes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("depth", [8, 16])
def test_tiff_and_png(n, depth):
    raster = image(7, 5, n, depth)
    assert equal(raster, tiff.read_tiff(tiff.write_tiff(raster)))
    for kind in range(5):
        assert equal(raster, png.read_png(png.write_png(raster, filter_type=kind)))


def test_plain_formats():
    gray, rgb = image(6, 9, 1), image(6, 9, 3)
    assert equal(gray, plain.read_pgm(plain.write_pgm(gray)))
    assert equal(rgb, plain.read_bmp(plain.write_bmp(rgb)))
    assert equal(gray, plain.read_simple(plain.write_simple(gray, 3, "5/3", 1.0)))
    signed = Raster([Plane(RNG.integers(-2048, 2048, (4, 6)), 12, True)], "planar")
    assert equal(signed, plain.read_pgx(plain.write_pgx(signed)))
    assert equal(signed, plain.read_pgx(plain.write_pgx(signed, big_endian=False)))
    mixed = Raster([*signed.planes, Plane(RNG.integers(0, 1 << 37, (2, 3)), 38, False, 2, 2)], "planar", extra={"extent": (6, 4)})
    assert equal(mixed, plain.read_raw(plain.write_raw(mixed)))


def test_top_down_bmp():
    data = bytearray(plain.write_bmp(image(4, 3, 3)))
    up = plain.read_bmp(bytes(data))
    data[22:26] = struct.pack("<i", -4)
    assert (plain.read_bmp(bytes(data)).planes[0].samples == up.planes[0].samples[::-1]).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_packed_png(depth):
    width, height = 11, 3
    values = RNG.integers(0, 1 << depth, (height, width))
    bits = ((values[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(height, -1).astype(np.uint8)
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.packbits(bits, axis=1)])

    def build(colour, *chunks):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        body = b"".join(chunk(k, b) for k, b in chunks)
        return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + body + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")

    assert (png.read_png(build(0)).planes[0].samples == values * (255 // ((1 << depth) - 1))).all()
    palette = RNG.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    found = png.read_png(build(3, (b"PLTE", palette.tobytes()), (b"tRNS", bytes([7]))))
    assert found.layout == "rgba" and (found.planes[1].samples == palette[values][:, :, 1]).all()
    assert (found.planes[3].samples == np.where(values == 0, 7, 255)).all()


def test_exr():
    raster = interleaved(RNG.integers(0, 65536, (5, 4, 3)), 16)
    back = exr.read_exr(exr.write_exr(raster))
    assert max(np.abs(a.samples - b.samples).max() for a, b in zip(raster.planes, back.planes, strict=True)) <= 16
    assert back.matrix == pytest.approx(np.array([[0.4361, 0.3851, 0.1431], [0.2225, 0.7169, 0.0606], [0.0139, 0.0971, 0.7141]]), abs=1e-3)


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_flat_blocks(restart):
    blocks = [[0, 80, -400], [8, -1000, 1016]]
    found = jpeg.read_jpeg(jpeg.write_flat(np.array(blocks), restart=restart)).planes[0].samples
    for y in range(2):
        for x in range(3):
            want = min(255, max(0, int(np.floor(blocks[y][x] / 8 + 128.5))))
            assert (found[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] == want).all()


def test_zigzag():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_dng():
    samples = RNG.integers(0, 4000, (2, 3, 3))
    body = samples.astype("<u2").tobytes()
    short = lambda *v: struct.pack(f"<{len(v)}H", *v)
    long = lambda *v: struct.pack(f"<{len(v)}I", *v)
    entries = [(254, 4, 1, long(0)), (256, 4, 1, long(3)), (257, 4, 1, long(2)), (258, 3, 3, short(16, 16, 16)), (259, 3, 1, short(1)), (262, 3, 1, short(34892)), (273, 4, 1, long(0)), (277, 3, 1, short(3)), (278, 4, 1, long(2)), (279, 4, 1, long(len(body))), (50706, 1, 4, bytes([1, 4, 0, 0])), (50714, 3, 1, short(100)), (50717, 4, 1, long(3000))]
    found = tiff.read_dng(tiff.tiff_bytes(entries, body))
    want = np.floor(np.clip((samples - 100) / 2900, 0, 1) * 65535 + 0.5)
    assert (np.stack([p.samples for p in found.planes], 2) == want).all()
    with pytest.raises(FormatError):
        tiff.read_dng(tiff.tiff_bytes([*entries, (51008, 7, 8, bytes(8))], body))


OPTIONS = [
    Options(levels=2),
    Options(levels=3, layers=3, progression="LRCP", rates=(8, 2)),
    Options(levels=1, tile_w=32, tile_h=24, progression="PCRL", block_w=16, block_h=8),
    Options(levels=2, progression="CPRL", precincts=((16, 16), (32, 16)), layers=2, rates=(4,), packet_lengths=True),
    Options(levels=2, style=12, layers=2, rates=(3,), progression="RLCP"),
    Options(levels=2, style=33, layers=3, rates=(5, 2)),
    Options(levels=0, colour=False),
]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("shape", [(1, 1, 1), (37, 53, 1), (50, 41, 3), (20, 33, 4)])
def test_codestream_is_lossless(options, shape):
    raster = image(*shape)
    assert equal(raster, codestream.decode(codestream.encode(raster, options)))


def _smooth():
    y, x = np.mgrid[0:64, 0:80]
    plane = 128 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7)
    return interleaved(np.clip(np.dstack([plane, plane + 9, 250 - plane]), 0, 255).astype(np.int64), 8)


def test_selections():
    raster = _smooth()
    data = codestream.encode(raster, Options(levels=2, tile_w=30, tile_h=24))
    part = codestream.decode(data, Selection(region=(11, 7, 40, 30)))
    assert all((p.samples == q.samples[7:37, 11:51]).all() for p, q in zip(part.planes, raster.planes, strict=True))
    tile = codestream.decode(data, Selection(tile=4))
    assert (tile.planes[0].samples == raster.planes[0].samples[24:48, 30:60]).all()
    assert codestream.decode(data, Selection(reduce=1)).width == 40
    with pytest.raises(FormatError):
        codestream.decode(data, Selection(tile=0, region=(0, 0, 1, 1)))


def test_layers_get_better():
    raster = _smooth()
    data = codestream.encode(raster, Options(levels=3, layers=4, rates=(40, 16, 6), reversible=False, step=1 / 512))
    errors = [np.mean([(p.samples - q.samples) ** 2 for p, q in zip(raster.planes, codestream.decode(data, Selection(layers=n)).planes, strict=True)]) for n in (1, 2, 3, 4)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1


@pytest.mark.parametrize("order", codestream.PROGRESSIONS)
def test_sampled_components_at_an_odd_origin(order):
    x0, y0 = 5, 3
    size = lambda s: (-(-(y0 + 32) // s) + -y0 // s, -(-(x0 + 32) // s) + -x0 // s)
    planes = [Plane(RNG.integers(0, 256, size(s)), 8, False, s, s) for s in (1, 2, 2)]
    raster = Raster(planes, "planar", origin=(x0, y0), extra={"extent": (x0 + 32, y0 + 32)})
    data = codestream.encode(raster, Options(levels=2, tile_w=16, tile_h=16, progression=order, colour=False, precincts=((8, 8),)))
    assert equal(raster, codestream.decode(data))


def test_broken_codestreams_are_refused():
    data = codestream.encode(image(20, 20, 1), Options(levels=1))
    siz = data.index(struct.pack(">H", codestream.SIZ))
    for at, value in ((0, 0), (siz + 1, 0x52), (siz + 39, 0), (len(data) - 1, 0)):
        broken = bytearray(data)
        broken[at] = value
        with pytest.raises((FormatError, ValueError)):
            codestream.decode(bytes(broken))
    with pytest.raises((FormatError, ValueError)):
        codestream.decode(data[:-20])


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_container(n):
    raster = image(12, 10, n)
    raster.xmp = b"<x/>"
    data = jp2.write_jp2(raster, Options(levels=1))
    back = jp2.read_jp2(data)
    assert equal(raster, back) and back.layout == raster.layout and back.xmp == b"<x/>" and back.alpha_mode == raster.alpha_mode
    with pytest.raises(FormatError):
        jp2.attach(data, {"xmp": b"<y/>"})
    assert jp2.parse(jp2.attach(data, {"exif": b"II*\0abcd"})).metadata.keys() == {"xmp", "exif"}
    with pytest.raises(FormatError):
        jp2.parse(data.replace(b"ihdr", b"ihdx"))


def test_palette_container():
    palette = RNG.integers(0, 256, (16, 3))
    index = Raster([Plane(RNG.integers(0, 16, (6, 7)), 8)], "gray")
    data = jp2.wrap(codestream.encode(index, Options(levels=1)), palette=palette)
    back = jp2.read_jp2(data)
    assert back.layout == "rgb" and (back.planes[2].samples == palette[index.planes[0].samples][:, :, 2]).all()


def test_images_as_tables(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"i{k}.tif").write_bytes(tiff.write_tiff(image(10, 12, 3)))
    (tmp_path / "bad.png").write_bytes(b"nope")
    found = images.read_images(spark, str(tmp_path), mode="PERMISSIVE")
    assert {r["format"]: r["_error"] is None for r in found.select("format", "_error").collect()} == {"tif": True, "png": False}
    with pytest.raises(Exception, match="not a PNG"):
        images.read_images(spark, str(tmp_path)).collect()
    target = tmp_path / "out"
    assert images.convert(spark, str(tmp_path), f"file://{target}", "jp2", "*.tif") == 3
    a = images.samples_of(images.read_images(spark, str(tmp_path), "*.tif")).selectExpr("regexp_extract(path, 'i([0-9])', 1) n", "component", "y", "x", "v")
    b = images.samples_of(images.read_images(spark, str(target))).selectExpr("regexp_extract(path, 'i([0-9])', 1) n", "component", "y", "x", "v")
    assert a.count() == 3 * 360 and a.exceptAll(b).count() == 0
    images.register(spark)
    table = spark.read.format("raster").load(str(target))
    assert table.count() == 3
    table.write.format("raster").option("kind", "png").mode("append").save(str(tmp_path / "png"))
    assert sorted(p.name for p in (tmp_path / "png").iterdir()) == ["i0.png", "i1.png", "i2.png"]
    files = spark.read.format("binaryFile").load(str(target))
    assert {r["progression"] for r in images.infos(files).collect()} == {"RPCL"}


def test_band_sink(tmp_path, spark):
    from planeforge.rasters import bench_raster
    from planeforge.streaming.bands import PaletteBands, TiffBands, tile_rows, write_bands

    with open(tmp_path / "a.tif", "wb") as out:
        write_bands(tile_rows(bench_raster(spark, 9, 5)), TiffBands(out), 5, 9, 3)
    found = tiff.read_tiff((tmp_path / "a.tif").read_bytes())
    rows = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in bench_raster(spark, 9, 5).collect()}
    assert all(tuple(p.samples[y, x] for p in found.planes) == v for (y, x), v in rows.items())
    palette = RNG.integers(0, 256, (4, 3))
    with open(tmp_path / "b.tif", "wb") as out:
        sink = PaletteBands(palette, TiffBands(out))
        sink.begin(2, 3, 1, 8)
        with pytest.raises(FormatError):
            sink.write_band(1, np.zeros((1, 3, 1), np.int64))
        sink.write_band(0, np.ones((2, 3, 1), np.int64))
        sink.finish()
    assert (tiff.read_tiff((tmp_path / "b.tif").read_bytes()).planes[1].samples == palette[1, 1]).all()


def test_cell_ranges(spark):
    """Whole and cut cells of every component against the samples themselves."""
    raster = image(19, 21, 3)
    files = spark.createDataFrame([("a.png", bytearray(png.write_png(raster)))], "path string, content binary")
    for size in (1, 8, 32):
        found = {(r["component"], c["y"], c["x"]): (c["low"], c["high"], c["n"]) for r in images.cell_ranges(files, size).collect() for c in r["cells"]}
        want = {}
        for k, p in enumerate(raster.planes):
            for y in range(0, 19, size):
                for x in range(0, 21, size):
                    part = p.samples[y : y + size, x : x + size]
                    want[k, y // size, x // size] = int(part.min()), int(part.max()), part.size
        assert found == want


def test_flat_blocks_are_reduced_where_they_are_decoded(spark, tables):
    """64 samples a pixel must not become rows."""
    from planeforge.queries import QUERIES

    plan = QUERIES["jpeg_flat_blocks"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(cells" in plan and "posexplode" not in plan and "Aggregate [cast(regexp_extract" not in plan


def test_portions():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(10)), "b": [bytes(1_000_000)] * 10})
    parts = list(images.portions([batch, batch.slice(0, 0)]))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(10)) and max(p.num_rows for p in parts) <= 4
    assert [p.num_rows for p in images.portions([pa.RecordBatch.from_pydict({"b": [bytes(9_000_000)] * 2})])] == [1, 1]


def _table(spark, named):
    """Rasters as a table of images."""
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_pylist([images.to_row(name, "raw", raster) for name, raster in named], schema=images.ARROW))


def test_streams_are_those_of_the_python_coder(spark):
    """Byte for byte, for several tiles, layers and styles, paths that repeat, and blocks too deep for the JVM's 32 bits."""
    deep = Raster([Plane(RNG.integers(0, 2, (9, 11)) * ((1 << 29) - 1), 29)], "gray")
    for options in OPTIONS[:3] + OPTIONS[4:6]:
        named = [("a.raw", image(37, 53, 3)), ("a.raw", image(20, 33, 4)), ("b.raw", deep)]
        found = images.streams(_table(spark, named), options).collect()
        assert sorted(bytes(r["stream"]) for r in found) == sorted(codestream.encode(raster, options) for _, raster in named)
        assert {r["alpha_mode"] for r in found} == {None, "unassociated"}
    files = images.encode_images(_table(spark, named), "jp2")
    assert sorted(bytes(r["content"]) for r in files.collect()) == sorted(jp2.write_jp2(raster) for _, raster in named)
    back = images.decode_images(files, kind="jp2").collect()
    key = lambda r: sum(r, [])
    assert sorted((key([p["samples"] for p in r["planes"]]), r["layout"], r["alpha_mode"]) for r in back) == sorted((key([p.samples.ravel().tolist() for p in x.planes]), x.layout, x.alpha_mode) for _, x in named)


def test_blocks_are_not_coded_in_python(spark):
    """The Python coder needs seconds for what the JVM does in milliseconds, so it must not be asked."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    files = images.encode_images(_table(spark, [("a.raw", image(40, 40, 4))]), "jp2")
    plans = [frame._jdf.queryExecution().optimizedPlan().toString() for frame in (files, images.decode_images(files, kind="jp2"))]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert all("planeforge_encode_block" in p for p in plans) and "planeforge_try_decode_block" in plans[1]


def test_broken_streams_are_refused_as_before(spark):
    data = jp2.write_jp2(image(40, 40, 3))
    broken = [data[:-40] + data[-2:], data[:60], b"", data[:-300] + bytes(298) + data[-2:]]
    files = spark.createDataFrame([(f"{k}.jp2", bytearray(b)) for k, b in enumerate([data, *broken])], "path string, content binary")
    found = {r["path"]: (r["_error"], r["planes"]) for r in images.decode_images(files, "PERMISSIVE", "jp2").collect()}
    assert found["0.jp2"][0] is None
    for k, b in enumerate(broken, 1):
        want = images.decoded(f"{k}.jp2", b, True)
        assert found[f"{k}.jp2"][0] == want["_error"]
