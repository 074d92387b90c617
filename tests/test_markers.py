"""Marker segments, manifests and the command line."""

import hashlib
import struct

import numpy as np
import pytest

from planeforge import __main__ as command
from planeforge.plans import codec, conformance
from planeforge.rasters import bench_raster, signed_ramp
from planeforge.sources import codestream, images, markers, plain, tiff
from planeforge.sources.raster import FormatError, Plane, Raster, interleaved


@pytest.mark.parametrize("a", markers.INDEX_BYTES)
@pytest.mark.parametrize("b", markers.LENGTH_BYTES)
def test_part_lengths(a, b):
    entries = [(k, 100 + 7 * k) for k in range(5)]
    body = markers.write_tlm(entries, 3, a, b)
    assert markers.parse_tlm(body, 3) == entries
    with pytest.raises(FormatError):
        markers.parse_tlm(body, 2)
    with pytest.raises(FormatError):
        markers.parse_tlm(body[:-1], 3)


def test_stream_announces_its_parts():
    data = codestream.encode(interleaved(np.zeros((40, 40, 1), np.int64), 8), codestream.Options(levels=1, tile_w=16, tile_h=16, packet_lengths=True))
    head = codestream.read_head(data)
    body = next(b for _, m, b in codestream.segments(data) if m == codestream.TLM)
    entries = markers.parse_tlm(body, 0)
    assert [t for t, _ in entries] == list(range(head.tiles)) and sum(n for _, n in entries) + 2 + sum(4 + len(b) for _, _, b in codestream.segments(data)) + 2 == len(data)


def test_packet_lengths_cross_nothing():
    lengths = [0, 1, 127, 128, 16383, 16384, 1 << 31] * 9
    bodies = markers.write_plt(lengths, most=20)
    assert len(bodies) > 3 and markers.parse_plt(bodies) == lengths
    with pytest.raises(FormatError):
        markers.parse_varints(b"\x81")
    with pytest.raises(FormatError):
        markers.parse_plt(bodies[1:])


def test_groups_cross_segments():
    groups = [bytes([k] * n) for k, n in enumerate((0, 5, 70, 1, 0, 33))]
    found = markers.PpmCollector()
    for body in markers.write_ppm(groups, most=13):
        found.append(body)
    assert found.finish() == groups
    lengths, plm = [[5, 300], [], [9]], markers.PlmCollector()
    stream = b"".join(bytes([len(v)]) + v for v in (b"".join(map(codestream.varint, g)) for g in lengths))
    for k in range(0, len(stream), 2):
        plm.append(bytes([k // 2]) + stream[k : k + 2])
    assert plm.lengths() == lengths
    with pytest.raises(FormatError):
        short = markers.PpmCollector()
        short.append(b"\0\0\0\0\5ab")
        short.finish()
    assert markers.collect_ppt([b"\0ab", b"\1c"]) == b"abc"
    with pytest.raises(FormatError):
        markers.collect_ppt([b"\1ab"])


@pytest.mark.parametrize("components", [3, 256, 300])
def test_progression_records(components):
    records = [markers.Record(0, 0, 1, 2, components, "RLCP"), markers.Record(1, 1, 2, 4, 2, "CPRL")]
    assert markers.parse_poc(markers.write_poc(records, components, 4, 2), components, 4, 2) == records
    wide = struct.pack(">BBHBBB", 0, 0, 999, 33, 0, 0)
    assert markers.parse_poc(wide, 3, 4, 2) == [markers.Record(0, 0, 2, 4, 3, "LRCP")]
    with pytest.raises(FormatError):
        markers.parse_poc(struct.pack(">BBHBBB", 3, 0, 1, 3, 1, 0), 3, 4, 2)


def test_profiles():
    siz, cap, prf = (codestream.SIZ, b""), (markers.CAP, struct.pack(">IH", 1 << 17, 1)), (markers.PRF, b"\0\1")
    markers.check_profile([siz, cap, prf], 0x4000)
    markers.check_profile([siz, prf], 0)
    for bad, flags in (([siz, prf, cap], 0x4000), ([siz, cap, cap], 0x4000), ([siz, cap], 0), ([siz], 0x4000), ([cap, siz], 0x4000)):
        with pytest.raises(FormatError):
            markers.check_profile(bad, flags)


def test_conformance(spark):
    raster = interleaved(np.random.default_rng(0).integers(0, 256, (20, 24, 1)), 8)
    data = codestream.encode(raster, codestream.Options(levels=1))
    digest = hashlib.sha256(data).hexdigest()
    pgx = plain.write_pgx(raster)
    entry = lambda name, **more: {"id": name, "path": "a.j2k", "sha256": digest, "expectation": "decode_pass", "expected_error": None, "expected_native_sha256": None, "features": ["lossless"], "patches": None, "references": None} | more
    rows = [
        entry("digest", expected_native_sha256=conformance.native_sha256(raster)),
        entry("reference", references=[("a.pgx", 0, 0, 0.0)]),
        entry("wrong", expected_native_sha256="0" * 64),
        entry("refused", expectation="fail_closed", expected_error="SIZ", patches=[("ff51", 0, 1, 0x52)]),
        entry("accepted", expectation="fail_closed", expected_error="x"),
        entry("missing", path="b.j2k", expected_native_sha256="0" * 64),
    ]
    entries = spark.createDataFrame(rows, conformance.ENTRY)
    files = spark.createDataFrame([("a.j2k", bytearray(data)), ("a.pgx", bytearray(pgx))], "path string, content binary")
    assert {r["id"]: r["outcome"] for r in conformance.run(entries, files).collect()} == {"digest": "decode-pass", "reference": "decode-pass", "wrong": "mismatch", "refused": "expected-fail-closed", "accepted": "unexpected-acceptance", "missing": "mismatch"}
    known = spark.createDataFrame([("lossless",)], "id string")
    assert conformance.manifest_faults(entries, known).count() == 0
    bad = spark.createDataFrame([entry("x", features=["nope"]), entry("y", sha256="AB"), entry("y", expected_native_sha256="0")], conformance.ENTRY)
    faults = {(r["id"], r["fault"]) for r in conformance.manifest_faults(bad, known).collect()}
    assert ("x", "unknown feature nope") in faults and ("y", "id repeats") in faults and len(faults) == 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(tiff.write_tiff(interleaved(np.random.default_rng(1).integers(0, 256, (30, 40, 3)), 8)))
    assert command.main(["encode", str(tmp_path / "in"), f"file://{tmp_path}/coded", "--levels", "2", "--tile", "16x16", "--layers", "2", "--rates", "4"]) == 0
    assert command.main(["decode", str(tmp_path / "coded"), str(tmp_path / "planes"), "--region", "3,4,5,6"]) == 0
    assert spark.read.parquet(str(tmp_path / "planes")).count() == 3
    assert command.main(["convert", str(tmp_path / "in"), f"file://{tmp_path}/png", "--to", "png"]) == 0
    assert command.main(["info", str(tmp_path / "coded")]) == 0
    assert command.main(["stats", str(tmp_path / "in"), "--levels", "1"]) == 0
    with pytest.raises(SystemExit):
        command.main(["decode", "a", "b", "--region", "1,2"])


def test_plan_equals_single_pass(spark):
    """Blocks on the cluster give the same bytes as one process, for any partitioning."""
    rows = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in bench_raster(spark, 50, 33).collect()}
    raster = interleaved(np.array([[rows[y, x] for x in range(50)] for y in range(33)]), 8)
    options = codestream.Options(levels=2, tile_w=20, tile_h=16, layers=3, rates=(9.0, 3.0), progression="LRCP")
    import pyarrow as pa

    table = spark.createDataFrame(pa.Table.from_pylist([images.to_row("a.j2k", "j2k", raster)], schema=images.ARROW))
    assert bytes(codec.encode(table, options).first()["content"]) == codestream.encode(raster, options)


def test_signed_ramp(spark):
    rows = {(r["y"], r["x"]): r["v"] for r in signed_ramp(spark, 90, 60, 12).collect()}
    plane = np.array([[rows[y, x] for x in range(90)] for y in range(60)])
    assert plane.min() < -2000 and plane.max() > 2000
    data = codestream.encode(Raster([Plane(plane, 12, True)], "planar"), codestream.Options(levels=3))
    assert (codestream.decode(data).planes[0].samples == plane).all()


def test_lengths_of_more_tiles_than_two_bytes_number(spark, tmp_path, monkeypatch):
    """A nation goes on in another stream; its rows come in runs, not as one list. Ties and a null nation are kept."""
    from planeforge.queries import QUERIES, formats

    spark.range(1003).selectExpr("id div 2 * 2 as c_custkey", "if(id % 10 = 3, null, cast(id % 2 as int)) as c_nationkey").repartition(5).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(formats, "_TILES", 50)  # cuts segments of 20
    groups = {}
    for k in range(1003):
        groups.setdefault(None if k % 10 == 3 else k % 2, []).append(k // 2 * 2)
    want = sorted((w, -1 if n is None else n, k, 14 + v) for n, keys in groups.items() for k, v in enumerate(sorted(keys)) for w in range(3) if w != 1 or k < 256)
    found = QUERIES["tlm_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((r["index_bytes"], -1 if r["nation"] is None else r["nation"], r["tile"], r["length"]) for r in found) == want
    runs = formats._runs(spark, str(tmp_path), 20).collect()
    assert max(len(r["keys"]) for r in runs) == 20 and sum(len(r["keys"]) for r in runs) == 1003


def test_lengths_beyond_the_tiles_of_a_stream(spark, tmp_path):
    from planeforge.queries import QUERIES

    n = (1 << 16) + 30
    spark.range(n).selectExpr("id as c_custkey", "cast(1 as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    found = QUERIES["tlm_roundtrip"](spark, str(tmp_path)).where("index_bytes = 2").selectExpr("count(*) n", "count_if(length = tile + 14) same", "max(tile) most").first()
    assert tuple(found) == (n, n, n - 1)


def test_blocks_of_planes_need_no_python(spark, tables):
    from planeforge.queries import QUERIES

    for name in ("block_styles_roundtrip", "block_truncated"):
        assert "MapInArrow" not in QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
