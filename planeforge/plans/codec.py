"""Encoding and decoding as a plan: tiles, then code blocks, then packets, then files.

Block coding is nine tenths of the work and goes block by block, so blocks are dealt out evenly over the
cluster whatever image they come from, and coded in the JVM (``planeforge/jvm``).  Tiles of an image are dealt out
before their transforms.  What belongs together again meets by (image, tile): a tile's
blocks are bounded by its size.  Selections are applied where blocks are listed, before any is coded.

A tile's header travels with one of its blocks only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import jvm
from ..operators import t1
from ..operators.rate import layer_targets
from ..session import written
from ..sources import codestream, images, jp2
from ..sources.codestream import Head, Options, Place, Selection
from ..sources.raster import Raster

_PLACE = "component int, band int, precinct int, bx int, by int, left int, top int, w int, h int"
_BLOCKS = f"path string, tile int, head binary, {_PLACE}, kind string, weight double, samples binary"
_RAW_TILES = "path string, tile int, head binary, samples binary"
_CODED = f"path string, tile int, head binary, {_PLACE}, weight double, planes int, passes int, payload binary, segments binary, cum_bytes binary, gains binary"


def _place(row) -> Place:
    return Place(*(int(row[k]) for k in ("component", "band", "precinct", "bx", "by", "left", "top", "w", "h")))


def _fields(place: Place) -> dict[str, int]:
    return {"component": place.component, "band": place.band, "precinct": place.precinct, "bx": place.x, "by": place.y, "left": place.left, "top": place.top, "w": place.w, "h": place.h}


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _sample_type(head: Head) -> str:
    return "<i4" if max(p for p, _, _, _ in head.components) < 32 else "<i8"


def _raw_tiles(path: str, raster: Raster, options: Options) -> Iterator[dict]:
    """A row a tile: its components' samples behind each other."""
    head = codestream.head_for(raster, options)
    packed, kind = pickle.dumps(head), _sample_type(head)
    for tile in range(head.tiles):
        parts = [np.ascontiguousarray(s, dtype=kind).tobytes() for s in codestream.tile_samples(head, tile, raster)]
        yield {"path": path, "tile": tile, "head": packed, "samples": b"".join(parts)}


def _tile_blocks(row: dict) -> Iterator[dict]:
    head, tile = pickle.loads(row["head"]), row["tile"]
    flat, at, samples = np.frombuffer(row["samples"], _sample_type(head)), 0, []
    for c in range(len(head.components)):
        x0, y0, x1, y1 = head.tile_component(tile, c)
        size = (y1 - y0) * (x1 - x0)
        samples.append(flat[at : at + size].reshape(y1 - y0, x1 - x0))
        at += size
    packed = row["head"]
    weights = [[codestream.band_weight(head, band) for band in head.bands(tile, c)] for c in range(len(head.components))]
    for place, kind, block in codestream.tile_blocks(head, tile, samples):
        yield {"path": row["path"], "tile": tile, "head": packed, **_fields(place), "kind": kind, "weight": weights[place.component][place.band], "samples": np.ascontiguousarray(block, dtype="<i4").tobytes()}
        packed = None


def _blocks(table: DataFrame, rasters: Callable[[pa.RecordBatch], Iterator[tuple[str, Raster]]], options: Options) -> DataFrame:
    schema, raw = _arrow(_BLOCKS), _arrow(_RAW_TILES)

    def tiles(batches):
        for batch in batches:
            for path, raster in rasters(batch):
                yield from _raw_tiles(path, raster, options)

    if not (options.tile_w or options.tile_h):  # one tile an image: there is nothing to deal out
        return table.mapInArrow(lambda batches: _batches((row for tile in tiles(batches) for row in _tile_blocks(tile)), schema), _BLOCKS)
    dealt = table.mapInArrow(lambda batches: _batches(tiles(batches), raw, 16), _RAW_TILES).repartition("path", "tile")
    return dealt.mapInArrow(lambda batches: _batches((row for batch in batches for tile in batch.to_pylist() for row in _tile_blocks(tile)), schema), _BLOCKS)


def image_blocks(table: DataFrame, options: Options = Options()) -> DataFrame:
    """Colour transform, wavelet, quantiser and partition of images (``images.SCHEMA``): one row a code block."""
    return _blocks(table, images.rasters, options)


def file_blocks(files: DataFrame, options: Options = Options(), kind: str | None = None) -> DataFrame:
    """The same from files (``path, content``) of any format that can be read; their samples never are rows."""

    def rasters(batch):
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield path, images.READERS[kind or images.extension(path)](content)

    return _blocks(files.select("path", "content"), rasters, options)


def code_blocks(blocks: DataFrame, style: int = 0) -> DataFrame:
    """Entropy coding, block by block; the rows are dealt out anew, so that large images spread."""
    jvm.register(blocks.sparkSession)
    dealt = blocks.repartition("path", "tile", "component", "band", "precinct", "bx", "by")
    done = dealt.withColumn("done", jvm.encode_block(F.col("samples"), F.col("h"), F.col("w"), F.col("kind"), F.lit(style)))
    kept = [part.split()[0] for part in _CODED.split(", ")]
    return done.select(*[F.col(n if n in blocks.columns else f"done.{n}") for n in kept])


def _head_of(rows: pa.Table) -> Head:
    return pickle.loads(rows["head"].drop_null()[0].as_py())


def _coded_block(row: dict) -> t1.CodedBlock:
    segments = np.frombuffer(row["segments"], "<i4").reshape(-1, 2).tolist()
    return t1.CodedBlock(row["planes"], row["payload"], row["passes"], list(map(tuple, segments)), np.frombuffer(row["cum_bytes"], "<i4").tolist(), np.frombuffer(row["gains"], "<f8").tolist())


def image_cuts(coded: DataFrame, options: Options) -> DataFrame:
    """``path, cuts``: the slope down to which each layer but the last takes points, over all tiles of an image.

    Points go by image and slope; an image's distinct slopes, two numbers each, are summed up in order.
    """
    slim = coded.select("path", "weight", "passes", "segments", "cum_bytes", "gains", "planes", F.lit(b"").alias("payload"))
    schema = _arrow("path string, slope double, delta bigint")

    def points(batches):
        for batch in batches:
            for row in batch.to_pylist():
                before = 0
                for _, size, _, slope in codestream.block_hull(_coded_block(row), row["weight"]):
                    yield {"path": row["path"], "slope": slope, "delta": size - before}
                    before = size

    steps = slim.mapInArrow(lambda batches: _batches(points(batches), schema, 10_000), "path string, slope double, delta bigint")
    per_slope = steps.groupBy("path", "slope").agg(F.sum("delta").alias("delta"))
    running = per_slope.withColumn("total", F.sum("delta").over(Window.partitionBy("path").orderBy(F.desc("slope"))))
    layers = options.layers

    def targets(batches):
        for batch in batches:
            rows = [{"path": p, "targets": layer_targets(n, list(options.rates), layers)[:-1]} for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("targets", pa.list_(pa.int64()))]))

    wanted = coded.groupBy("path").agg(F.sum(F.octet_length("payload")).cast("bigint").alias("n")).mapInArrow(targets, "path string, targets array<bigint>")
    cut = lambda k: F.coalesce(F.min(F.when(F.col("total") <= F.col("targets")[k], F.col("slope"))), F.lit(float("inf")))
    return wanted.join(running, "path", "left").groupBy("path").agg(F.array(*[cut(k) for k in range(layers - 1)]).alias("cuts"))


def tile_parts(coded: DataFrame, options: Options = Options()) -> DataFrame:
    """Layers and packets of each tile: ``path, tile, head, part``."""
    out = "path string, tile int, head binary, part binary, packets int"
    schema = _arrow(out)
    if options.layers > 1:
        coded = written(coded, "coded-blocks")  # read for the cuts and for the packets
        cuts = coded.select("path", "tile").distinct().join(image_cuts(coded, options), "path")
        coded = coded.join(cuts, ["path", "tile"])
    else:
        coded = coded.withColumn("cuts", F.array().cast("array<double>"))

    def run(rows: pa.Table) -> pa.Table:
        head, tile = _head_of(rows), rows["tile"][0].as_py()
        blocks = [(_place(row), _coded_block(row)) for row in rows.drop_columns(["cuts"]).to_pylist()]
        packets = codestream.tile_packets(head, tile, blocks, rows["cuts"][0].as_py())
        if options.audit:
            codestream.audit_tile(head, tile, packets, blocks)
        row = {"path": rows["path"][0].as_py(), "tile": tile, "head": pickle.dumps(head), "part": codestream.tile_part(tile, packets, options.packet_lengths), "packets": len(packets)}
        return pa.Table.from_pylist([row], schema=schema)

    return coded.groupBy("path", "tile").applyInArrow(run, out)


def codestreams(parts: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, content``: the tiles of an image in order behind one main header."""
    gathered = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("tile", "part"))).alias("parts"), F.first("head").alias("head"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = codestream.assemble(pickle.loads(row["head"]), {p["tile"]: p["part"] for p in row["parts"]}, options.part_lengths)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "content": data}], schema=_arrow("path string, content binary"))

    return gathered.mapInArrow(run, "path string, content binary")


def encode(table: DataFrame, options: Options = Options()) -> DataFrame:
    """Images (``images.SCHEMA``) to codestreams: ``path, content``."""
    return codestreams(tile_parts(code_blocks(image_blocks(table, options), options.style), options), options)


def encode_files(files: DataFrame, options: Options = Options(), kind: str | None = None) -> DataFrame:
    """Files (``path, content``) of any format that can be read to codestreams: ``path, content``."""
    return codestreams(tile_parts(code_blocks(file_blocks(files, options, kind), options.style), options), options)


_READ = f"path string, tile int, head binary, {_PLACE}, kind string, style int, planes int, payload binary, segments binary"
_DECODED = f"path string, tile int, head binary, {_PLACE}, q binary, low binary"
_TILES = "path string, tile int, component int, y0 int, x0 int, h int, w int, samples array<bigint>"


def stream_blocks(files: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Packets of ``path, content`` to code blocks; what the selection leaves out is not listed."""
    schema = _arrow(_READ)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"]
                data = jp2.parse(data).codestream if data[:4] == b"\0\0\0\x0c" else data
                head = codestream.read_head(data)
                for tile, body in codestream.tile_parts(data, head).items():
                    if selection.tile is not None and tile != selection.tile:
                        continue
                    if selection.region is not None:
                        x0, y0, x1, y1 = head.tile(tile)
                        x, y, w, h = selection.region
                        if x1 <= x or x + w <= x0 or y1 <= y or y + h <= y0:
                            continue
                    packed = pickle.dumps(head)
                    for place, band, planes, segments, payload in codestream.read_blocks(head, tile, body, selection.layers):
                        if band.resolution <= head.levels - selection.reduce:
                            yield {"path": row["path"], "tile": tile, "head": packed, **_fields(place), "kind": band.kind, "style": head.style, "planes": planes, "payload": payload, "segments": np.array(segments, "<i4").tobytes()}
                            packed = None

    return files.select("path", "content").mapInArrow(lambda batches: _batches(rows(batches), schema), _READ)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    jvm.register(blocks.sparkSession)
    dealt = blocks.repartition("path", "tile", "component", "band", "precinct", "bx", "by")
    done = dealt.withColumn("done", jvm.decode_block(*map(F.col, ("payload", "segments", "planes", "h", "w", "kind", "style"))))
    kept = [part.split()[0] for part in _DECODED.split(", ")]
    return done.select(*[F.col(n if n in blocks.columns else f"done.{n}") for n in kept])


def rebuild_tiles(decoded: DataFrame, reduce: int = 0) -> DataFrame:
    """Inverse transforms: one row a tile and component, in block form (a tile without blocks has no row)."""

    schema = pa.schema([("path", pa.string()), *((n, pa.int32()) for n in ("tile", "component", "y0", "x0", "h", "w")), ("samples", pa.list_(pa.int64()))])

    def run(rows: pa.Table) -> pa.Table:
        head, tile, path = _head_of(rows), rows["tile"][0].as_py(), rows["path"][0].as_py()
        bands = [head.bands(tile, c) for c in range(len(head.components))]
        found = []
        for row in rows.to_pylist():
            place = _place(row)
            shape = (place.h, place.w)
            found.append((place, bands[place.component][place.band], np.frombuffer(row["q"], "<i4").reshape(shape), np.frombuffer(row["low"], np.uint8).reshape(shape).astype(np.int64)))
        out, flat = [], []
        for c, samples in enumerate(codestream.rebuild_tile(head, tile, found, reduce)):
            x0, y0, _, _ = head.tile_component(tile, c)
            scale = 1 << reduce
            out.append((path, tile, c, -(-y0 // scale), -(-x0 // scale), *samples.shape))
            flat.append(samples.ravel())
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
        plain = [pa.array(column, schema.field(k).type) for k, column in enumerate(zip(*out, strict=True))]
        return pa.Table.from_arrays([*plain, lists], schema=schema)

    return decoded.groupBy("path", "tile").applyInArrow(run, _TILES)


def decode(files: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """``path, tile, component, y0, x0, h, w, samples`` of the selected tiles."""
    return rebuild_tiles(decode_blocks(stream_blocks(files, selection)), selection.reduce)


def block_statistics(coded: DataFrame) -> DataFrame:
    """Payload statistics for each component and band, and in total."""
    rows = coded.select("component", "band", "planes", "passes", F.octet_length("payload").cast("bigint").alias("bytes"))
    return rows.rollup("component", "band").agg(F.count("*").alias("blocks"), F.sum("passes").alias("passes"), F.sum("bytes").alias("bytes"), F.max("planes").alias("planes"))
