"""Images as tables: every format by one reader and one writer.

Files are listed and read by Spark (``binaryFile``), so any store that Spark reads will do, and are
decoded where they are read.  ``format("raster")`` offers the same as a Python data source.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import jvm
from ..operators import t1
from . import codestream, exr, jp2, jpeg, plain, png, tiff
from .raster import FormatError, Plane, Raster, need

READERS: dict[str, Callable[[bytes], Raster]] = {
    "pgm": plain.read_pgm, "pgx": plain.read_pgx, "zraw": plain.read_raw, "bmp": plain.read_bmp, "zj2k": plain.read_simple,
    "tif": tiff.read_tiff, "tiff": tiff.read_tiff, "dng": tiff.read_dng, "png": png.read_png, "jpg": jpeg.read_jpeg, "jpeg": jpeg.read_jpeg,
    "exr": exr.read_exr, "jp2": jp2.read_jp2, "j2k": codestream.decode, "j2c": codestream.decode,
}
WRITERS: dict[str, Callable[[Raster], bytes]] = {
    "pgm": plain.write_pgm, "pgx": plain.write_pgx, "zraw": plain.write_raw, "bmp": plain.write_bmp, "zj2k": plain.write_simple,
    "tif": tiff.write_tiff, "tiff": tiff.write_tiff, "png": png.write_png, "exr": exr.write_exr, "jp2": jp2.write_jp2, "j2k": codestream.encode,
}

PLANE = "struct<component:int,precision:int,signed:boolean,x_step:int,y_step:int,x0:int,y0:int,width:int,height:int,samples:array<bigint>>"
SCHEMA = f"path string, format string, width int, height int, components int, bit_depth int, layout string, alpha_mode string, white_is_zero boolean, origin_x int, origin_y int, icc binary, exif binary, xmp binary, iptc binary, planes array<{PLANE}>, _error string"
_PLANE_TYPE = pa.struct([("component", pa.int32()), ("precision", pa.int32()), ("signed", pa.bool_()), ("x_step", pa.int32()), ("y_step", pa.int32()), ("x0", pa.int32()), ("y0", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.list_(pa.int64()))])
ARROW = pa.schema([
    ("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("bit_depth", pa.int32()), ("layout", pa.string()), ("alpha_mode", pa.string()),
    ("white_is_zero", pa.bool_()), ("origin_x", pa.int32()), ("origin_y", pa.int32()), ("icc", pa.binary()), ("exif", pa.binary()), ("xmp", pa.binary()), ("iptc", pa.binary()), ("planes", pa.list_(_PLANE_TYPE)), ("_error", pa.string()),
])


def extension(path: str) -> str:
    found = re.search(r"\.([^./\\]+)$", path)
    return found[1].lower() if found else ""


def to_row(path: str, kind: str, raster: Raster) -> dict:
    planes = [
        {"component": k, "precision": p.precision, "signed": p.signed, "x_step": p.x_step, "y_step": p.y_step, "x0": p.x0, "y0": p.y0, "width": p.samples.shape[1], "height": p.samples.shape[0], "samples": p.samples.ravel()}
        for k, p in enumerate(raster.planes)
    ]
    return {"path": path, "format": kind, "width": raster.width, "height": raster.height, "components": len(planes), "bit_depth": raster.depth, "layout": raster.layout, "alpha_mode": raster.alpha_mode, "white_is_zero": raster.white_is_zero, "origin_x": raster.origin[0], "origin_y": raster.origin[1], "icc": raster.icc, "exif": raster.exif, "xmp": raster.xmp, "iptc": raster.iptc, "planes": planes, "_error": None}


def from_row(row) -> Raster:
    planes = [Plane(np.array(p["samples"], dtype=np.int64).reshape(p["height"], p["width"]), p["precision"], p["signed"], p["x_step"], p["y_step"], p["x0"], p["y0"]) for p in row["planes"]]
    return Raster(planes, row["layout"], row["alpha_mode"], bool(row["white_is_zero"]), row["icc"], row["exif"], row["xmp"], row["iptc"], origin=(row["origin_x"] or 0, row["origin_y"] or 0))


def rasters(batch: pa.RecordBatch) -> Iterator[tuple[str, Raster]]:
    """Path and raster of each row; samples are read where Arrow holds them."""
    at = batch.schema.names.index("planes")
    rows = batch.drop_columns(["planes"]).to_pylist()
    for k, row in enumerate(rows):
        found = batch.column(at)[k].values
        planes = []
        names = [f.name for f in found.type if f.name != "samples"]
        fields = [dict(zip(names, values, strict=True)) for values in zip(*(found.field(n).to_pylist() for n in names), strict=True)]
        for i, p in enumerate(fields):
            samples = found.field("samples")[i].values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            planes.append(Plane(samples.reshape(p["height"], p["width"]), p["precision"], p["signed"], p["x_step"], p["y_step"], p["x0"], p["y0"]))
        yield row["path"], Raster(planes, row["layout"], row["alpha_mode"], bool(row["white_is_zero"]), row["icc"], row["exif"], row["xmp"], row["iptc"], origin=(row["origin_x"] or 0, row["origin_y"] or 0))


#: Bytes of a batch that are worked on at a time.
PORTION = 4_000_000


def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in the same order, in slices of about ``PORTION`` bytes (a row at least): what is made of a slice is small."""
    for batch in batches:
        step = max(1, batch.num_rows * PORTION // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def decoded(path: str, data: bytes, permissive: bool, kind: str | None = None, **more) -> dict:
    """A row; a bad file raises, or in permissive mode gives a row that only says why."""
    kind = kind or extension(path)
    try:
        if kind not in READERS:
            raise FormatError(f"no reader for .{kind}")
        return to_row(path, kind, READERS[kind](data, **more))
    except (FormatError, IndexError, KeyError, OverflowError, ValueError) as error:
        # whatever breaks on malformed bytes is a fault of the file
        if permissive:
            return dict.fromkeys(ARROW.names) | {"path": path, "format": kind, "_error": f"{type(error).__name__}: {error}"}
        raise FormatError(f"{path}: {error}") from error


def read_images(spark: SparkSession, path: str, glob: str | None = None, mode: str = "FAILFAST", kind: str | None = None) -> DataFrame:
    """All images below a path; ``mode`` FAILFAST or PERMISSIVE (adds the fault as ``_error``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "content")
    return decode_images(files, mode, kind)


def decode_images(files: DataFrame, mode: str = "FAILFAST", kind: str | None = None) -> DataFrame:
    """From ``path, content``; one image in memory at a time.  Codestreams go block by block through the JVM where ``kind`` says that they are some."""
    permissive = mode.upper() == "PERMISSIVE"
    if kind in STREAMS:
        return _decode_streams(files, permissive, kind)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([decoded(name.as_py(), data.as_py(), permissive, kind)], schema=ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_CELL = pa.struct([(n, pa.int64()) for n in ("y", "x", "low", "high", "n")])


def cell_ranges(files: DataFrame, size: int, kind: str | None = None) -> DataFrame:
    """``path, component, cells`` from ``path, content``: place, least and greatest sample and count of each ``size`` x ``size`` cell.

    Cells are reduced where their file is decoded, so samples never are rows.
    """
    schema = pa.schema([("path", pa.string()), ("component", pa.int64()), ("cells", pa.list_(_CELL))])

    def ranges(samples: np.ndarray) -> pa.Array:
        rows, cols = (np.arange(0, n, size) for n in samples.shape)
        reduced = [np.ravel(f.reduceat(f.reduceat(samples, rows, 0), cols, 1)) for f in (np.minimum, np.maximum)]
        n = np.outer(np.diff([*rows, samples.shape[0]]), np.diff([*cols, samples.shape[1]])).ravel()
        columns = (np.repeat(np.arange(len(rows)), len(cols)), np.tile(np.arange(len(cols)), len(rows)), *reduced, n)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_CELL))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                path = name.as_py()
                found = [ranges(p["samples"].reshape(p["height"], p["width"])) for p in decoded(path, data.as_py(), False, kind)["planes"]]
                cells = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.concat_arrays(found))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), cells], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, component bigint, cells array<struct<y:bigint,x:bigint,low:bigint,high:bigint,n:bigint>>")


def encode_images(images: DataFrame, kind: str) -> DataFrame:
    """``path, content``: each image as a file of another format, the extension replaced."""
    if kind not in WRITERS:
        raise ValueError(f"no writer for .{kind}")
    if kind in STREAMS:
        return _encode_streams(images, kind)

    def run(batches):
        for batch in portions(batches):
            for row in batch.to_pylist():
                name = re.sub(r"\.[^./\\]*$", "", row["path"]) + f".{kind}"
                yield pa.RecordBatch.from_pylist([{"path": name, "content": WRITERS[kind](from_row(row))}], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return images.mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, target: str) -> int:
    """Write ``path, content`` below a folder, in any store that pyarrow can open; returns the count.

    Two files of one name would overwrite each other, so they are refused.
    """
    base = F.regexp_extract("path", r"[^/\\]*$", 0)
    twice = files.groupBy(base.alias("name")).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are named {twice[0]['name']}")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_output_stream(f"{root}/{re.split(r'[/\\]', row['path'])[-1]}") as out:
                    out.write(row["content"])
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def convert(spark: SparkSession, source: str, target: str, kind: str, glob: str | None = None) -> int:
    """Batch conversion of a folder; files in parallel, the first bad one fails the job."""
    return write_files(encode_images(read_images(spark, source, glob), kind), target)


def samples_of(images: DataFrame, *more: Column) -> DataFrame:
    """Long form: ``path, component, y, x, v``, and what else is asked for of an image, made once for it."""
    whole = images.select("path", *more, "planes")
    names = whole.columns[:-1]
    rows = whole.select(*names, F.explode("planes").alias("p")).select(*names, "p.component", "p.width", F.posexplode("p.samples").alias("i", "v"))
    return rows.select(*names, F.col("component").cast("bigint").alias("component"), F.expr("cast(i div width as bigint)").alias("y"), (F.col("i") % F.col("width")).cast("bigint").alias("x"), "v")


#: Kinds whose blocks are coded in the JVM.
STREAMS = ("jp2", "j2k", "j2c")
_PLACE = ("component", "band", "precinct", "bx", "by", "left", "top", "w", "h")
_KEPT = (("path", pa.string()), ("layout", pa.string()), ("alpha_mode", pa.string()), ("icc", pa.binary()), ("exif", pa.binary()), ("xmp", pa.binary()), ("iptc", pa.binary()))
_KEPT_DDL = "path string, layout string, alpha_mode string, icc binary, exif binary, xmp binary, iptc binary"


def streams(images: DataFrame, options: codestream.Options = codestream.Options()) -> DataFrame:
    """``path, layout, alpha_mode, icc, exif, xmp, iptc, stream``: each image with its codestream.

    A row stays an image throughout: Python makes its blocks, the JVM codes them in place, Python makes packets of them.
    Blocks of more than 30 bits are coded in Python.  Where single images are large, ``plans/codec.py`` spreads their blocks.
    """
    jvm.register(images.sparkSession)
    block = pa.struct([("tile", pa.int32()), *((n, pa.int32()) for n in _PLACE), ("kind", pa.string()), ("samples", pa.binary()), ("wide", pa.binary())])
    schema = pa.schema([*_KEPT, ("head", pa.binary()), ("blocks", pa.list_(block))])
    done = pa.schema([*_KEPT, ("stream", pa.binary())])

    def split(batches):
        for batch in portions(batches):
            kept = batch.select([n for n, _ in _KEPT]).to_pylist()
            for row, (_, raster) in zip(kept, rasters(batch), strict=True):
                head, blocks = codestream.head_for(raster, options), []
                for tile in range(head.tiles):
                    for place, kind, samples in codestream.tile_blocks(head, tile, codestream.tile_samples(head, tile, raster)):
                        wide = bool(np.abs(samples).max() >> 30)
                        values = (place.component, place.band, place.precinct, place.x, place.y, place.left, place.top, place.w, place.h)
                        blocks.append(dict(zip(_PLACE, values, strict=True)) | {"tile": tile, "kind": kind, "wide" if wide else "samples": samples.astype("<i8" if wide else "<i4").tobytes()})
                yield pa.RecordBatch.from_pylist([row | {"head": pickle.dumps(head), "blocks": blocks}], schema=schema)

    def join(batches):
        for batch in portions(batches):
            for row in batch.to_pylist():
                head = pickle.loads(row["head"])
                coded: dict[int, list] = {tile: [] for tile in range(head.tiles)}
                for b in row["blocks"]:
                    c = b["c"]
                    if c is None:
                        one = t1.encode_block(np.frombuffer(b["wide"], "<i8").reshape(b["h"], b["w"]), b["kind"], head.style)
                    else:
                        segments = np.frombuffer(c["segments"], "<i4").reshape(-1, 2).tolist()
                        one = t1.CodedBlock(c["planes"], c["payload"], c["passes"], list(map(tuple, segments)), np.frombuffer(c["cum_bytes"], "<i4").tolist(), np.frombuffer(c["gains"], "<f8").tolist())
                    coded[b["tile"]].append((codestream.Place(*(b[n] for n in _PLACE)), one))
                yield pa.RecordBatch.from_pylist([{n: row[n] for n, _ in _KEPT} | {"stream": codestream.finished(head, coded, options)}], schema=done)

    listed = images.mapInArrow(split, f"{_KEPT_DDL}, head binary, blocks array<struct<tile:int,{','.join(f'{n}:int' for n in _PLACE)},kind:string,samples:binary,wide:binary>>")
    code = lambda b: F.when(b["samples"].isNotNull(), jvm.encode_block(b["samples"], b["h"], b["w"], b["kind"], F.lit(options.style)))
    coded = F.transform("blocks", lambda b: F.struct(*[b[n].alias(n) for n in ("tile", *_PLACE, "kind", "wide")], code(b).alias("c")))
    return listed.withColumn("blocks", coded).mapInArrow(join, f"{_KEPT_DDL}, stream binary")


def _encode_streams(images: DataFrame, kind: str) -> DataFrame:
    """``path, content`` of images whose blocks are coded in the JVM."""

    def run(batches):
        for batch in portions(batches):
            for row in batch.to_pylist():
                name = re.sub(r"\.[^./\\]*$", "", row["path"]) + f".{kind}"
                yield pa.RecordBatch.from_pylist([{"path": name, "content": boxed(row) if kind == "jp2" else row["stream"]}], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return streams(images).mapInArrow(run, "path string, content binary")


def boxed(row: dict) -> bytes:
    """The container of a row of ``streams``."""
    return jp2.write_jp2(Raster([], row["layout"], row["alpha_mode"], icc=row["icc"], exif=row["exif"], xmp=row["xmp"], iptc=row["iptc"]), stream=row["stream"])


def _decode_streams(files: DataFrame, permissive: bool, kind: str) -> DataFrame:
    """Python lists the blocks of each file, the JVM decodes them in place, Python puts the image together.

    What the JVM does not decode (broken or more than 30 planes), and faults of a file, are left to the reader, as if it were alone.
    """
    jvm.register(files.sparkSession)
    block = pa.struct([(n, pa.int32()) for n in ("planes", "h", "w", "style")] + [("kind", pa.string()), ("payload", pa.binary()), ("segments", pa.binary())])
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("blocks", pa.list_(block))])

    def listed(data: bytes) -> Iterator[dict]:
        stream = jp2.parse(data).codestream if kind == "jp2" else data
        head = codestream.read_head(stream)
        parts = codestream.tile_parts(stream, head)
        need(sorted(parts) == list(range(head.tiles)), "tile missing")
        for tile in range(head.tiles):
            for place, band, planes, segments, payload in codestream.read_blocks(head, tile, parts[tile]):
                yield {"planes": planes, "h": place.h, "w": place.w, "style": head.style, "kind": band.kind, "payload": payload, "segments": np.array(segments, "<i4").tobytes()}

    def split(batches):
        for batch in portions(batches):
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                row = {"path": name.as_py(), "content": data.as_py()}
                try:
                    blocks = list(listed(row["content"]))
                except (FormatError, IndexError, KeyError, OverflowError, ValueError):
                    blocks = []  # the reader will say so
                yield pa.RecordBatch.from_pylist([row | {"blocks": blocks}], schema=schema)

    def join(batches):
        for batch in portions(batches):
            for row in batch.to_pylist():
                found = iter(row["blocks"])

                def reader(payload, segments, planes, h, w, band, style, found=found):
                    b = next(found, None)
                    if b is None:
                        return t1.decode_block(payload, segments, planes, h, w, band, style)
                    return np.frombuffer(b["q"], "<i4").reshape(h, w), np.frombuffer(b["low"], np.uint8).reshape(h, w).astype(np.int64)

                yield pa.RecordBatch.from_pylist([decoded(row["path"], row["content"], permissive, kind, reader=reader)], schema=ARROW)

    named = ("payload", "segments", "planes", "h", "w", "kind", "style")
    read = F.transform("blocks", lambda b: F.when(b["planes"] <= 30, jvm.try_decode_block(*(b[n] for n in named))))
    rows = files.select("path", "content").mapInArrow(split, "path string, content binary, blocks array<struct<planes:int,h:int,w:int,style:int,kind:string,payload:binary,segments:binary>>")
    return rows.withColumn("blocks", read).mapInArrow(join, SCHEMA)


def select_region(images: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """A region decoded from ``jp2``/``j2k`` bytes only where it lies: ``path, content`` in, images out."""

    def run(batches):
        choice = codestream.Selection(region=(x, y, w, h))
        for batch in batches:
            for row in batch.to_pylist():
                stream = jp2.parse(row["content"]).codestream if extension(row["path"]) == "jp2" else row["content"]
                yield pa.RecordBatch.from_pylist([to_row(row["path"], extension(row["path"]), codestream.decode(stream, choice))], schema=ARROW)

    return images.select("path", "content").mapInArrow(run, SCHEMA)


def infos(files: DataFrame) -> DataFrame:
    """Headers only, from ``path, content``: no sample is decoded."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, kind = row["content"], extension(row["path"])
                stream = jp2.parse(data).codestream if kind == "jp2" else data
                head = codestream.read_head(stream)
                out = {"path": row["path"], "width": head.x1 - head.x0, "height": head.y1 - head.y0, "components": len(head.components), "tiles": head.tiles, "levels": head.levels, "layers": head.layers, "progression": head.progression, "reversible": head.reversible, "bytes": len(data)}
                yield pa.RecordBatch.from_pylist([out], schema=_INFO)

    return files.where(F.col("path").rlike(r"(?i)\.(jp2|j2k|j2c)$")).select("path", "content").mapInArrow(run, "path string, width int, height int, components int, tiles int, levels int, layers int, progression string, reversible boolean, bytes bigint")


_INFO = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("tiles", pa.int32()), ("levels", pa.int32()), ("layers", pa.int32()), ("progression", pa.string()), ("reversible", pa.bool_()), ("bytes", pa.int64())])


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "FAILFAST")

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and extension(f.path) in READERS]

    def read(self, partition) -> Iterator[tuple]:
        from pyarrow import fs

        path = partition.value
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(root) as source:
            row = decoded(path, source.read(), self.mode.upper() == "PERMISSIVE")
        yield pa.RecordBatch.from_pylist([row], schema=ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceWriter):
    """Files under temporary names, renamed by the commit: a failed job leaves none."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "tif"), overwrite

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, rows) -> _Written:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        names = []
        for row in rows:
            name = re.sub(r"\.[^./\\]*$", "", re.split(r"[/\\]", row["path"])[-1]) + f".{self.kind}"
            with store.open_output_stream(f"{root}/_{name}.part") as out:
                out.write(WRITERS[self.kind](from_row(row)))
            names.append(name)
        return _Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = self._store()
        for name in [n for m in messages if m is not None for n in m.names]:
            if not self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                raise FormatError(f"{name} is there already")
            store.move(f"{root}/_{name}.part", f"{root}/{name}")

    def abort(self, messages) -> None:
        store, root = self._store()
        for name in [n for m in messages if m is not None for n in m.names]:
            store.delete_file(f"{root}/_{name}.part")


class RasterSource(DataSource):
    """``spark.read.format("raster")``; writing takes ``option("kind", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
