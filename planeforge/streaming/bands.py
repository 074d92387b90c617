"""Band and tile sinks: geometry once, then disjoint full-width bands in order, then the end.

A whole raster is the same loop with one sink, so batch and stream cannot differ.
"""

from __future__ import annotations

from collections.abc import Callable
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raster import need


class BandSink:
    """``begin``, ``write_band`` for each band from the top, ``finish``; anything else is an error."""

    def __init__(self) -> None:
        self.shape: tuple[int, int, int] | None = None
        self.next_row = 0

    def begin(self, height: int, width: int, channels: int, depth: int) -> None:
        need(self.shape is None and height > 0 and width > 0 and channels in (1, 2, 3, 4) and depth in (8, 16), "geometry")
        self.shape, self.depth = (height, width, channels), depth
        self._begin()

    def write_band(self, y: int, rows: np.ndarray) -> None:
        need(self.shape is not None and y == self.next_row and rows.shape[1:] == self.shape[1:] and y + len(rows) <= self.shape[0], "band order")
        need(rows.size == 0 or (rows.min() >= 0 and rows.max() < 1 << self.depth), "sample out of range")
        self._band(rows.astype("u1" if self.depth == 8 else "<u2"))
        self.next_row += len(rows)

    def finish(self) -> None:
        need(self.shape is not None and self.next_row == self.shape[0], "rows missing")
        self._finish()

    def _begin(self) -> None: ...

    def _band(self, rows: np.ndarray) -> None: ...

    def _finish(self) -> None: ...


class TiffBands(BandSink):
    """Header first, then rows as they come: memory holds one band."""

    def __init__(self, out, alpha_mode: str | None = None) -> None:
        super().__init__()
        self.out, self.alpha_mode = out, alpha_mode

    def _begin(self) -> None:
        from ..sources.raster import Plane, Raster
        from ..sources.tiff import write_tiff

        height, width, channels = self.shape
        # the header of an image of this shape, written with its first pixel only
        small = Raster([Plane(np.zeros((1, 1), np.int64), self.depth) for _ in range(channels)], {1: "gray", 2: "graya", 3: "rgb", 4: "rgba"}[channels], self.alpha_mode)
        body = channels * self.depth // 8
        head = bytearray(write_tiff(small)[:-body])
        for k in range(int.from_bytes(head[8:10], "little")):
            at = 10 + 12 * k
            value = {256: width, 257: height, 278: height, 279: height * width * body}.get(int.from_bytes(head[at : at + 2], "little"))
            if value is not None:
                head[at + 8 : at + 12] = value.to_bytes(4, "little")
        self.out.write(bytes(head))

    def _band(self, rows: np.ndarray) -> None:
        self.out.write(rows.tobytes())


class PaletteBands(BandSink):
    """Index bands in, colour bands out."""

    def __init__(self, palette: np.ndarray, below: BandSink) -> None:
        super().__init__()
        self.palette, self.below = palette, below

    def _begin(self) -> None:
        height, width, channels = self.shape
        need(channels == 1, "an index is one channel")
        self.below.begin(height, width, self.palette.shape[1], 8)

    def _band(self, rows: np.ndarray) -> None:
        need(int(rows.max()) < len(self.palette), "index is not in the palette")
        self.below.write_band(self.next_row, self.palette[rows[:, :, 0]])

    def _finish(self) -> None:
        self.below.finish()


def write_bands(rows: DataFrame, sink: BandSink, height: int, width: int, channels: int, depth: int = 8) -> None:
    """Rows ``y, samples`` (interleaved) to a sink on the driver, one at a time and in order.

    ``toLocalIterator`` brings one partition after the other; none is held behind its turn.
    """
    sink.begin(height, width, channels, depth)
    ordered = rows.repartitionByRange("y").sortWithinPartitions("y")
    for row in ordered.toLocalIterator():
        sink.write_band(row["y"], np.array(row["samples"]).reshape(1, width, channels))
    sink.finish()


def write_tiff_parts(rows: DataFrame, target: str, height: int, width: int, channels: int, depth: int = 8, alpha_mode: str | None = None, palette: np.ndarray | None = None) -> None:
    """Rows ``y, samples`` (interleaved) as the parts ``start, data`` of one TIFF, written where the rows are.

    Rows have a fixed size, so each part's place in the file is known; ``start`` -1 holds the header.  With a palette
    the rows hold indexes and the file colours.  Each row must be there once.
    """
    out = channels if palette is None else palette.shape[1]
    head = BytesIO()
    header = TiffBands(head, alpha_mode)
    header.begin(height, width, out, depth)
    row_bytes = width * out * depth // 8

    def run(batches):
        held, start, after = [], 0, -1

        def part():
            return pa.RecordBatch.from_arrays([pa.array([start * row_bytes], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["start", "data"])

        for batch in batches:
            ys = batch.column(0).to_pylist()
            for k, y in enumerate(ys):
                line = batch.column(1)[k].values.to_numpy(zero_copy_only=False).reshape(1, width, channels)
                need(0 <= y < height and y != after - 1, "row repeats or lies outside")
                need(line.min() >= 0 and line.max() < (1 << depth if palette is None else len(palette)), "sample out of range")
                if palette is not None:
                    line = palette[line[:, :, 0]]
                if held and (y != after or len(held) * row_bytes > 1 << 24):
                    yield part()
                    held = []
                if not held:
                    start = y
                held.append(line.astype("u1" if depth == 8 else "<u2").tobytes())
                after = y + 1
        if held:
            yield part()

    ordered = rows.select(F.col("y").cast("bigint").alias("y"), F.col("samples").cast("array<bigint>").alias("samples")).repartitionByRange("y").sortWithinPartitions("y")
    parts = ordered.mapInArrow(run, "start bigint, data binary")
    first = rows.sparkSession.createDataFrame([(-1, bytearray(head.getvalue()))], "start bigint, data binary")
    parts.unionByName(first).write.parquet(target)
    found = rows.sparkSession.read.parquet(target).where("start >= 0").agg(F.sum(F.octet_length("data")), F.count_distinct("start"), F.count("*")).first()
    need(found[0] == height * row_bytes and found[1] == found[2], "rows missing")


def join_parts(spark: SparkSession, target: str, out) -> None:
    """The parts of one file to a stream, one at a time and in order."""
    for row in spark.read.parquet(target).repartitionByRange("start").sortWithinPartitions("start").toLocalIterator():
        out.write(bytes(row["data"]))


def assembled(spark: SparkSession, target: str) -> DataFrame:
    """``path, content`` of a file in parts, if it is small enough for a row (2 GB); see ``join_parts`` for larger ones."""
    whole = spark.read.parquet(target).agg(F.sort_array(F.collect_list(F.struct("start", "data"))).alias("p"))
    return whole.select(F.lit(target.rstrip("/").split("/")[-1]).alias("path"), F.concat(F.lit(b""), F.aggregate(F.transform("p", lambda x: x["data"]), F.lit(b""), lambda a, b: F.concat(a, b))).alias("content"))


def tile_rows(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixels to ``y, samples``, ready for a band sink."""
    parts = F.array(*[F.col(c) for c in channels])
    grouped = pixels.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", parts.alias("s")))).alias("p"))
    return grouped.select("y", F.flatten(F.transform("p", lambda p: p["s"])).alias("samples"))


def stream_tiles(tiles: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of tiles to a batch function; each micro-batch is written whole or not at all."""
    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
