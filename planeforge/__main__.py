"""Command line: convert, info, stats, region, native planes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .session import ship
from .sources.codestream import PROGRESSIONS, Options, Selection


def pairs(text: str) -> tuple[tuple[int, int], ...]:
    """``64x64,128x128``"""
    out = tuple(tuple(map(int, part.lower().split("x"))) for part in text.split(","))
    if any(len(p) != 2 or min(p) <= 0 for p in out):
        raise argparse.ArgumentTypeError("sizes look like 64x64,128x128")
    return out  # type: ignore[return-value]


def rates(text: str) -> tuple[float, ...]:
    out = tuple(map(float, text.split(",")))
    if any(not v > 0 for v in out):
        raise argparse.ArgumentTypeError("rates are positive")
    return out


def region(text: str) -> tuple[int, int, int, int]:
    """``x,y,w,h``"""
    out = tuple(map(int, text.split(",")))
    if len(out) != 4 or min(out) < 0 or not out[2] or not out[3]:
        raise argparse.ArgumentTypeError("a region is x,y,w,h")
    return out  # type: ignore[return-value]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="planeforge")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "encode", "decode", "info", "stats"):
        sub = commands.add_parser(name)
        sub.add_argument("source")
        if name not in ("info", "stats"):
            sub.add_argument("target")
        sub.add_argument("--glob")
        if name == "convert":
            sub.add_argument("--to", default="jp2")
        if name in ("encode", "stats"):
            sub.add_argument("--levels", type=int, default=5)
            sub.add_argument("--layers", type=int, default=1)
            sub.add_argument("--progression", choices=PROGRESSIONS, default="RPCL")
            sub.add_argument("--lossy", action="store_true")
            sub.add_argument("--tile", type=pairs)
            sub.add_argument("--precincts", type=pairs)
            sub.add_argument("--block", type=pairs)
            sub.add_argument("--rates", type=rates, default=())
            sub.add_argument("--style", type=int, default=0)
            sub.add_argument("--packet-lengths", action="store_true")
        if name == "decode":
            sub.add_argument("--tile", type=int)
            sub.add_argument("--region", type=region)
            sub.add_argument("--reduce", type=int, default=0)
            sub.add_argument("--layers", type=int)
    return top


def options(args: argparse.Namespace) -> Options:
    tile = args.tile[0] if args.tile else (0, 0)
    block = args.block[0] if args.block else (64, 64)
    return Options(args.levels, args.layers, args.progression, not args.lossy, block_w=block[0], block_h=block[1], style=args.style, tile_w=tile[0], tile_h=tile[1], precincts=args.precincts or Options().precincts, rates=args.rates, packet_lengths=args.packet_lengths)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .plans import codec
    from .sources import images

    spark = SparkSession.builder.appName("planeforge").getOrCreate()
    ship(spark)
    if args.command == "convert":
        print(images.convert(spark, args.source, args.target, args.to, args.glob))
    elif args.command == "encode":
        table = images.read_images(spark, args.source, args.glob)
        files = codec.encode(table, options(args)).withColumn("path", F.regexp_replace("path", r"\.[^./\\]*$", ".j2k"))
        print(images.write_files(files, args.target))
    elif args.command == "decode":
        files = spark.read.format("binaryFile").option("pathGlobFilter", args.glob or "*.{jp2,j2k}").load(args.source)
        codec.decode(files, Selection(args.tile, args.region, args.reduce, args.layers)).write.parquet(args.target)
    elif args.command == "info":
        files = spark.read.format("binaryFile").option("pathGlobFilter", args.glob or "*.{jp2,j2k}").load(args.source)
        images.infos(files).show(truncate=False)
    else:
        blocks = codec.image_blocks(images.read_images(spark, args.source, args.glob), options(args))
        codec.block_statistics(codec.code_blocks(blocks, args.style)).orderBy("component", "band").show(200)
    return 0


if __name__ == "__main__":
    sys.exit(main())
