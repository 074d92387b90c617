"""Runs and run-length codes over byte and bit sequences, by windows; sizes without coding anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def code_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, i, b``: the UTF-8 bytes of a text as numbers, long form."""
    hexed = F.hex(F.encode(F.col(text), "UTF-8"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length(F.col(text)) - 1))
    rows = df.where(F.octet_length(F.col(text)) > 0).select(key, hexed.alias("_h"), at.alias("i"))
    return rows.select(key, F.col("i").cast("bigint").alias("i"), F.conv(F.substring(F.col("_h"), F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("bigint").alias("b"))


def runs(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """Maximal runs: ``key, run, start, length, value``; run numbers from 0."""
    order = Window.partitionBy(key).orderBy(place)
    changed = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("bigint"), F.lit(0))
    marked = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min(place).alias("start"), F.count("*").alias("length"), F.first(value).alias("value"))


def rle_sizes(df: DataFrame, key: str, place: str = "i", value: str = "b") -> DataFrame:
    """``key, raw_len, rle_len``.

    A run of 4 or more costs 3 bytes for each 255 of it.  A run scan looks ahead 255 at most, so what
    is left of a long run and is shorter than 4 joins the literals behind it; a stretch of literals
    costs its bytes and 2 for each 255 of them.
    """
    found = runs(df, key, place, value)
    rest = F.pmod(F.col("length"), F.lit(255))
    packed = F.expr("length div 255") + (rest >= 4).cast("bigint")
    coded = F.when(F.col("length") >= 4, packed * 3).otherwise(0)
    loose = F.when(F.col("length") < 4, F.col("length")).when(rest < 4, rest).otherwise(0)
    rows = found.withColumn("_code", coded).withColumn("_loose", loose)
    order = Window.partitionBy(key).orderBy("run")
    island = F.sum((F.col("length") >= 4).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    literal = rows.withColumn("_island", island).groupBy(key, "_island").agg(F.sum("_loose").alias("_n"), F.sum("_code").alias("_code"), F.sum("length").alias("_len"))
    return literal.groupBy(key).agg(F.sum("_len").alias("raw_len"), F.sum(F.col("_code") + F.col("_n") + F.floor((F.col("_n") + 254) / 255) * 2).cast("bigint").alias("rle_len"))


def bits(df: DataFrame, key: str, place: str = "i", value: str = "b") -> DataFrame:
    """``key, i, bit``: bytes spread to bits, highest first."""
    spread = df.select(key, F.col(place).alias("_p"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k"))
    return spread.select(key, (F.col("_p") * 8 + F.col("_k")).cast("bigint").alias("i"), F.call_function("shiftright", F.col("_v"), F.lit(7) - F.col("_k")).bitwiseAND(F.lit(1)).cast("bigint").alias("bit"))


def bit_rle_sizes(df: DataFrame, key: str) -> DataFrame:
    """``key, bit_rle_len``: one byte for each 127 of a run of equal bits."""
    return runs(bits(df, key), key, "i", "bit").groupBy(key).agg(F.sum(F.floor((F.col("length") + 126) / 127)).cast("bigint").alias("bit_rle_len"))


def method(raw: Column, rle: Column, bit_rle: Column, tried: Column) -> Column:
    """The container's choice: bit runs if tried, below raw and not above byte runs; else byte runs if below raw."""
    return F.when(tried & (bit_rle < raw) & (bit_rle <= rle), "bit_rle").when(rle < raw, "rle").otherwise("raw")


def simple_share(df: DataFrame, key: str, value: str = "b") -> DataFrame:
    """``key, tried``: bit runs are tried on short inputs and where 3 in 4 bytes are 0, 1, 128 or 255."""
    simple = F.count_if(F.col(value).isin(0, 1, 128, 255))
    return df.groupBy(key).agg(((F.count("*") <= 64) | (simple * 4 >= F.count("*") * 3)).alias("tried"))


def expanded(coded: DataFrame, key: str, order: str, length: str, value: str) -> DataFrame:
    """Decode runs: ``key, i, value``."""
    before = F.sum(length).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)
    rows = coded.where(F.col(length) > 0).withColumn("_b", before).select(key, "_b", value, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length) - 1)).alias("_k"))
    return rows.select(key, (F.col("_b") + F.col("_k")).alias("i"), value)


def prefix_mod(df: DataFrame, lines: list[str], place: str, value: str, modulus: int, lane: Column | None = None) -> DataFrame:
    """Running sum modulo ``modulus`` along a line (PNG Sub; with resets as a line key, DC prediction)."""
    by = [F.col(c) for c in lines] + ([lane] if lane is not None else [])
    return df.withColumn(value, F.pmod(F.sum(value).over(Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)), F.lit(modulus)))


def coding_passes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Passes of a block with ``bitplanes, non_zero``: the top plane's cleanup, then three a plane."""
    n = F.when((F.col("bitplanes") == 0) | (F.col("non_zero") == 0), 0).otherwise(F.col("bitplanes") * 3 - 2)
    rows = df.withColumn("_n", n).where("_n > 0").withColumn("pass_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)))
    phase = F.pmod(F.col("pass_index") + 2, F.lit(3))
    kind = F.when(phase == 0, "significance").when(phase == 1, "refinement").otherwise("cleanup")
    return rows.select(*keys, "pass_index", kind.alias("kind"), (F.col("bitplanes") - 1 - F.expr("(pass_index + 2) div 3")).cast("bigint").alias("bitplane"))


def pass_count_code(n: Column) -> tuple[Column, Column]:
    """Prefix code of a packet's pass count: (bits as a number, length)."""
    code = F.when(n == 1, 0).when(n == 2, 2).when(n <= 5, n + 9).when(n <= 36, n - 6 + 480).otherwise(n - 37 + 65408)
    size = F.when(n == 1, 1).when(n == 2, 2).when(n <= 5, 4).when(n <= 36, 9).otherwise(16)
    return code.cast("bigint"), size.cast("bigint")


def bit_length(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("bigint")


def length_code_bits(df: DataFrame, keys: list[str], order: str, passes: str = "pass_count", size: str = "byte_length") -> DataFrame:
    """Bits that segment lengths take: the length state starts at 3 and only grows, a running maximum.

    A length of ``p`` passes has the state's bits and ``floor(log2 p)`` more; growth costs a bit a step, and
    one bit ends it.
    """
    extra = bit_length(F.col(passes)) - 1
    need = F.greatest(F.lit(3), bit_length(F.col(size)) - extra)
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_e", extra).withColumn("lblock", F.max(need).over(window))
    before = F.lag("lblock", 1, 3).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("length_bits", F.col("lblock") - before + 1 + F.col("lblock") + F.col("_e")).drop("_e")


def varint_size(n: Column) -> Column:
    """Bytes of a packet length in 7-bit groups."""
    return F.greatest(F.lit(1), F.floor((bit_length(n) + 6) / 7)).cast("bigint")
