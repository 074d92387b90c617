"""Audits of marker sequences, part tables and manifests: rules as relational checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(parts: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Running start and end of concatenated parts."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(window)
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))


def gaps(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans that do not start where the one before ends: ``kind`` gap or overlap."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    found = spans.withColumn("expected", before).where(F.col("expected").isNotNull() & (F.col(start) != F.col("expected")))
    return found.withColumn("kind", F.when(F.col(start) > F.col("expected"), "gap").otherwise("overlap"))


def reconciled(declared: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer: ``keys..., declared, actual, verdict`` with verdict equal, differs, undeclared or missing."""
    a = declared.select(*keys, F.col(value).alias("declared"))
    b = actual.select(*keys, F.col(value).alias("actual"))
    verdict = F.when(F.col("declared").isNull(), "undeclared").when(F.col("actual").isNull(), "missing").when(F.col("declared") == F.col("actual"), "equal").otherwise("differs")
    return a.join(b, keys, "full_outer").withColumn("verdict", verdict)


def consecutive(rows: DataFrame, keys: list[str], order: str, index: str) -> DataFrame:
    """Rows whose index is not one more than the row's before (the first must be 0)."""
    before = F.lag(index, 1, -1).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).where(F.col(index) != F.col("before") + 1)


def unknown(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(allowed, on, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways, with its side; empty for equal relations."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overridden(base: Column, *narrower: Column) -> Column:
    """The narrowest header that is there: given from wide to narrow."""
    return F.coalesce(*reversed(narrower), base)


#: Main-header order: marker, how often at least and at most (fixed values).
MAIN_HEADER = (("SOC", 1, 1), ("SIZ", 1, 1), ("COD", 1, 1), ("QCD", 1, 1))


def header_faults(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Broken main-header rules over ``keys..., position, marker``.

    SOC first, SIZ second, COD and QCD once each, nothing behind SOT.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    ranked = markers.withColumn("_place", place)
    at = lambda m: F.min(F.when(F.col("marker") == m, F.col("_place")))
    count = lambda m: F.count_if(F.col("marker") == m)
    per = ranked.groupBy(*keys).agg(at("SOC").alias("soc"), at("SIZ").alias("siz"), at("SOT").alias("sot"), F.max("_place").alias("last"), *[count(m).alias(f"n_{m}") for m, _, _ in MAIN_HEADER])
    rules = [
        F.when(~F.col("soc").eqNullSafe(1), "SOC is not first"),
        F.when(~F.col("siz").eqNullSafe(2), "SIZ is not second"),
        *[F.when((F.col(f"n_{m}") < low) | (F.col(f"n_{m}") > high), f"{m} does not occur {low} to {high} times") for m, low, high in MAIN_HEADER],
        F.when(F.col("sot").isNotNull() & (F.col("sot") < F.col("last")), "markers behind SOT"),
    ]
    return per.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("fault"))


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` match within one name, letters in either case."""
    special = ".^$+{}[]|()\\"
    body = "".join("[^/\\\\]*" if c == "*" else "[^/\\\\]" if c == "?" else f"\\{c}" if c in special else c for c in pattern)
    return f"(?is)^{body}$"


def batch_plan(names: DataFrame, pattern: str, extension: str) -> DataFrame:
    """``input, output, collides``: matching names with the extension replaced, sorted by input."""
    stem = F.regexp_replace("name", r"\.[^./\\]*$", "")
    chosen = names.where(F.col("name").rlike(glob_to_regex(pattern))).select(F.col("name").alias("input"), F.concat(stem, F.lit(f".{extension}")).alias("output"))
    return chosen.withColumn("collides", F.count("*").over(Window.partitionBy("output")) > 1).orderBy("input")


#: Conversions by file extensions (fixed values).
CONVERSIONS = (
    ("tif", "jp2", "raster-to-jp2"), ("tiff", "jp2", "raster-to-jp2"), ("bmp", "jp2", "raster-to-jp2"), ("png", "jp2", "raster-to-jp2"),
    ("jpg", "jp2", "raster-to-jp2"), ("jpeg", "jp2", "raster-to-jp2"), ("dng", "jp2", "raster-to-jp2"), ("exr", "jp2", "raster-to-jp2"),
    ("jp2", "tif", "jp2-to-tiff"), ("jp2", "tiff", "jp2-to-tiff"), ("j2k", "pgx", "j2k-to-pgx"), ("j2k", "zraw", "j2k-to-zraw"),
)


def conversion(source: Column, target: Column) -> Column:
    """The command that two file names ask for; null if none."""
    ext = lambda c: F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for a, b, name in CONVERSIONS:
        out = F.when((ext(source) == a) & (ext(target) == b), name).otherwise(out)
    return out


def profile_faults(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Profile signalling: CAP and PRF at most once, CAP straight behind SIZ, PRF not before it."""
    order = Window.partitionBy(*keys).orderBy("position")
    rows = markers.withColumn("_before", F.lag("marker").over(order)).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "marker").orderBy("position")))
    fault = (
        F.when(F.col("marker").isin("CAP", "PRF") & (F.col("_nth") > 1), F.concat("marker", F.lit(" repeats")))
        .when((F.col("marker") == "CAP") & ~F.col("_before").eqNullSafe("SIZ"), "CAP is not behind SIZ")
        .when((F.col("marker") == "PRF") & ~F.col("_before").isin("SIZ", "CAP"), "PRF is not behind SIZ or CAP")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select(*keys, "position", "fault")
