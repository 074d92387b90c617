"""Hilbert-curve ordering and sharding (operator 10), DataFrame functions only.

Metadata dimensions are quantised to a few bits each, interleaved by the Hilbert curve into one index,
rows are range-sorted by it (ties by content and id), and the sorted rows are cut into runs.  A category's cells follow
the order of its values, and a size's its logarithm, so neighbours on the curve have neighbouring values: a shard
covers a compact box of the dimensions, and files can be skipped by the minima and maxima of any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import free_name


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve; each coordinate is an integer of ``bits`` bits.

    One step per bit level: the level's bits name a corner of the current sub-cube; the corner is
    turned into the sub-cube's own frame (entry corner and axis), its Gray rank is the next digit, and
    the frame of the sub-cube that it names is the next frame.
    """
    n = len(coordinates)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(i) for i in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]

    def ones(i: int) -> int:
        """Trailing one bits."""
        return 0 if not i & 1 else 1 + ones(i >> 1)

    axis = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]
    table = lambda values: F.array(*map(F.lit, values))
    turn_left = lambda v, k: (F.call_function("shiftleft", v, k).bitwiseOR(F.call_function("shiftright", v, F.lit(n) - k))).bitwiseAND(F.lit(full))
    turn_right = lambda v, k: (F.call_function("shiftright", v, k).bitwiseOR(F.call_function("shiftleft", v, F.lit(n) - k))).bitwiseAND(F.lit(full))
    levels = F.array(*[_corner(coordinates, level) for level in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))

    def step(state: Column, corner: Column) -> Column:
        shift = state["d"] + F.lit(1)
        digit = F.element_at(table(rank), turn_right(corner.bitwiseXOR(state["e"]), shift) + F.lit(1))
        return F.struct(
            state["e"].bitwiseXOR(turn_left(F.element_at(table(entry), digit + F.lit(1)), shift)).alias("e"),
            F.pmod(state["d"] + F.element_at(table(axis), digit + F.lit(1)) + F.lit(1), F.lit(n)).alias("d"),
            (state["h"] * F.lit(1 << n) + digit).cast("long").alias("h"),
        )

    return F.aggregate(levels, start, step, lambda state: state["h"])


def _corner(coordinates: list[Column], level: int) -> Column:
    out = F.lit(0)
    for k, c in enumerate(coordinates):
        bit = F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1))
        out = out.bitwiseOR(F.shiftleft(bit, k))
    return out


#: Up to so many distinct values of a category are ranked on the driver, and on the cluster beyond.
MOST_VALUES = 4096


def category_starts(df: DataFrame, column: str, bits: int) -> list[tuple[str, int]]:
    """Values and the cells that begin with them, both rising; cell 0 is before the first value and for nulls.

    All distinct values are ranked, and each cell but 0 gets as many of them, however many there are.
    """
    value = F.col(f"`{column}`").cast("string")
    distinct = df.select(value.alias("v")).where("v is not null").distinct()
    cells = (1 << bits) - 1
    some = distinct.limit(MOST_VALUES + 1).collect()
    if len(some) > MOST_VALUES:
        cell = F.expr(f"1 + place * {cells} div total").cast("int")
        firsts = _placed(distinct, [F.col("v")]).groupBy(cell.alias("cell")).agg(F.min("v").alias("v"))
        return sorted(((r["v"], r["cell"]) for r in firsts.collect()), key=lambda start: start[1])
    values = sorted((r["v"] for r in some), key=lambda v: v.encode())
    out: list[tuple[str, int]] = []
    for k, v in enumerate(values):
        cell = 1 + k * cells // len(values)
        if not out or out[-1][1] < cell:
            out.append((v, cell))
    return out


def category_cell(column: Column, starts: list[tuple[str, int]]) -> Column:
    """The cell of a value: that of the last start that is not greater."""
    out = F.lit(0)
    for value, cell in starts:
        out = F.when(column.cast("string") >= F.lit(value), F.lit(cell)).otherwise(out)
    return out.cast("int")


def log_cell(column: Column, bits: int, per_octave: int = 2) -> Column:
    """A positive size's cell on a logarithmic scale, clipped at the ends."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) * per_octave).cast("int")))


def hilbert_sorted(df: DataFrame, dimensions: list[Column], bits: int, ties: list[Column]) -> DataFrame:
    """The rows in curve order with their global place: adds ``curve``, ``place`` (0-based) and
    ``total`` (the count of all rows), all long.
    """
    return _placed(df.withColumn("curve", hilbert_index(dimensions, bits)), [F.col("curve"), *ties])


def _placed(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows sorted by keys with ``place`` and ``total``.

    The sorted rows are checkpointed, so that the counts of the partitions and the rows come from the
    same sort.  Only the partitions' counts, one number each, meet in a single task.
    """
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    checkpoint_dir(df.sparkSession)
    tagged = parts.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return tagged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + inside).drop("_part", "_at", "_before")


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text plus 1; null has none."""
    return (F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) + 1).cast("long")


def shard_rows(df: DataFrame, shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``: one row per row.

    Dimensions: the categories in the order of their values, and the size on a log scale.  Law ``rows``: run ``s`` holds the
    places from ``s * n / shards`` (rounded up) on, so counts differ by at most one; ``slot`` counts
    from 0 within it.  Null categories, ids and texts have cells like other values; fewer rows than
    shards leave some shards empty.
    """
    size = text_size(text_col)
    crc = F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("string").cast("binary")), F.lit(0)).cast("long")
    cells = [category_cell(F.col(f"`{c}`"), category_starts(df, c, bits)).alias(f"_c{k}") for k, c in enumerate(categories)]
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *cells)
    dimensions = [F.col(f"_c{k}") for k in range(len(categories))] + [log_cell(F.col("size"), bits)]
    placed = hilbert_sorted(slim, dimensions, bits, [F.col("size"), F.col("text_crc32"), F.col("doc_id")])
    shard = F.expr(f"place * {shards} div total").cast("int")
    first = F.expr(f"(_s * total + {shards - 1}) div {shards}")
    return placed.withColumn("_s", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_s").alias("shard"),
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> None:
    """Write the table as Parquet below ``path/shard=N``, each shard in curve order.

    Needs unique ids: the shard of a row is looked up by its id.  A column named ``shard`` gives way.
    """
    names = [free_name(df, n) for n in ("_id", "_curve", "_slot")]
    found = shard_rows(df, shards, bits, id_col, text_col, categories)
    placed = found.select(F.col("doc_id").alias(names[0]), "shard", F.col("curve").alias(names[1]), F.col("slot").alias(names[2]))
    kept = [c for c in df.columns if c.lower() != "shard"]
    rows = df.select(*[F.col(f"`{c}`") for c in kept]).join(placed, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(names[0])))
    rows.repartitionByRange("shard", names[2]).sortWithinPartitions("shard", names[2]).drop(*names).write.partitionBy("shard").parquet(path)
