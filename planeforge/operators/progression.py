"""Packet orders: the five progressions, sampled components, and composed schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sort keys of the progressions (fixed values); y and x are precinct positions on the reference grid.
ORDERS = {
    "LRCP": ("layer", "resolution", "component", "precinct_index"),
    "RLCP": ("resolution", "layer", "component", "precinct_index"),
    "RPCL": ("resolution", "precinct_index", "component", "layer"),
    "PCRL": ("y_ref", "x_ref", "component", "resolution", "layer"),
    "CPRL": ("component", "y_ref", "x_ref", "resolution", "layer"),
}
#: With sampled components precinct numbers no longer line up, so RPCL goes by position too.
SAMPLED_ORDERS = ORDERS | {"RPCL": ("resolution", "y_ref", "x_ref", "component", "layer")}


def packets(precincts: DataFrame, components: int, layers: int, keys: list[str]) -> DataFrame:
    """One row a packet, with its precinct's position on the reference grid."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    place = lambda index, size: F.call_function("shiftleft", F.col(index) * F.col(size), F.col("d").cast("int"))
    rows = precincts.select(*keys, "resolution", "precinct_index", "precinct_x", "precinct_y", place("precinct_y", "ph").alias("y_ref"), place("precinct_x", "pw").alias("x_ref"))
    return rows.withColumn("component", span(components)).withColumn("layer", span(layers))


def sampled_packets(precincts: DataFrame, layers: int, reference_x0: int, reference_y0: int) -> DataFrame:
    """``precincts`` with ``component, x_step, y_step``: positions scaled, not before the tile's start."""
    place = lambda index, size, step, least: F.greatest(F.call_function("shiftleft", F.col(index) * F.col(size) * F.col(step), F.col("d").cast("int")), F.lit(least))
    rows = precincts.select(
        "component", "resolution", "precinct_index", "precinct_x", "precinct_y",
        place("precinct_y", "ph", "y_step", reference_y0).alias("y_ref"), place("precinct_x", "pw", "x_step", reference_x0).alias("x_ref"),
    )
    return rows.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(layers - 1).cast("bigint"))))


def in_order(rows: DataFrame, order: str, keys: list[str], sampled: bool = False) -> DataFrame:
    """Adds ``sequence`` (0-based) within each tile."""
    by = (SAMPLED_ORDERS if sampled else ORDERS)[order]
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return rows.withColumn("sequence", F.row_number().over(window.orderBy(*by)).cast("bigint") - 1)


def rpcl_sequence(plan: list[int], resolution: Column, precinct: Column, component: Column, layer: Column, components: int, layers: int) -> Column:
    """The RPCL place in closed form: no sort.  ``plan``: precincts of each resolution."""
    before, out = 0, F.lit(None).cast("bigint")
    for r, n in enumerate(plan):
        out = F.when(resolution == r, F.lit(before * components * layers) + (precinct * components + component) * layers + layer).otherwise(out)
        before += n
    return out


def composed(rows: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """A schedule of progression records; a packet goes with the first record that covers it.

    ``records``: ``record, order, r_start, r_end, c_start, c_end, layer_end`` - a schedule is a few rows,
    bounded by the marker segment's 64 kB, so it is broadcast.
    """
    small = F.broadcast(records)
    covered = rows.join(small, (F.col("resolution") >= F.col("r_start")) & (F.col("resolution") < F.col("r_end")) & (F.col("component") >= F.col("c_start")) & (F.col("component") < F.col("c_end")) & (F.col("layer") < F.col("layer_end")))
    identity = Window.partitionBy(*keys, "resolution", "precinct_index", "component", "layer").orderBy("record")
    first = covered.withColumn("_n", F.row_number().over(identity)).where("_n = 1").drop("_n")
    rank = []
    for place in range(max(map(len, ORDERS.values()))):
        key = F.lit(None).cast("bigint")
        for order, by in ORDERS.items():
            if place < len(by):
                key = F.when(F.col("order") == order, F.col(by[place])).otherwise(key)
        rank.append(key)
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return first.withColumn("sequence", F.row_number().over(window.orderBy("record", *rank)).cast("bigint") - 1)


def uncovered(rows: DataFrame, scheduled: DataFrame, keys: list[str]) -> DataFrame:
    """Packets that a schedule leaves out; a sound one leaves none."""
    return rows.join(scheduled, [*keys, "resolution", "precinct_index", "component", "layer"], "left_anti")
