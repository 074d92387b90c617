"""Stateful streams and layered allocation."""

import random

import pytest
from pyspark.sql import functions as F

from planeforge.operators import rate
from planeforge.streaming import bands, state


def _run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _batches(spark, tmp_path, schema, *batches):
    """A file stream that reads one file a micro-batch."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def test_packet_counts_go_on_over_batches(spark, tmp_path):
    stream = _batches(spark, tmp_path, "tile bigint, part int, packets int", [(1, 0, 5), (2, 0, 3)], [(1, 1, 7)], [(1, 2, 1), (2, 1, 4)])
    found = sorted(tuple(r) for r in _run(spark, state.packet_counts(stream), tmp_path).collect())
    assert found == [(1, 0, 0), (1, 1, 5), (1, 2, 12), (2, 0, 0), (2, 1, 3)]


def test_segments_wait_for_their_turn(spark, tmp_path):
    schema = "key bigint, index int, payload string, last boolean"
    stream = _batches(spark, tmp_path, schema, [(1, 2, "c", True), (2, 0, "x", False)], [(1, 0, "a", False)], [(1, 1, "b", False), (2, 1, "y", True)])
    found = {r["key"]: (r["segments"], bytes(r["payload"])) for r in _run(spark, state.collect_segments(stream), tmp_path).collect()}
    assert found == {1: (3, b"abc"), 2: (2, b"xy")}


def test_repeated_segments_are_refused(spark, tmp_path):
    schema = "key bigint, index int, payload string, last boolean"
    stream = _batches(spark, tmp_path, schema, [(1, 0, "a", False)], [(1, 0, "b", True)])
    with pytest.raises(Exception, match="repeats"):
        _run(spark, state.collect_segments(stream), tmp_path)


def test_tile_stream(spark, tmp_path):
    stream = _batches(spark, tmp_path, "tile bigint, v bigint", [(1, 1)], [(2, 2), (1, 3)])
    seen = []
    bands.stream_tiles(stream, lambda batch, n: seen.extend((n, *r) for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(r[1:] for r in seen) == [(1, 1), (1, 3), (2, 2)] and len({r[0] for r in seen}) == 2


def test_layers_by_one_threshold(spark):
    """Every layer takes the points of the steepest slopes that fit, over all blocks together."""
    rng = random.Random(3)
    rows, hulls, counts = [], {}, {}
    for block in range(12):
        size, passes = 0, []
        for k in range(1, rng.randint(2, 9)):
            size += rng.randint(1, 20)
            passes.append((k, size, rng.randint(0, 500)))
        rows += [(block, *p) for p in passes]
        hulls[block], counts[block] = rate.hull(passes), len(passes)
    points = rate.hull_points(spark.createDataFrame(rows, "block_id bigint, pass_index bigint, cum_bytes bigint, distortion bigint"))
    blocks = spark.createDataFrame(list(counts.items()), "block_id bigint, pass_count bigint")
    targets = [60, 200, 10_000]
    found = {(r["block_id"], r["layer"]): r["passes"] for r in rate.pcrd_layers(points, blocks, targets).collect()}
    slopes = sorted({p[3] for h in hulls.values() for p in h}, reverse=True)
    for layer, target in enumerate(targets):
        total = lambda cut: sum(max((p[1] for p in h if p[3] >= cut), default=0) for h in hulls.values())
        fitting = [s for s in slopes if total(s) <= target]
        cut = min(fitting, default=float("inf"))
        for block, h in hulls.items():
            want = counts[block] if layer == 2 else max((p[0] for p in h if p[3] >= cut), default=0)
            assert found[block, layer] == want


def test_windowed_energy_matches_batch(spark, tables, tmp_path):
    events = spark.read.parquet(f"{tables}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = state.window_energy(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    closed = _run(spark, stream, tmp_path)
    v = F.floor("value").cast("bigint")
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum(v * v).alias("energy"))
    assert closed.count() > 0 and closed.exceptAll(want).count() == 0
