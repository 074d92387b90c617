"""Stateful streams: segments in order, packet counts over tile-parts, and windowed energy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collect_segments(segments: DataFrame) -> DataFrame:
    """``key, index, payload`` segments of a stream, joined when the one marked ``last`` has come.

    Indexes count up from 0; what arrives early waits in the state, which holds a key's open segments
    only.  Output: ``key, segments, payload``.  An index that repeats is an error.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, waiting, end, count = state.get if state.exists else (b"", [], -1, 0)
        done, held = bytes(done), {int(k): bytes(v) for k, v in waiting}
        for batch in batches:
            for row in batch.itertuples():
                index = int(row.index_)
                if index < count or index in held:
                    raise ValueError(f"segment {index} of {key[0]} repeats")
                held[index] = bytes(row.payload)
                if row.last:
                    end = index
        while count in held:
            done += held.pop(count)
            count += 1
        if 0 <= end < count and not held:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "segments": [count], "payload": [done]})
        else:
            state.update((done, [(k, v) for k, v in sorted(held.items())], end, count))

    shaped = segments.select("key", F.col("index").cast("int").alias("index_"), F.col("payload").cast("binary").alias("payload"), "last")
    return shaped.groupBy("key").applyInPandasWithState(
        step, "key bigint, segments int, payload binary", "done binary, held array<struct<k:int,v:binary>>, end int, count int", "append", GroupStateTimeout.NoTimeout
    )


def packet_counts(parts: DataFrame) -> DataFrame:
    """``tile, part, packets``: how many packets a tile had before each of its parts, over micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, expected = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("part")
        out = []
        for row in rows.itertuples():
            if int(row.part) != expected:
                raise ValueError(f"part {row.part} of tile {key[0]} is out of order")
            out.append((key[0], expected, before))
            before, expected = before + int(row.packets), expected + 1
        state.update((before, expected))
        yield pd.DataFrame(out, columns=["tile", "part", "before"])

    return parts.groupBy("tile").applyInPandasWithState(step, "tile bigint, part int, before bigint", "before bigint, expected int", "append", GroupStateTimeout.NoTimeout)


def window_energy(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and summed squares of whole-numbered values for each window and kind, closed by a watermark."""
    v = F.floor("value").cast("bigint")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(v * v).alias("energy")).select(F.col("window.start").alias("start"), "event_type", "n", "energy")
