"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import bands, state
from .registry import query

_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _folder(spark, d):
    """The events table as a folder, which a file stream needs: it may be a file or a folder of parts."""
    path = f"{d.rstrip('/')}/events.parquet"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return path if found.getFileSystem(conf).getFileStatus(found).isDirectory() else None


def _events(spark, d):
    folder = _folder(spark, d)
    if folder is None:
        # a single file: stream a copy of it in parts
        folder = scratch(spark, "events")
        spark.read.parquet(f"{d.rstrip('/')}/events.parquet").write.parquet(folder)
    return spark.readStream.schema(_SCHEMA).parquet(folder)


def _finished(spark, stream, mode, name):
    """Run a stream over all there is into a table and read that."""
    out = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    writer.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_ENERGY = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(floor(value) AS BIGINT) * CAST(floor(value) AS BIGINT)) AS BIGINT) AS energy FROM events GROUP BY 1, 2"


@query("events_tile_stream", _ENERGY)
def events_tile_stream(spark, d):
    """Energy for each day and kind, as a stream that is brought up to date: windows still open are there too."""
    out = scratch(spark, "energy")

    def write(batch, n):
        # a batch holds the new state of every window it touched; the last batch of a window counts
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    stream = state.window_energy(_events(spark, d))
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "energy"), "batch").alias("last"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "last.n", "last.energy")


@query("events_closed_windows", f"WITH w AS ({_ENERGY}) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def events_closed_windows(spark, d):
    """The same, a window appearing once when the watermark has passed its end."""
    found = _finished(spark, state.window_energy(_events(spark, d)), "append", "energy")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "energy")


@query("tile_stream_batches", "SELECT event_id // 1000 AS tile, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def tile_stream_batches(spark, d):
    """A tile sink by micro-batches: each batch appends its tiles, reading adds parts of one tile up."""
    out = scratch(spark, "tiles")

    def write(batch, _):
        tiles = batch.groupBy(F.expr("event_id div 1000").alias("tile")).agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("bigint")).alias("total"))
        tiles.write.mode("append").parquet(out)

    bands.stream_tiles(_events(spark, d), write, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("tile").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(
    "segment_stream",
    """WITH s AS (SELECT user_id AS key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT key, CAST(count(*) AS BIGINT) AS segments, CAST(sum(strlen(event_type)) AS BIGINT) AS bytes FROM s GROUP BY key""",
)
def segment_stream(spark, d):
    """Segments of each key joined in order by a stateful stream, as they come."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = spark.read.parquet(f"{d.rstrip('/')}/events.parquet")
    parts = rows.select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).alias("index"), F.col("event_type").alias("payload"), F.lead("event_id").over(order).isNull().alias("last"))
    folder = scratch(spark, "segments")
    parts.write.parquet(folder)
    stream = spark.readStream.schema(parts.schema).parquet(folder)
    joined = _finished(spark, state.collect_segments(stream), "append", "joined")
    return joined.select("key", F.col("segments").cast("bigint").alias("segments"), F.octet_length("payload").cast("bigint").alias("bytes"))
