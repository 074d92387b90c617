"""Rate allocation, layers, runs, coding passes and code sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rate, runs
from ..rasters import block_passes, rgb_events, table
from .registry import PASSES, RGB, ints, query


def _blocks(spark, d):
    return block_passes(spark, d).groupBy("block_id").agg(F.count("*").alias("pass_count"), F.max("cum_bytes").alias("byte_length"))


_EVEN = """even AS (SELECT block_id, CAST(l AS BIGINT) AS layer, CAST(CASE WHEN l = 3 THEN pass_count ELSE (pass_count * (l + 1) + 3) // 4 END AS BIGINT) AS passes, pass_count, byte_length FROM blocks, range(0, 4) t(l)),
layers AS (SELECT block_id, layer, passes, CAST(CASE WHEN passes >= pass_count THEN byte_length ELSE (byte_length * passes + pass_count - 1) // pass_count END AS BIGINT) AS bytes FROM even)"""


@query("layer_even", f"WITH {PASSES}, {_EVEN} SELECT * FROM layers")
def layer_even(spark, d):
    return rate.even_layers(_blocks(spark, d), 4, ["block_id"])


_RATES = [8.0, 3.0]


def _ratio_step(k: int) -> str:
    prev = f"r{k - 1}" if k else "(SELECT *, 0::BIGINT AS passes, 0::BIGINT AS bytes FROM blocks)"
    if k < len(_RATES):
        target = f"least(byte_length, greatest(1, CAST(ceil(byte_length / {_RATES[k]}::DOUBLE) AS BIGINT)))"
    else:
        target = f"bytes + (byte_length - bytes + {3 - k}) // {4 - k}"
    target = f"least(byte_length, greatest(bytes, {target}))"
    return f"""r{k} AS (SELECT block_id, pass_count, byte_length, p AS passes, CASE WHEN p >= pass_count THEN byte_length WHEN p = 0 THEN 0 ELSE (byte_length * p + pass_count - 1) // pass_count END AS bytes
  FROM (SELECT *, greatest(passes, least(pass_count, ({target} * pass_count + byte_length - 1) // byte_length)) AS p FROM {prev}))"""


@query(
    "layer_ratio",
    f"""WITH {PASSES}, {_ratio_step(0)}, {_ratio_step(1)}, {_ratio_step(2)}, r3 AS (SELECT block_id, pass_count AS passes, byte_length AS bytes FROM blocks)
    {" UNION ALL ".join(f"SELECT block_id, CAST({k} AS BIGINT) AS layer, CAST(passes AS BIGINT) AS passes, CAST(bytes AS BIGINT) AS bytes FROM r{k}" for k in range(4))}""",
)
def layer_ratio(spark, d):
    return rate.ratio_layers(_blocks(spark, d), _RATES, 4, ["block_id"])


@query(
    "layer_deltas",
    f"""WITH {PASSES}, {_EVEN}, dl AS (SELECT *, lag(passes, 1, 0) OVER w AS bp, lag(bytes, 1, 0) OVER w AS bb FROM layers WINDOW w AS (PARTITION BY block_id ORDER BY layer))
    SELECT block_id, layer, passes <> bp AS included, CAST(passes - bp AS BIGINT) AS pass_count, CAST(bb AS BIGINT) AS byte_offset, CAST(bytes - bb AS BIGINT) AS byte_length FROM dl""",
)
def layer_deltas(spark, d):
    return rate.layer_deltas(rate.even_layers(_blocks(spark, d), 4, ["block_id"]), ["block_id"]).select("block_id", "layer", "included", *ints(pass_count="pass_count", byte_offset="byte_offset", byte_length="byte_length"))


@query("layer_prefix", f"WITH {PASSES}, {_EVEN} SELECT block_id, max(layer) AS layer, max(passes) AS passes, max(bytes) AS bytes FROM layers WHERE layer < 2 GROUP BY block_id")
def layer_prefix(spark, d):
    """The first two layers; layers behind them are pruned before anything is decoded."""
    kept = rate.even_layers(_blocks(spark, d), 4, ["block_id"]).where("layer < 2")
    return kept.groupBy("block_id").agg(F.max("layer").alias("layer"), F.max("passes").alias("passes"), F.max("bytes").alias("bytes"))


@query("first_inclusion", f"WITH {PASSES}, {_EVEN} SELECT block_id, min(layer) AS layer FROM layers WHERE passes > block_id % 3 GROUP BY block_id")
def first_inclusion(spark, d):
    return rate.even_layers(_blocks(spark, d), 4, ["block_id"]).where(F.col("passes") > F.col("block_id") % 3).groupBy("block_id").agg(F.min("layer").alias("layer"))


@query("pass_prefix_bytes", f"WITH {PASSES} SELECT block_id, pass_index, bytes, cum_bytes FROM passes")
def pass_prefix_bytes(spark, d):
    return block_passes(spark, d).select(*ints(block_id="block_id", pass_index="pass_index", bytes="bytes", cum_bytes="cum_bytes"))


@query("image_layer_targets", f"""WITH {PASSES}, s AS (SELECT CAST(sum(byte_length) AS BIGINT) AS n FROM blocks), a AS (SELECT n, CAST(ceil(n / 8.0::DOUBLE) AS BIGINT) AS t0, CAST(ceil(n / 3.0::DOUBLE) AS BIGINT) AS t1 FROM s),
b AS (SELECT *, t1 + (n - t1 + 1) // 2 AS t2 FROM a) SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS layer, unnest([t0, t1, t2, n]) AS target FROM b""")
def image_layer_targets(spark, d):
    total = int(_blocks(spark, d).agg(F.sum("byte_length")).first()[0] or 0)
    return spark.createDataFrame(list(enumerate(rate.layer_targets(total, _RATES, 4))), "layer bigint, target bigint")


#: Hull by pairs: a pass is on the hull if no pair of others lies above it; slopes to the hull point before.
_HULL = f"""{PASSES},
pts AS (SELECT block_id, pass_index AS p, cum_bytes AS b, CAST(sum(greatest(CAST(round(distortion * 100) AS BIGINT), 0)) OVER (PARTITION BY block_id ORDER BY pass_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM passes),
hull AS (SELECT x.* FROM pts x WHERE
  NOT EXISTS (SELECT 1 FROM pts z WHERE z.block_id = x.block_id AND z.p > x.p AND z.b = x.b)
  AND NOT EXISTS (SELECT 1 FROM (SELECT block_id, p, b, t FROM pts UNION ALL SELECT DISTINCT block_id, 0, 0, 0 FROM pts) y, pts z
    WHERE y.block_id = x.block_id AND z.block_id = x.block_id AND y.p < x.p AND z.p > x.p AND y.b < x.b AND (z.t - x.t) / (z.b - x.b) >= (x.t - y.t) / (x.b - y.b))),
slopes AS (SELECT block_id, p AS passes, CAST(b AS BIGINT) AS bytes, t AS distortion, (t - lag(t, 1, 0) OVER w) / (b - lag(b, 1, 0) OVER w) AS slope FROM hull WINDOW w AS (PARTITION BY block_id ORDER BY p))"""


def _cents(passes):
    """Distortions as whole numbers, so that their sums do not depend on the order of adding."""
    return passes.withColumn("distortion", F.round(F.col("distortion") * 100).cast("bigint"))


@query("pcrd_hull", f"WITH {_HULL} SELECT block_id, passes, bytes, distortion::DOUBLE AS distortion, slope FROM slopes")
def pcrd_hull(spark, d):
    return rate.hull_points(_cents(block_passes(spark, d)))


@query(
    "pcrd_threshold",
    f"""WITH {_HULL}, st AS (SELECT slope, bytes - lag(bytes, 1, 0) OVER (PARTITION BY block_id ORDER BY slope DESC) AS delta FROM slopes),
    run AS (SELECT slope, sum(delta) OVER (ORDER BY slope DESC RANGE UNBOUNDED PRECEDING) AS total FROM st),
    bud AS (SELECT CAST(sum(byte_length) AS BIGINT) // 3 AS n FROM blocks)
    SELECT min(slope) AS slope, CAST(max(total) AS BIGINT) AS bytes FROM run, bud WHERE total <= n""",
)
def pcrd_threshold(spark, d):
    points = rate.hull_points(_cents(block_passes(spark, d)))
    budget = int(_blocks(spark, d).agg(F.sum("byte_length")).first()[0] or 0) // 3
    return rate.slope_threshold(points, budget).select("slope", *ints(bytes="bytes"))


@query(
    "truncation_backoff",
    f"""WITH {PASSES.replace('passes AS (', 'passes AS MATERIALIZED (')}, q AS MATERIALIZED (SELECT block_id, pass_count - 1 AS req, CASE WHEN pass_count > 3 THEN 1 ELSE 0 END AS bp, byte_length FROM blocks),
    qq AS (SELECT q.*, coalesce(p.cum_bytes, 0) AS bb FROM q LEFT JOIN passes p ON p.block_id = q.block_id AND p.pass_index = q.bp),
    ok AS (SELECT qq.block_id, max(p.pass_index) AS passes, max(p.cum_bytes) AS bytes FROM qq JOIN passes p ON p.block_id = qq.block_id WHERE p.pass_index <= req AND p.pass_index > bp AND p.cum_bytes > bb AND p.cum_bytes < byte_length GROUP BY 1)
    SELECT qq.block_id, CAST(coalesce(passes, bp) AS BIGINT) AS passes, CAST(coalesce(bytes, bb) AS BIGINT) AS bytes FROM qq LEFT JOIN ok USING (block_id)""",
)
def truncation_backoff(spark, d):
    passes = block_passes(spark, d)
    asked = _blocks(spark, d).select("block_id", (F.col("pass_count") - 1).alias("requested"), F.when(F.col("pass_count") > 3, 1).otherwise(0).alias("before_passes"))
    before = passes.select("block_id", F.col("pass_index").alias("before_passes"), F.col("cum_bytes").alias("before_bytes"))
    asked = asked.join(before, ["block_id", "before_passes"], "left").withColumn("before_bytes", F.coalesce("before_bytes", F.lit(0)))
    return rate.legal_truncations(asked, passes).select(*ints(block_id="block_id", passes="passes", bytes="bytes"))


#: Byte strings: what ``events`` has of a user, as one byte a row, so that there are runs of every length.
_BYTES = """seq AS (SELECT user_id % 16 AS k, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS BIGINT) AS i, CASE WHEN value < 300 THEN 0 WHEN value < 400 THEN 255 ELSE CAST(floor(value) AS BIGINT) % 5 END AS b FROM events)"""
_RUNS = """ch AS (SELECT k, i, b, CASE WHEN b <> lag(b) OVER w THEN 1 ELSE 0 END AS c FROM seq WINDOW w AS (PARTITION BY k ORDER BY i)),
grp AS (SELECT k, i, b, sum(c) OVER (PARTITION BY k ORDER BY i) AS run FROM ch),
runs AS (SELECT k, CAST(run AS BIGINT) AS run, min(i) AS start, CAST(count(*) AS BIGINT) AS length, min(b) AS b FROM grp GROUP BY k, run)"""


def _bytes(spark, d):
    from pyspark.sql import Window

    value = F.when(F.col("value") < 300, 0).when(F.col("value") < 400, 255).otherwise(F.floor("value") % 5)
    key = F.col("user_id") % 16
    place = F.row_number().over(Window.partitionBy(key).orderBy("event_id")) - 1
    return table(spark, d, "events").select(*ints(k=key, i=place, b=value))


@query("rle_runs", f"WITH {_BYTES}, {_RUNS} SELECT * FROM runs")
def rle_runs(spark, d):
    return runs.runs(_bytes(spark, d), "k", "i", "b").select(*ints(k="k", run="run", start="start", length="length", b="value"))


_RLE = """isl AS (SELECT *, sum(CASE WHEN length >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY run) AS island,
  CASE WHEN length >= 4 THEN (length // 255 + CASE WHEN length % 255 >= 4 THEN 1 ELSE 0 END) * 3 ELSE 0 END AS code, CASE WHEN length < 4 THEN length WHEN length % 255 < 4 THEN length % 255 ELSE 0 END AS loose FROM runs),
lit AS (SELECT k, island, sum(code) AS code, sum(loose) AS loose, sum(length) AS n FROM isl GROUP BY k, island),
rle AS (SELECT k, CAST(sum(n) AS BIGINT) AS raw_len, CAST(sum(code + loose + 2 * ((loose + 254) // 255)) AS BIGINT) AS rle_len FROM lit GROUP BY k)"""


@query("rle_size", f"WITH {_BYTES}, {_RUNS}, {_RLE} SELECT * FROM rle")
def rle_size(spark, d):
    return runs.rle_sizes(_bytes(spark, d), "k")


_BITS = """bit AS (SELECT k, i * 8 + j AS p, (b >> (7 - j)) & 1 AS v FROM seq, range(0, 8) t(j)), bc AS (SELECT k, p, CASE WHEN v <> lag(v) OVER (PARTITION BY k ORDER BY p) THEN 1 ELSE 0 END AS c FROM bit),
bg AS (SELECT k, sum(c) OVER (PARTITION BY k ORDER BY p) AS g FROM bc), br AS (SELECT k, g, count(*) AS n FROM bg GROUP BY ALL), brle AS (SELECT k, CAST(sum((n + 126) // 127) AS BIGINT) AS bit_rle_len FROM br GROUP BY k)"""


@query("bit_rle_size", f"WITH {_BYTES}, {_BITS} SELECT * FROM brle")
def bit_rle_size(spark, d):
    return runs.bit_rle_sizes(_bytes(spark, d), "k")


@query(
    "auto_method",
    f"""WITH {_BYTES}, {_RUNS}, {_RLE}, {_BITS}, tr AS (SELECT k, count(*) <= 64 OR count(*) FILTER (b IN (0, 1, 128, 255)) * 4 >= count(*) * 3 AS tried FROM seq GROUP BY k)
    SELECT k, CASE WHEN tried AND bit_rle_len < raw_len AND bit_rle_len <= rle_len THEN 'bit_rle' WHEN rle_len < raw_len THEN 'rle' ELSE 'raw' END AS method FROM rle JOIN brle USING (k) JOIN tr USING (k)""",
)
def auto_method(spark, d):
    rows = _bytes(spark, d)
    sizes = runs.rle_sizes(rows, "k").join(runs.bit_rle_sizes(rows, "k"), "k").join(runs.simple_share(rows, "k"), "k")
    return sizes.select("k", runs.method(F.col("raw_len"), F.col("rle_len"), F.col("bit_rle_len"), F.col("tried")).alias("method"))


@query("rle_decode", f"WITH {_BYTES} SELECT * FROM seq")
def rle_decode(spark, d):
    coded = runs.runs(_bytes(spark, d), "k", "i", "b")
    return runs.expanded(coded, "k", "run", "length", "value").select(*ints(k="k", i="i", b="value"))


@query(
    "text_byte_runs",
    """WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(CASE WHEN len(l) = 0 THEN 0 ELSE 1 + len(list_filter(range(2, len(l) + 1), lambda i: l[i] <> l[i - 1])) END AS BIGINT) AS runs FROM b""",
)
def text_byte_runs(spark, d):
    """Runs of UTF-8 bytes inside the row, by one pattern over the hex digits: no explode, no exchange."""
    text = F.coalesce("text", F.lit(""))
    count = F.regexp_count(F.hex(F.encode(text, "UTF-8")), F.lit(r"(..)\1*+"))
    return table(spark, d, "documents").select("doc_id", *ints(n=F.octet_length(text), runs=count))


@query("png_sub_unfilter", f"WITH {RGB} SELECT y, x, r AS v FROM rgb")
def png_sub_unfilter(spark, d):
    """Sub-filtered rows back to samples: a running sum modulo 256."""
    from pyspark.sql import Window

    rgb = rgb_events(spark, d)
    coded = rgb.select("y", "x", F.pmod(F.col("r") - F.lag("r", 1, 0).over(Window.partitionBy("y").orderBy("x")), F.lit(256)).alias("v"))
    return runs.prefix_mod(coded, ["y"], "x", "v", 256).select("y", "x", *ints(v="v"))


@query("png_up_unfilter", f"WITH {RGB} SELECT y, x, CAST(sum(g) OVER (PARTITION BY x ORDER BY y) AS BIGINT) % 256 AS v FROM rgb")
def png_up_unfilter(spark, d):
    return runs.prefix_mod(rgb_events(spark, d).select("y", "x", F.col("g").alias("v")), ["x"], "y", "v", 256).select("y", "x", *ints(v="v"))


@query("dc_prediction", f"WITH {RGB} SELECT y, x, CAST(sum(r - 128) OVER (PARTITION BY y // 4 ORDER BY y, x) AS BIGINT) AS v FROM rgb")
def dc_prediction(spark, d):
    """DC differences summed within restart intervals of four block rows."""
    from pyspark.sql import Window

    window = Window.partitionBy(F.expr("y div 4")).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    return rgb_events(spark, d).select("y", "x", *ints(v=F.sum(F.col("r") - 128).over(window)))


@query(
    "coding_passes",
    f"""WITH {PASSES}, bb AS (SELECT block_id, byte_length % 9 AS bp, pass_count AS nz FROM blocks)
    SELECT block_id, CAST(i AS BIGINT) AS pass_index, CASE WHEN i = 0 THEN 'cleanup' ELSE ['significance', 'refinement', 'cleanup'][(i - 1) % 3 + 1] END AS kind, CAST(CASE WHEN i = 0 THEN bp - 1 ELSE bp - 2 - (i - 1) // 3 END AS BIGINT) AS bitplane
    FROM bb, range(0, 30) t(i) WHERE bp > 0 AND i < 3 * bp - 2""",
)
def coding_passes(spark, d):
    blocks = _blocks(spark, d).select("block_id", (F.col("byte_length") % 9).alias("bitplanes"), F.col("pass_count").alias("non_zero"))
    return runs.coding_passes(blocks, ["block_id"])


@query(
    "passcount_bits",
    """SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 2 WHEN n <= 5 THEN 12 + n - 3 WHEN n <= 36 THEN 15 * 32 + n - 6 ELSE 511 * 128 + n - 37 END AS BIGINT) AS code,
    CAST(CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN n <= 5 THEN 4 WHEN n <= 36 THEN 9 ELSE 16 END AS BIGINT) AS bits FROM range(1, 165) t(n)""",
)
def passcount_bits(spark, d):
    code, size = runs.pass_count_code(F.col("id"))
    return spark.range(1, 165).select(*ints(n="id"), code.alias("code"), size.alias("bits"))


_BL = "CASE WHEN {0} = 0 THEN 0 ELSE CAST(floor(log2({0})) AS BIGINT) + 1 END".format


@query(
    "lblock_bits",
    f"""WITH {PASSES}, {_EVEN}, dl AS (SELECT block_id, layer, passes - lag(passes, 1, 0) OVER w AS p, bytes - lag(bytes, 1, 0) OVER w AS n FROM layers WINDOW w AS (PARTITION BY block_id ORDER BY layer)),
    nd AS (SELECT *, {_BL("p")} - 1 AS e, greatest(3, {_BL("n")} - ({_BL("p")} - 1)) AS need FROM dl WHERE p > 0),
    lb AS (SELECT *, max(need) OVER (PARTITION BY block_id ORDER BY layer) AS lblock FROM nd)
    SELECT block_id, layer, CAST(lblock AS BIGINT) AS lblock, CAST(lblock - lag(lblock, 1, 3) OVER (PARTITION BY block_id ORDER BY layer) + 1 + lblock + e AS BIGINT) AS length_bits FROM lb""",
)
def lblock_bits(spark, d):
    deltas = rate.layer_deltas(rate.even_layers(_blocks(spark, d), 4, ["block_id"]), ["block_id"]).where("included")
    return runs.length_code_bits(deltas, ["block_id"], "layer").select("block_id", "layer", *ints(lblock="lblock", length_bits="length_bits"))


@query("plt_varint_sizes", f"WITH {PASSES} SELECT block_id, byte_length, CAST(CASE WHEN byte_length < 128 THEN 1 WHEN byte_length < 16384 THEN 2 ELSE 3 END AS BIGINT) AS bytes FROM blocks")
def plt_varint_sizes(spark, d):
    return _blocks(spark, d).select("block_id", "byte_length", runs.varint_size(F.col("byte_length")).alias("bytes"))


@query("zero_bitplanes", f"WITH {PASSES} SELECT block_id, CAST(10 - byte_length % 9 AS BIGINT) AS zero_planes, byte_length % 9 > 0 AS included FROM blocks")
def zero_bitplanes(spark, d):
    return _blocks(spark, d).select("block_id", *ints(zero_planes=F.lit(10) - F.col("byte_length") % 9), (F.col("byte_length") % 9 > 0).alias("included"))


@query("packet_presence", f"WITH {PASSES}, {_EVEN} SELECT block_id // 64 AS precinct, layer, bool_or(passes > 0) AS present, CAST(count(*) FILTER (passes > 0) AS BIGINT) AS blocks FROM layers GROUP BY ALL")
def packet_presence(spark, d):
    rows = rate.even_layers(_blocks(spark, d), 4, ["block_id"])
    return rows.groupBy(F.expr("block_id div 64").alias("precinct"), "layer").agg(F.bool_or(F.col("passes") > 0).alias("present"), F.count_if(F.col("passes") > 0).alias("blocks"))


@query("style_flags", "SELECT CAST(s AS BIGINT) AS style, CAST(bit_count(s::BIGINT) AS BIGINT) AS flags, s & 1 = 1 AS bypass, (s >> 2) & 1 = 1 AS terminate FROM range(0, 64) t(s)")
def style_flags(spark, d):
    s = F.col("id")
    return spark.range(64).select(*ints(style="id", flags=F.bit_count("id")), (s.bitwiseAND(F.lit(1)) == 1).alias("bypass"), (F.shiftright(s, 2).bitwiseAND(F.lit(1)) == 1).alias("terminate"))


@query(
    "bypass_segments",
    """WITH p AS (SELECT bp, i FROM range(1, 13) t(bp), range(0, 34) u(i) WHERE i < 3 * bp - 2), s AS (SELECT bp, i, CASE WHEN i < 10 THEN 0 ELSE 1 + 2 * ((i - 10) // 3) + CASE WHEN (i - 10) % 3 = 2 THEN 1 ELSE 0 END END AS seg FROM p)
    SELECT CAST(bp AS BIGINT) AS bitplanes, CAST(seg AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS passes FROM s GROUP BY ALL""",
)
def bypass_segments(spark, d):
    """Segments in bypass mode: ten passes, then by turns two raw and one coded."""
    rows = spark.range(1, 13).withColumnRenamed("id", "bitplanes").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bitplanes") * 3 - 3)))
    late = F.col("i") - 10
    segment = F.when(F.col("i") < 10, 0).otherwise(F.floor(late / 3) * 2 + 1 + (F.pmod(late, F.lit(3)) == 2).cast("int"))
    return rows.groupBy("bitplanes", segment.cast("bigint").alias("segment")).agg(F.count("*").alias("passes"))
