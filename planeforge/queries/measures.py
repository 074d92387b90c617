"""Block statistics, error measures, contexts, pyramids, audits and batch plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import audits, stats
from ..rasters import block_passes, embedding_plane, rgb_events, table
from .registry import PASSES, PLANE, RGB, ints, query, reals

def _tile():
    return [F.expr("y div 16").alias("ty"), F.expr("x div 16").alias("tx")]


@query(
    "block_stats",
    f"""WITH {PLANE}, c AS (SELECT y // 16 AS ty, x // 16 AS tx, y, x, CAST(trunc(v / 8.0) AS BIGINT) AS v FROM plane)
    SELECT ty, tx, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS non_zero, max(abs(v)) AS max_magnitude, min(x) FILTER (v <> 0) AS min_x, max(x) FILTER (v <> 0) AS max_x, min(y) FILTER (v <> 0) AS min_y, max(y) FILTER (v <> 0) AS max_y,
    CAST(CASE WHEN max(abs(v)) = 0 THEN 0 ELSE floor(log2(max(abs(v)))) + 1 END AS BIGINT) AS bitplanes FROM c GROUP BY ALL""",
)
def block_stats(spark, d):
    coarse = embedding_plane(spark, d).withColumn("v", F.expr("v div 8"))
    return stats.block_stats(coarse.select(*_tile(), "y", "x", "v"), ["ty", "tx"])


@query("coverage_check", f"WITH {RGB} SELECT CAST(count(*) AS BIGINT) AS once, CAST(0 AS BIGINT) AS more, CAST((SELECT max(y) + 1 FROM rgb) * 100 - count(*) AS BIGINT) AS never FROM rgb")
def coverage_check(spark, d):
    rgb = rgb_events(spark, d)
    height = int(rgb.agg(F.max("y")).first()[0]) + 1
    return stats.coverage(rgb, [], height, 100)


@query("component_totals", f"WITH {RGB}, s AS (SELECT c AS component, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb, range(0, 3) t(c)) SELECT CAST(component AS BIGINT) AS component, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY ROLLUP (component)")
def component_totals(spark, d):
    from ..rasters import to_planes

    return to_planes(rgb_events(spark, d)).rollup("component").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("pass_counters", f"WITH {PASSES} SELECT CASE WHEN pass_index = 1 THEN 'cleanup' ELSE ['significance', 'refinement', 'cleanup'][(pass_index - 2) % 3 + 1] END AS kind, CAST(count(*) AS BIGINT) AS passes, CAST(sum(bytes) AS BIGINT) AS bytes FROM passes GROUP BY 1")
def pass_counters(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("significance", "refinement", "cleanup"))), (F.pmod(F.col("pass_index") + 1, F.lit(3)) + 1).cast("int"))
    return block_passes(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("passes"), F.sum("bytes").alias("bytes"))


_ERR = "e AS (SELECT v - CAST(sign(v) * floor(abs(v) / 3.0::DOUBLE) AS BIGINT) * 3 AS e FROM plane)"


@query("mse_peak_psnr", f"WITH {PLANE}, {_ERR} SELECT CAST(count(*) AS BIGINT) AS n, max(abs(e)) AS peak, CAST(sum(e * e) AS BIGINT) AS sse, CAST(count(*) FILTER (e <> 0) AS BIGINT) AS differing, round(sum(e * e)::DOUBLE / count(*), 9) AS mse, round(10.0::DOUBLE * log10(65025.0::DOUBLE / (sum(e * e)::DOUBLE / count(*))), 9) AS psnr FROM e")
def mse_peak_psnr(spark, d):
    plane = embedding_plane(spark, d)
    coarse = plane.withColumn("v", color.dead_zone(F.col("v"), F.lit(3.0)) * 3)
    return stats.error(plane, coarse, ["y", "x"]).select(*ints(n="n", peak="peak", sse="sse", differing="differing"), *reals(mse=F.round("mse", 9), psnr=F.round("psnr", 9)))


@query("pixel_diff", f"WITH {RGB} SELECT CAST(count(*) FILTER (r <> g) AS BIGINT) AS differing, max(abs(r - g)) AS peak, bool_and(r = g) AS equal FROM rgb")
def pixel_diff(spark, d):
    apart = F.abs(F.col("r") - F.col("g"))
    return rgb_events(spark, d).agg(F.count_if(apart > 0).alias("differing"), F.max(apart).alias("peak"), F.bool_and(F.col("r") == F.col("g")).alias("equal"))


@query(
    "plane_sha256",
    f"""WITH {PLANE}, t AS (SELECT y // 16 AS ty, x // 16 AS tx, y, x, v FROM plane), h AS (SELECT ty, tx, count(DISTINCT y) AS h, string_agg(printf('%04x', CASE WHEN v < 0 THEN v + 65536 ELSE v END), '' ORDER BY y, x) AS s FROM t GROUP BY ALL)
    SELECT ty, tx, sha256(unhex(printf('%08x', h) || '00000010' || s)) AS sha256 FROM h""",
)
def plane_sha256(spark, d):
    return stats.plane_sha256(embedding_plane(spark, d).select(*_tile(), "y", "x", "v"), ["ty", "tx"])


@query(
    "pass_distortion",
    f"""WITH {PLANE}, b AS (SELECT y // 16 AS ty, x // 16 AS tx, abs(v) AS m, p FROM plane, range(0, 7) t(p)),
    r AS (SELECT ty, tx, p, m, CASE WHEN m >> p = 0 THEN 0.0::DOUBLE ELSE ((m >> p) + 0.5::DOUBLE) * (1 << p) END AS now, CASE WHEN m >> (p + 1) = 0 THEN 0.0::DOUBLE ELSE ((m >> (p + 1)) + 0.5::DOUBLE) * (1 << (p + 1)) END AS before FROM b)
    SELECT ty, tx, CAST(p AS BIGINT) AS plane, sum((m - before) * (m - before) - (m - now) * (m - now))::DOUBLE AS gain FROM r GROUP BY ALL""",
)
def pass_distortion(spark, d):
    """Squared error that each bit plane takes away, magnitudes rebuilt at the middle of their interval."""
    rows = embedding_plane(spark, d).select(*_tile(), F.abs("v").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("p"))

    def rebuilt(p):
        q = F.call_function("shiftright", F.col("m"), p)
        return F.when(q == 0, 0.0).otherwise((q + 0.5) * F.call_function("shiftleft", F.lit(1), p))

    square = lambda c: c * c
    gain = square(F.col("m") - rebuilt(F.col("p") + 1)) - square(F.col("m") - rebuilt(F.col("p")))
    return rows.groupBy("ty", "tx", F.col("p").cast("bigint").alias("plane")).agg(F.sum(gain).alias("gain"))


def _norms() -> str:
    rows = [f"('{k}', {i if k == 'LL' else i + 1}, {n!r})" for k, norms in stats.NORMS_53.items() for i, n in enumerate(norms) if (i if k == "LL" else i + 1) <= 5]
    return f"norms AS (SELECT * FROM (VALUES {', '.join(rows)}) v(kind, level, n))"


@query("band_weights", f"WITH {_norms()} SELECT kind, CAST(level AS BIGINT) AS level, n::DOUBLE * n::DOUBLE AS weight FROM norms WHERE level >= 1")
def band_weights(spark, d):
    rows = spark.createDataFrame([(k, v) for k in ("LL", "HL", "LH", "HH") for v in range(1, 6)], "kind string, level bigint")
    return rows.select("kind", "level", stats.band_weight(F.col("kind"), F.col("level")).alias("weight"))


@query(
    "tag_tree_levels",
    f"""WITH {PLANE}, n AS (SELECT CAST(ceil(log2(greatest(64, max(y) + 1))) AS BIGINT) AS top FROM plane) SELECT CAST(l AS BIGINT) AS level, y >> l AS y, x >> l AS x, min(v) AS v FROM plane, n, range(0, 40) t(l) WHERE l <= top GROUP BY ALL""",
)
def tag_tree_levels(spark, d):
    plane = embedding_plane(spark, d)
    return stats.pyramid(plane, [], int(plane.agg(F.max("y")).first()[0]) + 1, 64)


_SIG = "sg AS (SELECT y, x, CASE WHEN abs(v) >= 16 THEN 1 ELSE 0 END AS s, CASE WHEN v < 0 THEN -1 ELSE 1 END AS sign FROM plane)"
_NB = """r1 AS (SELECT *, lag(s, 1, 0) OVER w + lead(s, 1, 0) OVER w AS h FROM sg WINDOW w AS (PARTITION BY y ORDER BY x)),
nb AS (SELECT *, lag(s, 1, 0) OVER w + lead(s, 1, 0) OVER w AS ve, lag(h, 1, 0) OVER w + lead(h, 1, 0) OVER w AS di FROM r1 WINDOW w AS (PARTITION BY x ORDER BY y))"""


def _zc_sql(h: str, v: str) -> str:
    return f"CASE WHEN {h} = 2 THEN 8 WHEN {h} = 1 AND {v} >= 1 THEN 7 WHEN {h} = 1 AND di >= 1 THEN 6 WHEN {h} = 1 THEN 5 WHEN {v} = 2 THEN 4 WHEN {v} = 1 THEN 3 WHEN di >= 2 THEN 2 ELSE di END"


_ZC_HH = "CASE WHEN di >= 3 THEN 8 WHEN di = 2 AND h + ve >= 1 THEN 7 WHEN di = 2 THEN 6 WHEN di = 1 AND h + ve >= 2 THEN 5 WHEN di = 1 AND h + ve = 1 THEN 4 WHEN di = 1 THEN 3 WHEN h + ve >= 2 THEN 2 ELSE h + ve END"


def _significant(spark, d):
    v = F.col("v")
    return embedding_plane(spark, d).select("y", "x", (F.abs(v) >= 16).cast("int").alias("s"), F.when(v < 0, -1).otherwise(1).alias("sign"))


@query("zero_context_hist", f"WITH {PLANE}, {_SIG}, {_NB}, z AS (SELECT {_zc_sql('h', 've')} AS lh, {_zc_sql('ve', 'h')} AS hl, {_ZC_HH} AS hh FROM nb) SELECT CAST(lh AS BIGINT) AS lh, CAST(hl AS BIGINT) AS hl, CAST(hh AS BIGINT) AS hh, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY ALL")
def zero_context_hist(spark, d):
    around = stats.neighbours(_significant(spark, d), [])
    return around.select(*ints(lh=stats.zero_context("LH"), hl=stats.zero_context("HL"), hh=stats.zero_context("HH"))).groupBy("lh", "hl", "hh").agg(F.count("*").alias("n"))


@query(
    "sign_context_hist",
    f"""WITH {PLANE}, {_SIG}, c1 AS (SELECT *, greatest(-1, least(1, lag(s * sign, 1, 0) OVER w + lead(s * sign, 1, 0) OVER w)) AS hc FROM sg WINDOW w AS (PARTITION BY y ORDER BY x)),
    c2 AS (SELECT *, greatest(-1, least(1, lag(s * sign, 1, 0) OVER w + lead(s * sign, 1, 0) OVER w)) AS vc FROM c1 WINDOW w AS (PARTITION BY x ORDER BY y)),
    k AS (SELECT CASE WHEN (hc, vc) IN ((1, 1), (-1, -1)) THEN 13 WHEN (hc, vc) IN ((1, 0), (-1, 0)) THEN 12 WHEN (hc, vc) IN ((1, -1), (-1, 1)) THEN 11 WHEN hc = 0 AND vc <> 0 THEN 10 ELSE 9 END AS context, CASE WHEN hc < 0 OR (hc = 0 AND vc < 0) THEN 1 ELSE 0 END AS flip FROM c2)
    SELECT CAST(context AS BIGINT) AS context, CAST(flip AS BIGINT) AS flip, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL""",
)
def sign_context_hist(spark, d):
    plane = _significant(spark, d).withColumn("c", F.col("s") * F.col("sign"))

    def contribution(line: str, along: str):
        w = Window.partitionBy(line).orderBy(along)
        return F.greatest(F.lit(-1), F.least(F.lit(1), F.lag("c", 1, 0).over(w) + F.lead("c", 1, 0).over(w)))

    both = plane.withColumn("hc", contribution("y", "x")).withColumn("vc", contribution("x", "y"))
    context, flip = stats.sign_context(F.col("hc"), F.col("vc"))
    return both.select(context.alias("context"), flip.alias("flip")).groupBy("context", "flip").agg(F.count("*").alias("n"))


@query("refinement_context_hist", f"WITH {PLANE}, {_SIG}, {_NB}, m AS (SELECT CASE WHEN y % 2 = 1 THEN 16 WHEN h + ve + di > 0 THEN 15 ELSE 14 END AS context FROM nb) SELECT CAST(context AS BIGINT) AS context, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL")
def refinement_context_hist(spark, d):
    """First refinement without and with neighbours, and later ones (here: odd rows)."""
    around = stats.neighbours(_significant(spark, d), [])
    context = F.when(F.col("y") % 2 == 1, 16).when(F.col("h") + F.col("ve") + F.col("di") > 0, 15).otherwise(14)
    return around.select(*ints(context=context)).groupBy("context").agg(F.count("*").alias("n"))


@query(
    "bitplane_symbols",
    f"""WITH {PLANE}, b AS (SELECT y // 16 AS ty, x // 16 AS tx, abs(v) AS m, p FROM plane, range(0, 7) t(p)) SELECT ty, tx, CAST(p AS BIGINT) AS plane, CAST(count(*) FILTER (m >> (p + 1) = 0) AS BIGINT) AS significance, CAST(count(*) FILTER (m >> p = 1) AS BIGINT) AS signs, CAST(count(*) FILTER (m >> (p + 1) > 0) AS BIGINT) AS refinement FROM b GROUP BY ALL""",
)
def bitplane_symbols(spark, d):
    """Bits that a raw bit-plane coder writes for each plane of a block."""
    rows = embedding_plane(spark, d).select(*_tile(), F.abs("v").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("p"))
    here, above = F.call_function("shiftright", F.col("m"), F.col("p")), F.call_function("shiftright", F.col("m"), F.col("p") + 1)
    return rows.groupBy("ty", "tx", F.col("p").cast("bigint").alias("plane")).agg(F.count_if(above == 0).alias("significance"), F.count_if(here == 1).alias("signs"), F.count_if(above > 0).alias("refinement"))


@query("part_offsets", f"WITH {PASSES} SELECT block_id, pass_index, CAST(cum_bytes - bytes AS BIGINT) AS start, cum_bytes AS \"end\" FROM passes")
def part_offsets(spark, d):
    parts = block_passes(spark, d).select("block_id", "pass_index", "bytes")
    return audits.offsets(parts, ["block_id"], "pass_index", "bytes").select(*ints(block_id="block_id", pass_index="pass_index", start="start", end="end"))


_SPANS = "sp AS (SELECT block_id, pass_index, cum_bytes - bytes + CASE WHEN block_id % 97 = 0 AND pass_index = 3 THEN 1 WHEN block_id % 89 = 0 AND pass_index = 2 THEN -1 ELSE 0 END AS s, cum_bytes AS e FROM passes)"


@query("span_contiguity", f"WITH {PASSES}, {_SPANS}, l AS (SELECT *, lag(e) OVER (PARTITION BY block_id ORDER BY s, e) AS x FROM sp) SELECT block_id, CAST(s AS BIGINT) AS start, CAST(x AS BIGINT) AS expected, CASE WHEN s > x THEN 'gap' ELSE 'overlap' END AS kind FROM l WHERE x IS NOT NULL AND s <> x")
def span_contiguity(spark, d):
    moved = F.when((F.col("block_id") % 97 == 0) & (F.col("pass_index") == 3), 1).when((F.col("block_id") % 89 == 0) & (F.col("pass_index") == 2), -1).otherwise(0)
    spans = block_passes(spark, d).select("block_id", (F.col("cum_bytes") - F.col("bytes") + moved).alias("s"), F.col("cum_bytes").alias("e"))
    return audits.gaps(spans, ["block_id"], "s", "e").select("block_id", *ints(start="s", expected="expected"), "kind")


@query(
    "length_reconciliation",
    f"""WITH {PASSES}, dc AS (SELECT block_id, byte_length + CASE WHEN block_id % 50 = 0 THEN 1 ELSE 0 END AS n FROM blocks WHERE block_id % 70 <> 1), ac AS (SELECT block_id, byte_length AS n FROM blocks WHERE block_id % 60 <> 1)
    SELECT coalesce(d.block_id, a.block_id) AS block_id, CAST(d.n AS BIGINT) AS declared, CAST(a.n AS BIGINT) AS actual, CASE WHEN d.n IS NULL THEN 'undeclared' WHEN a.n IS NULL THEN 'missing' WHEN d.n = a.n THEN 'equal' ELSE 'differs' END AS verdict FROM dc d FULL JOIN ac a ON d.block_id = a.block_id""",
)
def length_reconciliation(spark, d):
    """Declared part lengths against the parts that are there."""
    blocks = block_passes(spark, d).groupBy("block_id").agg(F.max("cum_bytes").alias("n"))
    declared = blocks.where("block_id % 70 <> 1").withColumn("n", F.col("n") + F.when(F.col("block_id") % 50 == 0, 1).otherwise(0))
    return audits.reconciled(declared, blocks.where("block_id % 60 <> 1"), ["block_id"], "n").select("block_id", *ints(declared="declared", actual="actual"), "verdict")


@query("payload_sums", f"WITH {PASSES}, o AS (SELECT o_orderkey AS block_id, CAST(floor(o_totalprice) AS BIGINT) % 200 AS n FROM orders) SELECT o.block_id, n AS declared, CAST(coalesce(byte_length, 0) AS BIGINT) AS payload, coalesce(byte_length, 0) = n AS agrees FROM o LEFT JOIN blocks USING (block_id)")
def payload_sums(spark, d):
    """Packet lengths summed for each part against the part's own length."""
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), (F.floor("o_totalprice") % 200).cast("bigint").alias("declared"))
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("block_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("payload"))
    joined = declared.join(sums, "block_id", "left").withColumn("payload", F.coalesce("payload", F.lit(0)).cast("bigint"))
    return joined.select("block_id", "declared", "payload", (F.col("declared") == F.col("payload")).alias("agrees"))


_MARKERS = """mk AS (SELECT user_id AS k, event_id AS position, CASE event_type WHEN 'view' THEN 'SIZ' WHEN 'click' THEN 'COD' WHEN 'purchase' THEN 'QCD' WHEN 'signup' THEN 'SOC' ELSE 'SOT' END AS marker FROM events)"""


def _markers(spark, d):
    name = F.when(F.col("event_type") == "view", "SIZ").when(F.col("event_type") == "click", "COD").when(F.col("event_type") == "purchase", "QCD").when(F.col("event_type") == "signup", "SOC").otherwise("SOT")
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("position"), name.alias("marker"))


@query(
    "marker_order_audit",
    f"""WITH {_MARKERS}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY position) AS n FROM mk),
    g AS (SELECT k, min(n) FILTER (marker = 'SOC') AS soc, min(n) FILTER (marker = 'SIZ') AS siz, min(n) FILTER (marker = 'SOT') AS sot, max(n) AS last, count(*) FILTER (marker = 'SOC') AS a, count(*) FILTER (marker = 'SIZ') AS b, count(*) FILTER (marker = 'COD') AS c, count(*) FILTER (marker = 'QCD') AS q FROM p GROUP BY k)
    SELECT k, 'SOC is not first' AS fault FROM g WHERE soc IS DISTINCT FROM 1 UNION ALL SELECT k, 'SIZ is not second' FROM g WHERE siz IS DISTINCT FROM 2
    UNION ALL SELECT k, 'SOC does not occur 1 to 1 times' FROM g WHERE a <> 1 UNION ALL SELECT k, 'SIZ does not occur 1 to 1 times' FROM g WHERE b <> 1 UNION ALL SELECT k, 'COD does not occur 1 to 1 times' FROM g WHERE c <> 1
    UNION ALL SELECT k, 'QCD does not occur 1 to 1 times' FROM g WHERE q <> 1 UNION ALL SELECT k, 'markers behind SOT' FROM g WHERE sot < last""",
)
def marker_order_audit(spark, d):
    return audits.header_faults(_markers(spark, d), ["k"])


@query("index_order_audit", f"WITH {PASSES}, ix AS (SELECT block_id, pass_index, pass_index - 1 + CASE WHEN block_id % 31 = 0 AND pass_index > 2 THEN 1 ELSE 0 END AS i FROM passes), l AS (SELECT *, lag(i, 1, -1) OVER (PARTITION BY block_id ORDER BY pass_index) AS b FROM ix) SELECT block_id, pass_index, CAST(i AS BIGINT) AS i FROM l WHERE i <> b + 1")
def index_order_audit(spark, d):
    """Segment indexes count up from 0 without a hole."""
    rows = block_passes(spark, d).select("block_id", "pass_index", (F.col("pass_index") - 1 + F.when((F.col("block_id") % 31 == 0) & (F.col("pass_index") > 2), 1).otherwise(0)).alias("i"))
    return audits.consecutive(rows, ["block_id"], "pass_index", "i").select(*ints(block_id="block_id", pass_index="pass_index", i="i"))


@query("tag_allow_list", "SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL")
def tag_allow_list(spark, d):
    """Tags that are not on the allow-list: an anti-join; a sound file leaves none."""
    allowed = spark.createDataFrame([("view",), ("click",)], "event_type string")
    return audits.unknown(table(spark, d, "events").select("user_id", "event_type"), allowed, ["event_type"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("manifest_duplicates", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def manifest_duplicates(spark, d):
    return audits.duplicates(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), ["l_orderkey", "l_linenumber"])


@query("relation_differences", "WITH a AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 7 <> 0), b AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 11 <> 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def relation_differences(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"))
    return audits.differences(rows.where("k % 7 <> 0"), rows.where("k % 11 <> 0"))


@query("relation_intersection", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 INTERSECT ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT) FROM lineitem WHERE l_orderkey % 11 <> 0")
def relation_intersection(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"))
    return rows.where("k % 7 <> 0").intersectAll(rows.where("k % 11 <> 0"))


@query(
    "header_override",
    """WITH t AS (SELECT t AS tile, c AS component FROM range(0, 8) a(t), range(0, 3) b(c))
    SELECT CAST(tile AS BIGINT) AS tile, CAST(component AS BIGINT) AS component, CAST(coalesce(CASE WHEN tile = 5 AND component = 2 THEN 40 END, CASE WHEN tile IN (3, 5) THEN 30 + tile END, CASE WHEN component = 1 THEN 20 END, 10) AS BIGINT) AS style FROM t""",
)
def header_override(spark, d):
    """Main < main component < tile < tile component."""
    base = spark.range(8).withColumnRenamed("id", "tile").withColumn("component", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    component = spark.createDataFrame([(1, 20)], "component bigint, coc bigint")
    tile = spark.createDataFrame([(3, 33), (5, 35)], "tile bigint, tile_cod bigint")
    both = spark.createDataFrame([(5, 2, 40)], "tile bigint, component bigint, tile_coc bigint")
    joined = base.join(component, "component", "left").join(tile, "tile", "left").join(both, ["tile", "component"], "left")
    return joined.select(*ints(tile="tile", component="component", style=audits.overridden(F.lit(10), F.col("coc"), F.col("tile_cod"), F.col("tile_coc"))))


@query("glob_match", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages WHERE regexp_matches(lower(regexp_extract(url, '[^/]*$')), '^.*7.#t.*$')")
def glob_match(spark, d):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return table(spark, d, "pages").select("page_id", name.alias("name")).where(F.col("name").rlike(audits.glob_to_regex("*7?#T*")))


_NAMES = "nm AS (SELECT 'img' || (page_id % 200) || CASE page_id % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.png' ELSE '.txt' END AS name FROM pages)"


@query("batch_plan", f"WITH {_NAMES}, ch AS (SELECT name AS input, regexp_replace(name, '\\.[^.]*$', '') || '.jp2' AS output FROM nm WHERE regexp_matches(lower(name), '^img.*\\.(tif|png)$')) SELECT input, output, count(*) OVER (PARTITION BY output) > 1 AS collides FROM ch")
def batch_plan(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (".TIF", ".png", ".txt"))), (F.col("page_id") % 3 + 1).cast("int"))
    names = table(spark, d, "pages").select(F.concat(F.lit("img"), (F.col("page_id") % 200).cast("string"), kind).alias("name"))
    return audits.batch_plan(names.where("name not like '%.txt'"), "img*.*", "jp2")


@query(
    "conversion_dispatch",
    f"WITH {_NAMES} SELECT name, CASE WHEN regexp_matches(lower(name), '\\.(tif|png)$') THEN 'raster-to-jp2' END AS command, CAST(count(*) AS BIGINT) AS n FROM nm GROUP BY ALL",
)
def conversion_dispatch(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (".TIF", ".png", ".txt"))), (F.col("page_id") % 3 + 1).cast("int"))
    names = table(spark, d, "pages").select(F.concat(F.lit("img"), (F.col("page_id") % 200).cast("string"), kind).alias("name"))
    return names.select("name", audits.conversion(F.col("name"), F.lit("x.jp2")).alias("command")).groupBy("name", "command").agg(F.count("*").alias("n"))


@query("catalog_totals", f"WITH {PASSES} SELECT CAST(count(*) AS BIGINT) AS blocks, CAST(sum(pass_count) AS BIGINT) AS passes, CAST(sum(byte_length) AS BIGINT) AS bytes, CAST(max(pass_count) AS BIGINT) AS most_passes FROM blocks")
def catalog_totals(spark, d):
    blocks = block_passes(spark, d).groupBy("block_id").agg(F.count("*").alias("n"), F.max("cum_bytes").alias("bytes"))
    return blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("passes"), F.sum("bytes").alias("bytes"), F.max("n").alias("most_passes"))


@query("weighted_distortion", f"WITH {PASSES}, {_norms()}, k AS (SELECT *, ['HL', 'LH', 'HH'][block_id % 3 + 1] AS kind, block_id % 5 + 1 AS level FROM passes) SELECT k.kind, CAST(k.level AS BIGINT) AS level, round(sum(distortion * n::DOUBLE * n::DOUBLE), 2) AS total FROM k JOIN norms ON norms.kind = k.kind AND norms.level = k.level GROUP BY ALL")
def weighted_distortion(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("HL", "LH", "HH"))), (F.col("block_id") % 3 + 1).cast("int"))
    rows = block_passes(spark, d).select(kind.alias("kind"), (F.col("block_id") % 5 + 1).alias("level"), "distortion")
    weighed = rows.withColumn("w", stats.band_weight(F.col("kind"), F.col("level")))
    return weighed.groupBy("kind", "level").agg(F.round(F.sum(F.col("distortion") * F.col("w")), 2).alias("total"))
