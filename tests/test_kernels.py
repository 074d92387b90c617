"""Wavelet kernels, the two forms of the transform, and coders: round trips and equivalences."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planeforge.operators import entropy, kernels, lifting, mq, t1, t2
from planeforge.plans import wavelets
from planeforge.rasters import to_blocks, to_samples

SIZES = [1, 2, 3, 5, 8, 17]


@pytest.mark.parametrize("h", SIZES)
@pytest.mark.parametrize("w", [1, 2, 7, 16])
@pytest.mark.parametrize("origin", [(0, 0), (1, 0), (3, 5)])
def test_reversible_round_trip(h, w, origin):
    y, x = np.mgrid[0:h, 0:w]
    plane = x + 3 * y - 7
    for levels in (1, 2, 5):
        coded = kernels.analyse(plane, levels, "5/3", *origin)
        assert (kernels.synthesise(coded, levels, "5/3", *origin) == plane).all()


def test_single_sample_doubles_at_odd_origin():
    assert kernels.forward(np.array([[5]]), "5/3", 1)[0, 0] == 10
    assert kernels.inverse(np.array([[10]]), "5/3", 1)[0, 0] == 5
    assert kernels.forward(np.array([[5]]), "5/3", 0)[0, 0] == 5


def test_irreversible_round_trip_is_close():
    plane = np.random.default_rng(0).integers(-128, 128, (37, 53))
    assert np.abs(kernels.synthesise(kernels.analyse(plane, 4, "9/7", 3, 5), 4, "9/7", 3, 5) - plane).max() < 0.01


def _frame(spark, plane):
    h, w = plane.shape
    return spark.createDataFrame([(y, x, int(plane[y, x])) for y in range(h) for x in range(w)], "y bigint, x bigint, v bigint")


def _array(df, shape, kind=np.int64):
    out = np.zeros(shape, kind)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("kind", ["5/3", "9/7"])
@pytest.mark.parametrize("origin", [(0, 0), (3, 5)])
def test_windows_equal_kernels(spark, kind, origin):
    plane = np.random.default_rng(1).integers(-100, 100, (9, 14))
    long = lifting.forward_level(_frame(spark, plane), [], kind, *origin)
    want = kernels.analyse(plane, 1, kind, *origin)
    got = _array(long, plane.shape, want.dtype)
    assert (got == want).all() if kind == "5/3" else np.allclose(got, want, atol=1e-4)


def test_levels_equal_kernels_for_any_partitioning(spark):
    plane = np.random.default_rng(2).integers(-100, 100, (11, 19))
    for parts in (1, 7):
        frame = _frame(spark, plane).repartition(parts)
        coded = wavelets.forward_levels(frame, 11, 19, 2, [])
        assert (_array(coded, plane.shape) == kernels.analyse(plane, 2)).all()


@pytest.mark.parametrize("kind", ["5/3", "9/7"])
@pytest.mark.parametrize("region", [(5, 3, 12, 11), (0, 0, 1, 1), (20, 15, 24, 20), (0, 0, 24, 20), (13, 0, 14, 20)])
def test_region_decode_equals_crop(spark, region, kind):
    plane = np.random.default_rng(3).integers(-100, 100, (24, 20))
    y0, x0, y1, x1 = region
    coded = kernels.analyse(plane, 2, kind)
    frame = _frame(spark, coded) if kind == "5/3" else spark.createDataFrame([(y, x, float(coded[y, x])) for y in range(24) for x in range(20)], "y long, x long, v float")
    rows = wavelets.decode_region(frame, 24, 20, 2, region, [], kind).collect()
    assert len(rows) == (y1 - y0) * (x1 - x0)
    assert all(abs(plane[r["y"], r["x"]] - r["v"]) <= (0 if kind == "5/3" else 0.01) for r in rows)


def test_region_reads_less_and_shuffles_no_more(spark, tmp_path):
    """The scans get the filters, and a region costs no more exchanges than the whole plane."""
    plane = np.random.default_rng(3).integers(-100, 100, (64, 64))
    _frame(spark, kernels.analyse(plane, 2)).write.parquet(str(tmp_path / "c"))
    coded = spark.read.parquet(str(tmp_path / "c"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    part, whole = plan(wavelets.decode_region(coded, 64, 64, 2, (20, 20, 28, 28), [])), plan(wavelets.inverse_levels(coded, 64, 64, 2, []))
    assert part.count("Exchange") <= whole.count("Exchange") <= 4 and part.count("Join") == 0
    assert part.count("PushedFilters: []") == 0 and part.count("GreaterThanOrEqual(y,") >= 2
    read = [coded.where(f).count() for f in ("y < 64",)][0]
    windows = wavelets.region_windows(20, 20, 28, 28, 64, 64, 2)
    assert sum(4 * (y1 - y0) * (x1 - x0) for y0, x0, y1, x1 in windows) < read / 4


def test_checked_inverse_errs_on_overflow(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, (1 << 31) - 1)], "y long, x long, v long")
    assert lifting.inverse_53(rows, "x", ["y"]).count() == 2
    with pytest.raises(Exception, match="leaves 32 bits"):
        lifting.inverse_53(rows.withColumn("v", F.when(F.col("x") == 0, -(1 << 31)).otherwise((1 << 31) - 1).cast("bigint")), "x", ["y"], checked=True).collect()


def test_block_form_keeps_samples(spark):
    plane = np.random.default_rng(4).integers(0, 9, (10, 13))
    back = to_samples(to_blocks(_frame(spark, plane), 4, 8))
    assert (_array(back, plane.shape) == plane).all()


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_byte_coders_round_trip(data):
    for method in entropy.METHODS:
        assert entropy.decode(*entropy.encode(data, method), len(data)) == data
    method, code = entropy.encode(data)
    assert entropy.decode(method, code, len(data)) == data and len(code) <= max(len(data), 1)


@pytest.mark.parametrize("n", [0, 3, 4, 255, 256, 258, 259, 600])
def test_runs_at_the_limits(n):
    data = b"ab" + b"x" * n + b"cd"
    assert entropy.rle_decode(entropy.rle_encode(data), len(data)) == data


def test_broken_runs_are_refused():
    for code in (b"\x02\x01a", b"\x01\x00a", b"\x00\x05ab", b"\x01\x05a"):
        with pytest.raises(ValueError):
            entropy.rle_decode(code, 3)


@given(st.lists(st.tuples(st.integers(0, 4), st.booleans()), max_size=600), st.booleans())
@settings(max_examples=60, deadline=None)
def test_arithmetic_coder(symbols, predictable):
    contexts = [[0, 0] for _ in range(5)]
    coder = mq.Encoder()
    for c, b in symbols:
        coder.encode(contexts[c], int(b))
    data = coder.finish_predictably() if predictable else coder.finish()
    assert not data.endswith(b"\xff")
    contexts, reader = [[0, 0] for _ in range(5)], mq.Decoder(data)
    assert [reader.decode(contexts[c]) for c, _ in symbols] == [int(b) for _, b in symbols]


@pytest.mark.parametrize("style", [0, 1, 2, 4, 8, 20, 32, 5, 63])
@pytest.mark.parametrize("kind", ["LL", "HL", "LH", "HH"])
def test_block_coder(style, kind):
    rng = np.random.default_rng(style)
    for shape in ((1, 1), (4, 4), (5, 9), (13, 32)):
        for block in (np.zeros(shape, np.int64), rng.integers(-3, 4, shape), (rng.laplace(0, 90, shape) * (rng.random(shape) < 0.5)).astype(np.int64)):
            coded = t1.encode_block(block, kind, style)
            q, _ = t1.decode_block(coded.payload, coded.segments, coded.planes, *shape, kind, style)
            assert (q == block).all()
            assert coded.cum_bytes == sorted(coded.cum_bytes) and (not coded.passes or coded.cum_bytes[-1] == len(coded.payload))


def test_passes_take_the_error_away():
    block = np.random.default_rng(5).laplace(0, 60, (16, 16)).astype(np.int64)
    coded = t1.encode_block(block)
    last = -1.0
    for n in range(1, coded.passes + 1):
        q, low = t1.decode_block(coded.payload, coded.segments, coded.planes, 16, 16, most_passes=n)
        middle = np.where(q == 0, 0.0, np.sign(q) * (np.abs(q) + (1 << low) / 2))
        gone = float((block**2).sum() - ((block - middle) ** 2).sum())
        assert gone == pytest.approx(sum(coded.gains[:n]))
        last = max(last, gone)
    assert last > 0


def test_tag_tree():
    rng = np.random.default_rng(6)
    for w, h in ((1, 1), (3, 2), (5, 7)):
        values = rng.integers(0, 6, w * h).tolist()
        tree, out = t2.TagTree(w, h), t2.HeaderWriter()
        tree.fill(values)
        for bound in range(1, 8):
            for k in range(w * h):
                tree.write(out, k % w, k // w, bound)
        source, other = t2.HeaderReader(out.finish()), t2.TagTree(w, h)
        for bound in range(1, 8):
            for k in range(w * h):
                assert other.read(source, k % w, k // w, bound) == (values[k] < bound)
        assert [other.value(k % w, k // w) for k in range(w * h)] == values


def test_pass_counts():
    out = t2.HeaderWriter()
    for n in range(1, 165):
        t2.write_pass_count(out, n)
    source = t2.HeaderReader(out.finish())
    assert [t2.read_pass_count(source) for _ in range(164)] == list(range(1, 165))


def test_running_sum_has_no_single_task(spark):
    from planeforge.operators.rate import running_sum

    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["t"] for r in running_sum(rows.repartition(3), [F.col("id")], "v", "t").collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[k] == total


def test_jvm_block_coder_is_the_same(spark):
    """Decision for decision: payload, segments, lengths, gains and what is read back, in every style."""
    from planeforge import jvm

    jvm.register(spark)
    rng, rows, want = np.random.default_rng(1), [], {}
    for kind in ("LL", "HL", "LH", "HH"):
        for style in (0, 1, 2, 4, 5, 8, 13, 16, 20, 32, 61, 63):
            for h, w in ((1, 1), (5, 7), (16, 16), (3, 30)):
                block = rng.laplace(0, rng.choice([0, 3, 60, 2000]), (h, w)).astype(np.int64)
                want[len(rows)] = block, t1.encode_block(block, kind, style)
                rows.append((len(rows), bytearray(block.astype("<i4").tobytes()), h, w, kind, style))
    blocks = spark.createDataFrame(rows, "k int, samples binary, h int, w int, kind string, style int")
    coded = blocks.select("k", "h", "w", "kind", "style", jvm.encode_block(*map(F.col, ("samples", "h", "w", "kind", "style"))).alias("c")).select("*", "c.*")
    back = coded.withColumn("d", jvm.decode_block(*map(F.col, ("payload", "segments", "planes", "h", "w", "kind", "style"))))
    for r in back.collect():
        block, one = want[r["k"]]
        assert (r["planes"], r["passes"], bytes(r["payload"])) == (one.planes, one.passes, one.payload)
        assert [tuple(x) for x in np.frombuffer(r["segments"], "<i4").reshape(-1, 2).tolist()] == one.segments
        assert np.frombuffer(r["cum_bytes"], "<i4").tolist() == one.cum_bytes and np.allclose(np.frombuffer(r["gains"], "<f8"), one.gains)
        q, low = t1.decode_block(one.payload, one.segments, one.planes, *block.shape, r["kind"], r["style"])
        assert np.array_equal(np.frombuffer(r["d"]["q"], "<i4").reshape(block.shape), block) and np.array_equal(q, block)
        assert np.array_equal(np.frombuffer(r["d"]["low"], np.uint8).reshape(block.shape) * (block != 0), low * (block != 0))


def test_jvm_byte_coders_are_the_same(spark):
    """Code for code as the numpy coders, by each method and by the container's choice."""
    rng, rows = np.random.default_rng(3), [b"", b"a", b"aaa", b"aaaa", bytes(300), b"\xff" * 64 + b"\0" * 900, bytes(range(256)) * 3]
    rows += [b"x" * n + b"yz" * m for n in (3, 4, 254, 255, 256, 258, 259, 510, 514) for m in (0, 1, 127, 128, 300)]
    rows += [rng.choice([0, 1, 128, 255, 7], n, p=[0.5, 0.2, 0.05, 0.2, 0.05]).astype(np.uint8).tobytes() for n in (15, 16, 64, 65, 1000)]
    data = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(rows)], "k int, data binary")
    for method in (None, *entropy.METHODS):
        coded = entropy.encode_column(data, "k", "data", method)
        back = {r["k"]: bytes(r["data"]) for r in entropy.decode_column(coded, "k").collect()}
        for r in coded.collect():
            assert (r["method"], bytes(r["code"])) == entropy.encode(rows[r["k"]], method) and r["raw_len"] == len(rows[r["k"]])
            assert back[r["k"]] == rows[r["k"]]


def test_jvm_byte_coders_refuse_broken_runs(spark):
    from planeforge import jvm

    jvm.register(spark)
    broken = [("rle", b"\x02\x03a", 3), ("rle", b"\x80\x03abc", 3), ("rle", b"\x01\x00a", 3), ("rle", b"\x00\x03ab", 3), ("rle", b"\x01\x04a", 3), ("rle", b"\x01", 3), ("bit_rle", b"\x80", 0), ("bit_rle", b"\x09", 1), ("bit_rle", b"\x07", 1), ("raw", b"ab", 3), ("other", b"", 0)]
    for method, code, size in broken:
        rows = spark.createDataFrame([(method, bytearray(code), size)], "method string, code binary, raw_len long")
        with pytest.raises(Exception, match="bad run|wrong length|method other"):
            rows.select(jvm.entropy_decode(*map(F.col, ("method", "code", "raw_len")))).collect()


@pytest.mark.parametrize("method", [None, "bit_rle"])
def test_byte_coders_hold_no_batches(spark, method):
    """A batch of texts has a code of several times its size, so no step may gather one."""
    texts = spark.createDataFrame([(1, bytearray(b"text"))], "k int, data binary")
    plan = entropy.decode_column(entropy.encode_column(texts, "k", "data", method), "k")._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
