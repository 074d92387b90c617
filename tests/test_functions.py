"""Curves, colour limits, audits and allocation against small known cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeforge.functions import color, curves
from planeforge.operators import audits, geometry, rate


def test_profiles():
    data = curves.build_linear_profile(curves.SRGB)
    matrix, found = curves.parse_profile(data)
    assert matrix == pytest.approx(np.array(curves.SRGB), abs=1e-4) and [c.kind for c in found] == ["identity"] * 3
    with pytest.raises(ValueError):
        curves.parse_profile(data[:-1])
    assert curves.invert(curves.SRGB) @ np.array(curves.SRGB) == pytest.approx(np.eye(3))
    with pytest.raises(ValueError):
        curves.invert([[1, 2, 3], [2, 4, 6], [0, 0, 1]])


@pytest.mark.parametrize("depth", [1, 8, 16])
def test_inverse_rct_refuses_what_it_cannot_hold(spark, depth):
    top = color.max_sample(depth)
    rows = spark.createDataFrame([(0, 0, 0), (top, top, top), (top, 0, 0), (0, 0, top)], "r bigint, g bigint, b bigint")
    c = color.rct(F.col("r"), F.col("g"), F.col("b"), depth)
    back = color.inverse_rct(*c, depth)
    assert [tuple(r) for r in rows.select(*back).collect()] == [tuple(r) for r in rows.collect()]
    bad = color.inverse_rct(F.lit(top), F.lit(top), F.lit(top), depth)
    with pytest.raises(Exception, match="out of range"):
        rows.select(*bad).collect()


def test_nan_becomes_zero(spark):
    value = F.lit(float("nan")).cast("float")
    assert spark.range(1).select(color.clamp_float(value, 8)).first()[0] == 0


def test_grid_must_cover_the_image():
    with pytest.raises(ValueError):
        geometry.Grid(5, 0, 10, 10, 4, 4, 0, 0)
    assert geometry.Grid(5, 3, 37, 29, 16, 16, 1, 2).columns == 3


def test_hull():
    points = rate.hull([(1, 10, 100.0), (2, 20, 10.0), (3, 30, 60.0), (4, 30, 5.0), (5, 0, 0.0)][:4])
    assert [p[0] for p in points] == [1, 4]
    assert [p[3] for p in points] == sorted((p[3] for p in points), reverse=True)


def test_layer_targets():
    assert rate.layer_targets(100, [10.0], 3) == [10, 55, 100]
    assert rate.layer_targets(0, [], 2) == [0, 0]
    with pytest.raises(ValueError):
        rate.layer_targets(10, [0.0], 2)


def test_layers_of_empty_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, 0), (2, 5, 50)], "block_id bigint, pass_count bigint, byte_length bigint")
    for frame in (rate.even_layers(blocks, 3, ["block_id"]), rate.ratio_layers(blocks, [4.0], 3, ["block_id"])):
        rows = sorted(tuple(r) for r in frame.collect())
        assert [r for r in rows if r[0] == 1] == [(1, k, 0, 0) for k in range(3)]
        assert rows[-1] == (2, 2, 5, 50)


def test_glob(spark):
    names = spark.createDataFrame([("Img1.TIF",), ("img12.tif",), ("a/img1.tif",), ("xtif",)], "name string")
    found = names.where(F.col("name").rlike(audits.glob_to_regex("img?.t*"))).collect()
    assert [r[0] for r in found] == ["Img1.TIF"]


def test_profile_faults(spark):
    marks = spark.createDataFrame([(1, 1, "SOC"), (1, 2, "SIZ"), (1, 3, "CAP"), (1, 4, "PRF"), (2, 1, "SOC"), (2, 2, "CAP"), (2, 3, "CAP")], "k int, position int, marker string")
    assert sorted(tuple(r) for r in audits.profile_faults(marks, ["k"]).collect()) == [(2, 2, "CAP is not behind SIZ"), (2, 3, "CAP repeats")]
