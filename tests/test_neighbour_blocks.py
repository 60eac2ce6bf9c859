"""All points' nearest neighbours by blocks with halos: what is shuffled, odd coordinates, points that no block can settle."""

import math

import numpy as np
import pytest

from rigscope.operators import lidar

SCHEMA = "drive string, frame_idx int, x double, y double, z double, reflectance double"


def cloud(spark, frames):
    return spark.createDataFrame([("d", f, *(None if v is None else float(v) for v in p), 0.5) for f, c in frames.items() for p in c], SCHEMA)


def squares(c):
    d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


def shuffled(spark):
    """Rows written to shuffles by the stages so far, by stage."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_points_are_not_shuffled_once_for_every_cell_around(spark):
    g = np.random.default_rng(2)
    frames = {f: np.c_[g.uniform(0, 100, (2500, 2)), g.integers(0, 9, 2500) / 2] for f in range(4)}
    df = cloud(spark, frames).cache()
    n, before = df.count(), shuffled(spark)
    got = {r["frame_idx"]: r["spatial_resolution_cm"] for r in lidar.full_resolution(df).collect()}
    rows = sum(v for k, v in shuffled(spark).items() if k not in before)
    df.unpersist()
    assert {f: round(v, 7) for f, v in got.items()} == {f: round(float(np.sqrt(squares(c)).mean()) * 100, 7) for f, c in frames.items()}
    assert n <= rows <= 2 * n, rows  # joins of cells and the 26 around each took over 3 n here


def test_points_without_a_place(spark):
    frames = {
        0: [(0, 0, 0), (3, 4, 0), (None, 1, 1), (None, 1, 1)],
        1: [(0, 0, 0), (None, 0, 0)],
        2: [(0, 0, 0), (1, 0, 0), (math.nan, 0, 0)],
        3: [(0, 0, 0), (1, 0, 0), (math.inf, 0, 0)],
        4: [(math.nan, 0, 0)],
        5: [(None, None, None)] * 2,
        6: [(0, 0, 0), (1e-310, 0, 0)],
    }
    df = cloud(spark, frames)
    got = {r["frame_idx"]: (r["points"], r["spatial_resolution_cm"]) for r in lidar.full_resolution(df).collect()}
    assert math.isnan(got.pop(2)[1])
    assert got == {0: (4, 500.0), 1: (2, None), 3: (3, math.inf), 4: (1, None), 5: (2, None), 6: (2, 0.0)}
    each = sorted((r["frame_idx"], r["copies"]) for r in lidar.neighbour_squares(df).collect())
    assert each == sorted([(0, 1), (0, 1), (0, 2), (1, 1), (1, 1), *[(2, 1)] * 3, *[(3, 1)] * 3, (4, 1), (5, 2), (6, 1), (6, 1)])


@pytest.mark.parametrize("finest", [0.02, 0.3, 1.0])
def test_points_that_lie_farther_than_any_halo(spark, finest):
    g = np.random.default_rng(3)
    c = np.r_[g.normal(0, 1, (3000, 3)), g.uniform(-200, 200, (30, 3)), [[0.0, 5e3, 0.0]]]
    df = cloud(spark, {0: c, 1: c * [1, 1, 0], 2: -c[:50]})
    got = {(r["frame_idx"], r["x"], r["y"], r["z"]): r["d2"] for r in lidar.neighbour_squares(df, finest).collect()}
    for f, points in {0: c, 1: c * [1, 1, 0], 2: -c[:50]}.items():
        for p, d in zip(points, squares(points), strict=True):
            assert got[(f, *(p + 0.0))] == pytest.approx(d, rel=1e-12), (f, p)


@pytest.mark.parametrize("n", [2, 3, 700, 20_000])
def test_sweep_keeps_order(n):
    g = np.random.default_rng(n)
    p = g.uniform(0, 1, (n, 3)) * [1, 0.02, 0.02]
    p[0] = 1e4  # one point that is far from all others
    some = g.choice(n, min(n, 60), replace=False)
    other = ((p[some, None] - p[None]) ** 2).sum(axis=2)
    other[np.arange(len(some)), some] = np.inf
    assert np.allclose(lidar.nearest_squares(p)[some], other.min(axis=1), rtol=1e-12, atol=0)
