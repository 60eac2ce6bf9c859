import numpy as np
import pytest
from pyspark.sql import functions as F

from rigscope.functions import stats
from rigscope.operators import lidar


def clouds():
    g = np.random.default_rng(0)
    dense = np.r_[g.normal(0, 0.01, (150, 3)), g.uniform(-50, 50, (40, 3)), [[400.0, 0, 0]]]
    line = np.c_[np.arange(60.0) ** 2, np.zeros((60, 2))]
    out = {0: g.normal(0, 5, (200, 3)), 1: dense, 2: line, 3: np.zeros((5, 3)), 4: np.ones((1, 3)), 5: np.repeat(g.normal(size=(20, 3)), [1, 2] * 10, axis=0), 6: np.array([[0.0, 0, 0], [1e9, 0, 0]])}
    return {k: v.astype(float) for k, v in out.items()}


@pytest.mark.parametrize("finest,widen", [(0.25, 4.0), (1.0, 2.0), (1000.0, 4.0)])
def test_nearest_of_all_points(spark, finest, widen):
    frames = clouds()
    df = spark.createDataFrame([("d", f, *map(float, p), 0.5) for f, c in frames.items() for p in c], "drive string, frame_idx int, x double, y double, z double, reflectance double")
    got = {(r["frame_idx"], r["x"], r["y"], r["z"]): (r["copies"], r["d2"]) for r in lidar.neighbour_squares(df, finest, widen).collect()}
    for f, c in frames.items():
        square = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        np.fill_diagonal(square, np.inf)
        for p, d in zip(c, square.min(axis=1), strict=True):
            copies, d2 = got[(f, *p)]
            assert copies == (c == p).all(axis=1).sum() and (d2 is None if len(c) == 1 else abs(d2 - d) <= 1e-12 * max(d, 1e-9)), (f, p)


def test_full_resolution_has_no_frame_in_one_task(spark):
    df = spark.createDataFrame([("d", 0, float(i), 0.0, 0.0, 0.5) for i in range(50)], "drive string, frame_idx int, x double, y double, z double, reflectance double")
    out = lidar.full_resolution(df)
    assert [tuple(r)[2:] for r in out.collect()] == [(50, 100.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("small,bins", [(10_000, 1024), (3, 4), (1, 2)])
def test_selected_percentiles(spark, small, bins):
    g = np.random.default_rng(1)
    groups = {"a": g.normal(size=301), "b": np.r_[np.zeros(50), 1e300, -1e300, g.uniform(size=20)], "c": np.array([3.5]), "d": np.r_[np.full(40, 2.0), np.full(40, 2.0 + 1e-15), 7.0], "e": np.arange(10.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("e", None), ("f", None), ("e", float("nan"))]
    q = {"low": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.873, "top": 1.0}
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: [r[n] for n in q] for r in stats.selected(df, ["g"], F.col("x"), q, small, bins).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, list(q.values())), rtol=1e-12, atol=1e-15), k
