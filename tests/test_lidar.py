import numpy as np
import pytest

from rigscope.operators import lidar


def points(spark, rows, frame=0):
    return spark.createDataFrame([("d", frame, i, *map(float, r)) for i, r in enumerate(rows)], "drive string, frame_idx int, point_key bigint, x double, y double, z double, reflectance double")


def test_histogram_closed_last_bin(spark):
    r = lidar.aggregate(points(spark, [(d, 0, 0, 1) for d in (0, 10, 50, 100, 100.1)]), lidar.range_distribution()).first()
    assert [r[c] for c in r.asDict() if c.startswith("bin")] == [1, 1, 0, 0, 0, 2]


def test_sector_boundary_counts_twice(spark):
    a = np.radians(-157.5)
    rows = [(np.cos(a), np.sin(a), 0, 1), (-1, -0.0, 0, 1), (1, 0, 0, 1)]
    p = points(spark, rows)
    g = lidar.with_geometry(p).select("azimuth").collect()
    r = lidar.aggregate(p, lidar.azimuth_coverage()).first()
    if g[0]["azimuth"] == -157.5:
        assert r["sector_rear_right"] == 1 and r["sector_rear"] == 2
    assert r["sector_front"] == 1 and r["sector_rear"] >= 1


def test_against_numpy(spark):
    g = np.random.default_rng(0)
    a = np.c_[g.normal(0, 20, (500, 3)), g.integers(0, 3, 500)]
    r = lidar.frame_metrics(points(spark, a)).first()
    d = np.linalg.norm(a[:, :3], axis=1)
    for name, want in {"range_mean": d.mean(), "range_std": d.std(), "range_median": np.median(d), "range_p25": np.percentile(d, 25), "x_std": a[:, 0].std(), "sensor_height": abs(a[:, 2].min()), "mean_point_density": 500 / (d.mean() * 7), "zero_reflectance_pct": 100 * (a[:, 3] == 0).mean()}.items():
        assert r[name] == pytest.approx(want)
    assert sum(r[f"sector_{s}"] for s in lidar.SECTORS) == 500
    assert not r["sufficient_points"] and r["good_reflectance"]


def test_nearest_neighbours(spark):
    g = np.random.default_rng(1)
    a = np.c_[g.normal(0, 5, (700, 3)), np.ones(700)]
    r = lidar.spatial_resolution(points(spark, a)).first()
    d = np.sqrt(((a[:, None, :3] - a[None, :, :3]) ** 2).sum(2)) + np.diag(np.full(700, np.inf))
    assert r["spatial_resolution_cm"] == pytest.approx(d.min(1).mean() * 100)
    assert lidar.spatial_resolution(points(spark, a[:1])).first()["spatial_resolution_cm"] is None
    assert lidar.spatial_resolution(points(spark, a), 50).first()["sampled"] == 50


def test_sequence_and_repartitioning(spark):
    a = points(spark, [(1, 0, 0, 1), (2, 0, 0, 1)]).unionByName(points(spark, [(3, 0, 0, 1)] * 4, 1))
    one = lidar.sequence_metrics(lidar.frame_metrics(a).join(lidar.spatial_resolution(a), ["drive", "frame_idx"])).collect()
    assert one == lidar.sequence_metrics(lidar.frame_metrics(a.repartition(7)).join(lidar.spatial_resolution(a), ["drive", "frame_idx"])).collect()
    assert one[0]["points_mean"] == 3 and one[0]["points_std"] == 1 and one[0]["num_frames"] == 2


def test_one_shuffle_no_python(spark):
    plan = lidar.frame_metrics(points(spark, [(1, 0, 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_named_and_seeded_frames(spark):
    assert lidar.seeded_frames(108) == sorted(np.random.RandomState(42).choice(108, 5, replace=False).tolist()) and len(lidar.seeded_frames(3)) == 3
    p = points(spark, [(1, 0, 0, 1)]).unionByName(points(spark, [(1, 0, 0, 1)], 4))
    assert lidar.picked_frames(p, [4, 9]).count() == 1
    assert {r["frame_idx"] for r in lidar.frame_sample(p, 1).collect()} <= {0, 4} and lidar.frame_sample(p, 1).count() == 1
    with pytest.raises(ValueError, match="reflectance"):
        lidar.frame_metrics(p.drop("reflectance"))
