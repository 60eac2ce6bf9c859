"""Registered queries over all rows, against brute force; SQL covers their bounded forms."""

import json
import os

import numpy as np
import pytest

from rigscope import adapters as ad
from rigscope import queries
from rigscope.functions import kernels as kn

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def clouds(spark):
    """Points of each frame."""
    out = {}
    for r in ad.lidar_points(spark, SF).collect():
        out.setdefault((r["drive"], r["frame_idx"]), []).append((r["x"], r["y"], r["z"]))
    return {k: np.array(v) for k, v in out.items()}


def test_lidar_uses_every_point(spark):
    want, per = {}, {}
    for k, p in clouds(spark).items():
        near = [np.sort(((p - q) ** 2).sum(axis=1))[1] for q in p]
        want[k] = (len(p), np.sqrt(near).mean() * 100)
        per.setdefault(k[0], []).append(want[k][1])
    got = {(r["drive"], r["frame_idx"]): (r["sampled"], r["spatial_resolution_cm"]) for r in queries.QUERIES["lidar_spatial_resolution_full"](spark, SF).collect()}
    assert got.keys() == want.keys() and min(n for n, _ in got.values()) > 200
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-4)) for k in want)
    cvs = {r["drive"]: r["resolution_cv"] for r in queries.QUERIES["lidar_sequence_full"](spark, SF).collect()}
    assert cvs == {d: pytest.approx(100 * np.std(v) / np.mean(v), abs=1e-4) for d, v in per.items()}
    assert queries.QUERIES["lidar_point_sample_full"](spark, SF).count() == sum(n for n, _ in want.values())


def test_camera_sequence_counts_keypoints(spark):
    counts = []
    for r in ad.tiled_images(spark, SF).collect():
        counts.append(len(kn.orb(np.array(r["values"], np.uint8).reshape(r["height"], r["width"]))))
    got = queries.QUERIES["cam_sequence_full"](spark, SF).first()
    assert got["num_frames"] == len(counts) and sum(counts) > 0
    assert got["orb_avg"] == pytest.approx(np.mean(counts), abs=1e-4) and got["orb_dev"] == pytest.approx(np.std(counts), abs=1e-4)


def test_missing_files_of_every_rig(spark):
    rigs = {str(r["s_suppkey"]): r["s_nationkey"] for r in ad.table(spark, SF, "supplier").collect()}
    got = {(r["date"], r["file"]) for r in queries.QUERIES["calib_missing_full"](spark, SF).collect()}
    assert got == {(d, "calib_imu.txt") for d in rigs} and any(int(d) % 2 for d in rigs)
    got = {(r["date"], r["file"]) for r in queries.QUERIES["calib_missing"](spark, SF).collect()}
    assert got == {(d, "calib_imu_to_velo.txt") for d, n in rigs.items() if n % 2}


def test_motion_of_every_user(spark):
    plan = queries.QUERIES["fusion_motion_join"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "user_id" in plan and "drive#" in plan and " IN (0,1,2)" not in plan


def test_summary_holds_the_metrics(spark):
    got = {}
    for r in queries.QUERIES["run_summary_full"](spark, SF).collect():
        got.setdefault(r["source"], []).append(json.loads(r["report"]))
    assert got.keys() == {"timestamps", "lidar", "fusion", "gps_imu", "camera"}
    for source, query in (("lidar", "lidar_frame_metrics"), ("timestamps", "ts_jitter_grade"), ("camera", "cam_sequence")):
        want = [r.asDict(recursive=True) for r in queries.QUERIES[query](spark, SF).collect()]
        key = lambda x: (x["drive"], x.get("frame_idx", 0))
        assert sorted(got[source], key=key) == sorted(want, key=key)
    assert all("depth_p75" in x for x in got["fusion"]) and all("total_distance_m" in x for x in got["gps_imu"])
