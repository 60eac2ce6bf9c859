import numpy as np
import pytest

from rigscope.operators import calibration, fusion
from rigscope.plans import report

EYE = calibration.Rig(r=(1, 0, 0, 0, 1, 0, 0, 0, 1), t=(0, 0, 0), r_rect=(1, 0, 0, 0, 1, 0, 0, 0, 1), p_rect=(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), width=10, height=375)


def points(spark, rows, frame=0):
    return spark.createDataFrame([("d", frame, *map(float, r)) for r in rows], "drive string, frame_idx int, x double, y double, z double")


def test_identity_and_bounds(spark):
    p = points(spark, [(1, 2, 1), (4, 6, 2), (0, 0, 0), (10, 1, 1), (1, 375, 1), (-1, 1, 1), (9.5, 374.5, 1)])
    got = sorted((r["u"], r["v"], r["depth"]) for r in fusion.projected(p, EYE, (10, 375)).collect())
    assert got == [(1, 2, 1), (2, 3, 2), (9.5, 374.5, 1)]
    assert fusion.projected(p, EYE).count() == 6  # z = 0 isn't in front


def test_against_numpy(spark):
    g = np.random.default_rng(3)
    r, t, rr, pp = g.normal(size=9), g.normal(size=3), g.normal(size=9), g.normal(size=12)
    rig = calibration.Rig(tuple(r), tuple(t), tuple(rr), tuple(pp), 10, 10)
    a = g.normal(size=(50, 3))
    rect = rr.reshape(3, 3) @ (r.reshape(3, 3) @ a.T + t[:, None])
    h = pp.reshape(3, 4) @ np.r_[rect, np.ones((1, 50))]
    want = sorted((h[0] / h[2])[rect[2] > 0])
    assert sorted(x["u"] for x in fusion.projected(points(spark, a), rig).collect()) == pytest.approx(want)


def test_bands_and_box_edges(spark):
    assert list(fusion.band_edges(375).values()) == [(0, 123), (123, 251), (251, 375)]
    p = points(spark, [(1, 123, 1), (1, 122.9, 1), (1, 251, 1)])
    q = fusion.projection_quality(p, EYE).first()
    assert (q["top_sky_count"], q["middle_objects_count"], q["bottom_road_count"]) == (1, 1, 1)
    assert fusion.region_frames(p, EYE, (1, 123, 1, 251)).first()["point_count"] == 2


def test_empty_frames_survive(spark):
    p = points(spark, [(1, 1, -1)]).unionByName(points(spark, [(1, 1, 1)], 1))
    q = {r["frame_idx"]: r for r in fusion.projection_quality(p, EYE).collect()}
    assert q[0]["points_in_image"] == 0 and q[0]["depth_mean"] is None and q[0]["horizontal_coverage"] == 0 and q[0]["image_rate"] == 0 and not q[0]["balanced_depth_distribution"]
    regions = fusion.region_frames(p, EYE, (0, 0, 9, 9))
    r = fusion.region_temporal(regions).first()
    assert r["num_frames"] == 2 and r["count_mean"] == 0.5 and r["depth_mean"] == 1 and r["depth_cv"] == 0 and not r["always_visible"] and r["stable_depth"]


def test_tables_of_rigs_and_boxes(spark):
    g = np.random.default_rng(4)
    rows, cams = [], []
    for d in ("a", "b"):
        r, t, rr, pp = g.normal(size=9), g.normal(size=3), g.normal(size=9), g.normal(size=12)
        cams.append((d, r.tolist(), t.tolist(), rr.tolist(), pp.tolist(), 3, 3))
        rows += [(d, "d", 0, *map(float, x)) for x in g.normal(size=(200, 3))]
    points_ = spark.createDataFrame(rows, "date string, drive string, frame_idx int, x double, y double, z double")
    table = spark.createDataFrame(cams, "date string, r array<double>, t array<double>, r_rect array<double>, p_rect array<double>, width int, height int")
    got = sorted(x["u"] for x in fusion.projected_by_date(points_, table).collect())
    want = []
    for d, r, t, rr, pp, w, h in cams:
        rig = calibration.Rig(tuple(r), tuple(t), tuple(rr), tuple(pp), w, h)
        want += [x["u"] for x in fusion.projected(points_.where(f"date = '{d}'"), rig, (w, h)).collect()]
    assert got and got == pytest.approx(sorted(want))
    proj = spark.createDataFrame([("d", 0, float(u), float(v), 1.0) for u in range(0, 300, 7) for v in range(0, 200, 7)], "drive string, frame_idx int, u double, v double, depth double")
    boxes = [("all", 0.0, 0.0, 300.0, 200.0), ("edge", 63.0, 63.0, 70.0, 70.0), ("line", 7.0, 0.0, 7.0, 200.0), ("none", 1.0, 1.0, 2.0, 2.0), ("endless", -1e300, -1e300, 1e300, 1e300)]
    found = {r["region"]: r["point_count"] for r in fusion.in_regions(proj, spark.createDataFrame(boxes, "region string, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert found == {"all": 43 * 29, "edge": 4, "line": 29, "endless": 43 * 29}


def test_image_of_the_same_frame(spark):
    p = points(spark, [(4, 1, 1), (12, 1, 1)]).unionByName(points(spark, [(4, 1, 1)], 1)).unionByName(points(spark, [(4, 1, 1)], 2))
    sizes = spark.createDataFrame([("d", "image_02", 0, 10, 20), ("d", "image_02", 1, 0, 0)], "drive string, camera_id string, frame_idx int, height int, width int")
    assert sorted(r["u"] for r in fusion.projected_onto_images(p, sizes, EYE).collect()) == [4, 12]


def test_overlay_by_frame(spark):
    p = points(spark, [(1, 1, 1), (3, 3, 3), (5, 5, 5)])
    assert sorted(r["shade"] for r in fusion.overlay(fusion.projected(p, EYE), None).collect()) == [0, 0.5, 1]


def test_three_files(spark):
    files = {"calib_cam_to_cam.txt": ["K_02: 1 0 0 0 2 0 0 0 3", "D_02: 1 2 3 4 5", "P_rect_02: 1 2 3 4 5 6 7 8 9 10 11 12", "R_rect_02: 1 0 0 0 1 0 0 0 1", "S_rect_02: 10 20"], "calib_velo_to_cam.txt": ["R: 0 1 0 1 0 0 0 0 1", "T: 0 3 4"], "calib_imu_to_velo.txt": ["R: 9 9 9 9 9 9 9 9 9", "T: 8 8 8"]}
    rows = [(d, f, i, v) for d in ("x", "y") for f, lines in files.items() for i, v in enumerate(lines) if d == "x" or "imu" not in f]
    c = calibration.parsed(spark.createDataFrame(rows, "date string, file string, line_no int, line string"))
    m = {r["date"]: r for r in calibration.camera(c).collect()}
    assert m["x"]["r"] == m["y"]["r"] == [0, 1, 0, 1, 0, 0, 0, 0, 1] and m["x"]["t"] == [0, 3, 4]
    t = {r["date"]: r["transforms"] for r in calibration.transforms(c).collect()}
    assert t["x"]["imu_to_lidar"]["matrix"][0] == [9, 9, 9, 8] and t["y"]["imu_to_lidar"] is None and t["x"]["camera"]["k"][1] == [0, 2, 0]
    assert t["x"]["lidar_to_camera"]["matrix"][1] == [1, 0, 0, 3]
    assert [r["date"] for r in calibration.imu_to_lidar(c).collect()] == ["x"]
    text = report.calibration_report(c)
    assert "Calibration of x" in text and "no file" in text and "5.000 m" in text


def test_motion_is_optional(spark):
    regions = spark.createDataFrame([("d", 0, 1), ("d", 1, 2)], "drive string, frame_idx int, point_count bigint")
    motion = spark.createDataFrame([("d", 0, 36.0, 5.0)], "drive string, frame_idx int, speed_kmh double, yaw_deg double")
    assert sorted((r["frame_idx"], r["speed_kmh"]) for r in fusion.with_motion(regions, motion).collect()) == [(0, 36.0), (1, None)]


def test_parse(spark):
    lines = ["calib_time: 09-Jan-2012 13:57:47", "R: 1 0 0 0 1 0 0 0 1", "T: 3 4 0", "T: 0 3 4", "P_rect_02: 1 2 3 4 5 6 7 8 9 10 11 12", "R_rect_02: 1 0 0 0 1 0 0 0 1", "S_rect_02: 1.242000e+03 375", "empty:", "no mark"]
    c = calibration.parsed(spark.createDataFrame([("day", "f", i, v) for i, v in enumerate(lines)], "date string, file string, line_no int, line string"))
    rows = {r["key"]: r for r in c.collect()}
    assert len(rows) == 7 and rows["calib_time"]["text"] == "09-Jan-2012 13:57:47" and rows["calib_time"]["nums"] is None
    assert rows["T"]["nums"] == [0, 3, 4] and rows["empty"]["nums"] == [] and rows["empty"]["text"] is None
    m = calibration.camera(c).first()
    assert (m["fx"], m["fy"], m["cx"], m["cy"], m["width"], m["height"], m["t_norm"]) == (1, 6, 3, 7, 1242, 375, 5)
    assert m["t_4x4"][1] == [0, 1, 0, 3] and m["t_4x4"][3] == [0, 0, 0, 1]
    assert calibration.transforms(c).first()["transforms"]["camera"]["p_rect"][1] == [5, 6, 7, 8]
    assert calibration.rig(c, "day").width == 1242
    with pytest.raises(ValueError):
        calibration.rig(c, "other")


def test_nearest_points_are_drawn(spark):
    rows = [("d", 0, 1.2, 0.9, 10.0), ("d", 0, 1.9, 0.1, 5.0), ("d", 0, 3.0, 2.0, 60.0), ("d", 1, 0.0, 0.0, 25.0), ("d", 1, 9.0, 0.0, 1.0)]
    z = fusion.z_buffer(spark.createDataFrame(rows, "drive string, frame_idx int, u double, v double, depth double"))
    assert sorted(tuple(r)[1:] for r in z.collect()) == [(0, 1, 0, 5.0, 2), (0, 3, 2, 60.0, 1), (1, 0, 0, 25.0, 1), (1, 9, 0, 1.0, 1)]
    images = {r["frame_idx"]: fusion.png_values(r["png"]) for r in fusion.rendered(z, 4, 3).collect()}
    assert images[0].tolist() == [[0, 230, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]] and images[1].tolist() == [[128, 0, 0, 0], [0] * 4, [0] * 4]


def test_images_are_png(spark, tmp_path):
    gray = np.random.default_rng(0).integers(0, 256, (5, 7)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(fusion.png_bytes(gray))
    row = spark.read.format("image").load(str(tmp_path)).first()["image"]
    assert (row["height"], row["width"]) == (5, 7) and bytes(row["data"]) == gray.tobytes() and (fusion.png_values(fusion.png_bytes(gray)) == gray).all()
