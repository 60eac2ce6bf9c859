import json
import struct
import zlib

import numpy as np
import pytest

from rigscope.operators import calibration, gpsimu
from rigscope.plans import report
from rigscope.sources import drives


def png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def drive(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw") / "2011_09_26"
    d = base / "drive_0001"
    g = np.random.default_rng(0)
    clouds = [g.normal(size=(n, 4)).astype("<f4") for n in (5, 7, 3)]
    for i, c in enumerate(clouds):
        for folder, kind, data in (("velodyne_points", "bin", c.tobytes()), ("oxts", "txt", (" ".join(str(i + k / 10) for k in range(30)) + "\n").encode()), ("image_02", "png", png(np.full((4, 6, 3), (10, 20, 30 + i), np.uint8))), ("image_00", "png", png(np.full((4, 6), 7 + i, np.uint8)))):
            p = d / folder / "data" / drives.frame_file(i, kind)
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(data)
    for s in ("velodyne_points", "oxts"):
        (d / s / "timestamps.txt").write_text("2011-09-26 13:02:25.594360375\n2011-09-26 13:02:25.694360375\n")
    for f in drives.CALIBRATION_FILES[:2]:
        (base / f).write_text("calib_time: 09-Jan-2012 13:57:47\nT: 1 2 3\n")
    return base, d, clouds


def test_lidar(spark, drive):
    _, d, clouds = drive
    rows = drives.lidar(spark, str(d)).orderBy("frame_idx", "point_idx").collect()
    assert np.array_equal(np.array([[r["x"], r["y"], r["z"], r["reflectance"]] for r in rows], "f4"), np.concatenate(clouds))
    assert rows[0]["drive"] == "drive_0001"
    part = drives.lidar(spark, str(d), 1, 2)
    assert part.count() == 7 and {r["frame_idx"] for r in part.collect()} == {1}
    assert drives.lidar(spark, str(d), 1).count() == 10
    with pytest.raises(Exception, match="(?i)path"):
        drives.lidar(spark, str(d), 7, 8).count()


def test_broken_cloud(spark, tmp_path):
    p = tmp_path / "x" / "velodyne_points" / "data"
    p.mkdir(parents=True)
    (p / drives.frame_file(0, "bin")).write_bytes(b"123")
    with pytest.raises(Exception, match="quadruples"):
        drives.lidar(spark, str(tmp_path / "x")).count()


def test_oxts(spark, drive):
    _, d, _ = drive
    r = drives.oxts(spark, str(d), 1, 2).first()
    assert (r["lat"], r["wz"], r["pos_accuracy"], r["vel_accuracy"], r["num_sats"]) == (1, 2.9, 3.3, 3.4, 3)
    assert gpsimu.frame_metrics(drives.oxts(spark, str(d)).selectExpr("*", "frame_idx * 0.1 as timestamp")).count() == 3


def test_images(spark, drive):
    _, d, _ = drive
    r = drives.images(spark, str(d), "image_02", 2, 3).first()
    assert (r["height"], r["width"], r["n_channels"]) == (4, 6, 3) and list(r["data"][:3]) == [32, 20, 10]
    assert drives.images(spark, str(d), "image_00").first()["n_channels"] == 1
    with pytest.raises(ValueError):
        drives.images(spark, str(d), "image_09")
    assert drives.cameras(spark).count() == 4


def test_clocks_and_calibration(spark, drive):
    base, d, _ = drive
    ts = drives.timestamps(spark, str(d))
    assert {r["sensor"] for r in ts.collect()} == {"lidar", "gps_imu"} and ts.count() == 4
    assert {r["sensor"] for r in drives.absent_clocks(spark, str(d)).collect()} == {"gray_left", "gray_right", "color_left", "color_right"}
    text = report.clock_report(ts, "lidar")
    assert "reference: lidar" in text and "Largest jitter" in text and "Hz" in text
    lines = drives.calibration_lines(spark, str(base))
    c = calibration.parsed(lines)
    assert c.where("key = 'T'").count() == 2
    assert [r["file"] for r in calibration.missing_files(lines, drives.CALIBRATION_FILES).collect()] == [drives.CALIBRATION_FILES[2]]


def test_missing_files_of_many_drives(spark, tmp_path):
    for drive, sensors in {"full": drives.SENSORS, "part": ("velodyne_points", "oxts"), "none": ()}.items():
        (tmp_path / drive).mkdir()
        for s in sensors:
            for i in range(3):
                p = tmp_path / drive / s / "data" / drives.frame_file(i, {"velodyne_points": "bin", "oxts": "txt"}.get(s, "png"))
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(b"x")
            (tmp_path / drive / s / "timestamps.txt").write_text("t")
    (tmp_path / "part" / "velodyne_points" / "data" / drives.frame_file(1, "bin")).unlink()
    (tmp_path / "part" / "oxts" / "timestamps.txt").write_text("")
    (tmp_path / "part" / "oxts" / "data" / "notes.txt").write_text("no frame")
    (tmp_path / "calib_cam_to_cam.txt").write_text("")
    got = sorted(map(tuple, drives.missing_files(spark, str(tmp_path)).collect()))
    cameras = [s for s in drives.SENSORS.values() if s.startswith(("gray", "color"))]
    want = [("none", s, f) for s in drives.SENSORS.values() for f in ("data", "timestamps.txt")] + [("part", s, f) for s in cameras for f in ("data", "timestamps.txt")]
    assert got == sorted([*want, ("part", "lidar", "data/0000000001.bin"), ("part", "gps_imu", "timestamps.txt")])
    assert drives.missing_files(spark, str(tmp_path), ["full", "lost"]).count() == 12


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 2.0, None)], "drive string, a int, b double, c string")
    n = report.nested(df, ["drive"], {"m": ["a", "b"], "rest": ["c"]})
    report.write_summary(n, str(tmp_path / "out" / "s.json"))
    assert json.loads((tmp_path / "out" / "s.json").read_text()) == [{"drive": "d", "m": {"a": 1, "b": 2.0}, "rest": {"c": None}}]
    report.write_json(n, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).first()["m"]["b"] == 2
    assert "drive: d" in report.text_report(df, "Report")
    with pytest.raises(ValueError):
        report.write_summary(spark.range(5), str(tmp_path / "t.json"), most=4)


def test_whole_drive(spark, drive, tmp_path):
    from rigscope.plans.drive import analyse

    base, d, _ = drive
    (base / drives.CALIBRATION_FILES[0]).write_text("P_rect_02: 700 0 3 0 0 700 2 0 0 0 1 0\nR_rect_02: 1 0 0 0 1 0 0 0 1\nS_rect_02: 1242 375\n")
    (base / drives.CALIBRATION_FILES[1]).write_text("R: 0 -1 0 0 0 -1 1 0 0\nT: 0 -0.08 -0.27\n")
    done = analyse(spark, str(base), d.name, str(tmp_path), fusion_frames=(0, 2, 50))
    assert len(done) == 10
    read = {k: json.loads(open(p).read()) for k, p in done.items()}
    assert read["lidar_sequence_analysis"][0]["num_frames"] == 3 and read["camera_sequence_analysis"][0]["num_frames"] == 3
    assert read["gps_imu_analysis"][0]["num_frames"] == 3 and read["timestamp_analysis"][0]["sensors"][1]["sensor"] == "lidar"
    assert {r["frame_idx"] for r in read["fusion_analysis"]} == {0, 2} and read["calibration"][0]["transforms"]["camera"]["image_size"] == {"width": 1242, "height": 375}
    assert read["analysis_summary"][0]["lidar_frames"] == 3
