"""Reports: nested structs of metrics as JSON, and the summary of a whole run.

Spark's rows are native values, so nothing needs cleaning before it is written.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.operators import calibration, camera, fusion, gpsimu, lidar, sync


def nested(df: DataFrame, keys: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """``keys`` and one struct for each group of columns."""
    return df.select(*keys, *(F.struct(*cols).alias(g) for g, cols in groups.items()))


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, for any number of rows."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def few(df: DataFrame, most: int) -> list:
    """The rows of a small table on the driver; more than ``most`` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_json")
    return rows


def write_summary(df: DataFrame, path: str, most: int = 10_000) -> None:
    """One JSON file on the driver, for summaries (a row a drive); more than ``most`` rows are refused."""
    rows = few(df, most)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str))


def lidar_summary(points: DataFrame, sample_size: int = 5000) -> DataFrame:
    """Sequence metrics with the spatial resolution of sampled points."""
    frames = lidar.frame_metrics(points).join(lidar.spatial_resolution(points, sample_size), ["drive", "frame_idx"], "left")
    return lidar.sequence_metrics(frames)


def run_summary(ts: DataFrame | None = None, points: DataFrame | None = None, packets: DataFrame | None = None, images: DataFrame | None = None, rig=None, reference: str = "lidar") -> dict[str, DataFrame]:
    """The analyses of whatever sources are given, by name; each is lazy."""
    out: dict[str, DataFrame] = {}
    if ts is not None:
        out["timestamps"] = sync.sync_quality(ts, reference)
    if points is not None:
        out["lidar"] = lidar.frame_metrics(points)
        if rig is not None:
            out["fusion"] = fusion.projection_quality(points, rig)
    if packets is not None:
        out["gps_imu"] = gpsimu.sequence_metrics(packets)
    if images is not None:
        out["camera"] = camera.sequence_metrics(camera.frame_metrics(images))
    return out


def digest(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("drive", "frame_idx")) -> DataFrame:
    """(source, metric, n, mean, least, most) of the numbers and flags (as 0 and 1) of each part.

    One aggregate a part gives all its metrics in one row, which is then turned into rows.
    """
    out = None
    for name, df in parts.items():
        kinds = {c: t for c, t in df.dtypes if c not in keys and (t in ("double", "float", "bigint", "int", "boolean") or t.startswith("decimal"))}
        value = {c: F.col(f"`{c}`").cast("int" if t == "boolean" else "double").cast("double") for c, t in kinds.items()}
        one = df.agg(*(F.struct(F.lit(c).alias("metric"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most")).alias(f"m{i}") for i, (c, v) in enumerate(value.items())))
        rows = one.select(F.explode(F.array(*(f"m{i}" for i in range(len(value))))).alias("m")).select(F.lit(name).alias("source"), "m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def text_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A readable listing of a small table; more than ``most`` rows are refused."""
    lines = [title, "=" * len(title)]
    for r in few(df, most):
        lines += [f"{k}: {v}" for k, v in r.asDict(recursive=True).items()] + [""]
    return "\n".join(lines)


def clock_report(ts: DataFrame, reference: str) -> str:
    """The clock analysis of each drive as text: frames, rates, synchronisation, verdicts."""
    out = []
    for r in few(sync.report(ts, reference).orderBy("drive"), 10_000):
        out += [f"Clocks of {r['drive']} (reference: {reference})", "Frames: " + ", ".join(f"{s['sensor']} {s['num_frames']} ({s['missing']} missing)" for s in r["sensors"])]
        out += ["Rates: " + ", ".join(f"{s['sensor']} {s['frame_rate_hz']} Hz, {s['mean_interval_ms']} ms (deviation {s['std_interval_ms']} ms)" for s in r["sensors"])]
        out += ["Offsets: " + ", ".join(f"{s['sensor']} {s['mean_offset_ms']} ms (deviation {s['std_offset_ms']} ms, drift {s['drift_ms']} ms)" for s in r["sensors"] if s["sensor"] != reference)]
        verdict = {"Excellent": "excellent synchronisation (jitter under 2 ms)", "Good": "good synchronisation (jitter under 5 ms)"}.get(r["grade"], "warning: high jitter")
        out += [f"Largest jitter: {r['max_jitter_ms']:.3f} ms", verdict, "no missing frames" if r["complete"] else "warning: missing frames", ""]
    return "\n".join(out)


def calibration_report(calib: DataFrame, camera_id: str = "02") -> str:
    """The calibration of each date as text: camera, LiDAR to camera, IMU to LiDAR."""
    out = []
    for r in few(calibration.summary(calib, camera_id).orderBy("date"), 10_000):
        out += [f"Calibration of {r['date']}", f"Camera {camera_id}: {r['width']} x {r['height']}, focal lengths {r['fx']:.2f}, {r['fy']:.2f}, centre {r['cx']:.2f}, {r['cy']:.2f}"]
        out += [f"LiDAR to camera: shift {r['lidar_to_camera_shift']}, {r['lidar_to_camera_m']:.3f} m"]
        out += [f"IMU to LiDAR: shift {r['imu_to_lidar_shift']}, {r['imu_to_lidar_m']:.3f} m" if r["imu_to_lidar_m"] is not None else "IMU to LiDAR: no file", ""]
    return "\n".join(out)
