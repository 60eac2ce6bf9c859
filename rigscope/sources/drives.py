"""Recorded drives on disk as relations.

Layout: <date>/<drive>/{velodyne_points,oxts,image_0N}/data/%010d.{bin,txt,png}, <sensor>/timestamps.txt, and
<date>/calib_*.txt. Drive, sensor and frame number are parts of the path. A closed-open frame range becomes a
list of files where it names few, so that other files aren't even listed; else a filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.operators.camera import CAMERAS
from rigscope.operators.gpsimu import OPTIONAL, PACKET

LIST_UP_TO = 10_000
# Sensor folders and names.
SENSORS = {"image_00": "gray_left", "image_01": "gray_right", "image_02": "color_left", "image_03": "color_right", "velodyne_points": "lidar", "oxts": "gps_imu"}
CALIBRATION_FILES = ("calib_cam_to_cam.txt", "calib_velo_to_cam.txt", "calib_imu_to_velo.txt")


def frame_file(frame_idx: int, kind: str) -> str:
    return f"{frame_idx:010d}.{kind}"


def _frame_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{10})\.", 1).cast("int")


def _part(path: Column, back: int) -> Column:
    return F.element_at(F.split(path, "/"), -back)


def _paths(drive: str, folder: str, kind: str, start: int, end: int | None) -> list[str]:
    base = f"{drive.rstrip('/')}/{folder}/data"
    if end is not None and 0 < end - start <= LIST_UP_TO:
        return [f"{base}/{frame_file(i, kind)}" for i in range(start, end)]
    return [f"{base}/*.{kind}"]


def _ranged(df: DataFrame, start: int, end: int | None) -> DataFrame:
    out = df.where(F.col("frame_idx") >= start)
    return out if end is None else out.where(F.col("frame_idx") < end)


def lidar(spark: SparkSession, drive: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(drive, frame_idx, point_idx, x, y, z, reflectance) of float32 quadruples. A file of broken length fails."""
    files = spark.read.format("binaryFile").load(_paths(drive, "velodyne_points", "bin", start, end))
    files = _ranged(files.select(_part(F.col("path"), 4).alias("drive"), _frame_of(F.col("path")).alias("frame_idx"), "content"), start, end)

    def decode(batches):
        names = ["drive", "frame_idx", "point_idx", "x", "y", "z", "reflectance"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                if len(raw) % 16:
                    raise ValueError(f"frame {batch.column(1)[i]}: {len(raw)} bytes aren't float32 quadruples")
                p = np.frombuffer(raw, "<f4").reshape(-1, 4)
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.string()), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int32)), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], names=names)

    return files.mapInArrow(decode, "drive string, frame_idx int, point_idx bigint, x float, y float, z float, reflectance float")


def packet_fields(value: Column) -> list[Column]:
    """The named fields of a packet's text; the optional ones are null if absent."""
    tokens = F.filter(F.split(value, r"\s+"), lambda t: t != "")
    out = []
    for name, i in PACKET.items():
        v = (F.try_element_at(tokens, F.lit(i + 1)) if name in OPTIONAL else F.element_at(tokens, i + 1)).cast("double")
        out.append((v.cast("int") if name == "num_sats" else v).alias(name))
    return out


def oxts(spark: SparkSession, drive: str, start: int = 0, end: int | None = None) -> DataFrame:
    """GPS/IMU packets: one file and one line each."""
    text = spark.read.text(_paths(drive, "oxts", "txt", start, end), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return _ranged(text.select(_part(F.col("path"), 4).alias("drive"), _frame_of(F.col("path")).alias("frame_idx"), *packet_fields(F.col("value"))), start, end)


def cameras(spark: SparkSession) -> DataFrame:
    """The four cameras: id, name, kind."""
    return spark.createDataFrame([(k, *v) for k, v in CAMERAS.items()], "camera_id string, name string, kind string")


def images(spark: SparkSession, drive: str, camera_id: str = "image_02", start: int = 0, end: int | None = None) -> DataFrame:
    """(drive, camera_id, frame_idx, height, width, n_channels, data); data in the order of the image source (BGR)."""
    if camera_id not in CAMERAS:
        raise ValueError(f"unknown camera {camera_id}; known: {', '.join(CAMERAS)}")
    rows = spark.read.format("image").load(_paths(drive, camera_id, "png", start, end)).select("image.*")
    return _ranged(rows.select(_part(F.col("origin"), 4).alias("drive"), F.lit(camera_id).alias("camera_id"), _frame_of(F.col("origin")).alias("frame_idx"), "height", "width", F.col("nChannels").alias("n_channels"), "data"), start, end)


def time_ns(raw: Column) -> Column:
    """Nanoseconds since 1970 (UTC) of '2011-09-26 13:02:25.594360375'; null where it isn't a time."""
    second = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(substring(ts_raw, 1, 19) as timestamp_ntz))")
    return second * 1000 + F.coalesce(F.rpad(F.substring(raw, 21, 9), 9, "0").try_cast("bigint"), F.lit(0))


def timestamp_lines(text: DataFrame) -> DataFrame:
    """(drive, sensor, frame_idx, ts_raw, ts_ns) of whole files (drive, sensor, value): line n is frame n.

    One newline at the end is dropped; blank lines stay, with an empty ts_raw and a null time.
    """
    body = F.regexp_replace("value", r"\r?\n\z", "")
    lines = text.select("drive", "sensor", F.posexplode(F.split(body, r"\r?\n")).alias("frame_idx", "line"))
    return lines.select("drive", "sensor", "frame_idx", F.trim("line").alias("ts_raw")).withColumn("ts_ns", time_ns(F.col("ts_raw")))


def timestamps(spark: SparkSession, drive: str) -> DataFrame:
    """All sensors' clocks of a drive (or a glob of drives); sensors without a file are simply absent."""
    text = spark.read.text(f"{drive.rstrip('/')}/*/timestamps.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    names = F.create_map(*(F.lit(x) for kv in SENSORS.items() for x in kv))
    rows = text.select(_part(F.col("path"), 3).alias("drive"), names[_part(F.col("path"), 2)].alias("sensor"), "value").where("sensor is not null")
    return timestamp_lines(rows)


def absent_clocks(spark: SparkSession, drive: str) -> DataFrame:
    """(drive, sensor) of the known sensors without a clock file, for a warning: an anti join."""
    present = timestamps(spark, drive).select("drive", "sensor").distinct()
    known = present.select("drive").distinct().withColumn("sensor", F.explode(F.array(*(F.lit(s) for s in SENSORS.values()))))
    return known.join(present, ["drive", "sensor"], "left_anti")


def drive_names(spark: SparkSession, date: str) -> list[str]:
    """The folders of a date, with and without files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(date)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def missing_files(spark: SparkSession, date: str, names: list[str] | None = None) -> DataFrame:
    """(drive, sensor, file) of what the drives of a date lack: expected against present files, from listings alone.

    ``names``: the drives that should be there (none: the folders that are). Of each known sensor a clock file is expected,
    and data: ``data`` where it has none at all, else each frame up to the drive's last one. A drive that has nothing lacks
    all clocks and all data; a file without a byte counts as absent.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(date).select("path")
    known = F.create_map(*(F.lit(x) for s in SENSORS for x in (s, {"velodyne_points": "bin", "oxts": "txt"}.get(s, "png"))))
    clock = paths.where(_part(F.col("path"), 1) == "timestamps.txt").select(_part(F.col("path"), 3).alias("drive"), _part(F.col("path"), 2).alias("folder"), F.lit("timestamps.txt").alias("file"))
    data = paths.where(_part(F.col("path"), 2) == "data").select(_part(F.col("path"), 4).alias("drive"), _part(F.col("path"), 3).alias("folder"), _part(F.col("path"), 1).alias("name"))
    data = data.where(F.col("name").rlike(r"^\d{10}\.\w+$") & (F.substring_index("name", ".", -1) == known[F.col("folder")]))
    data = data.select("drive", "folder", _frame_of(F.col("name")).alias("frame_idx"), F.concat(F.lit("data/"), "name").alias("file"))
    drives = spark.createDataFrame([(n,) for n in (drive_names(spark, date) if names is None else names)], "drive string")
    wanted = drives.select("drive", F.explode(F.array(*(F.lit(s) for s in SENSORS))).alias("folder"))
    last = data.groupBy("drive").agg(F.max("frame_idx").alias("last"))
    some = data.select("drive", "folder").distinct()
    spans = wanted.join(some, ["drive", "folder"], "left_semi").join(last, "drive").select("drive", "folder", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    frames = spans.select("drive", "folder", F.concat(F.lit("data/"), F.lpad(F.col("i").cast("string"), 10, "0"), F.lit("."), known[F.col("folder")]).alias("file"))
    expected = wanted.withColumn("file", F.lit("timestamps.txt")).unionByName(frames)
    absent = expected.join(clock.unionByName(data.select("drive", "folder", "file")), ["drive", "folder", "file"], "left_anti")
    empty = wanted.join(some, ["drive", "folder"], "left_anti").withColumn("file", F.lit("data"))
    sensor = F.create_map(*(F.lit(x) for kv in SENSORS.items() for x in kv))
    return absent.unionByName(empty).select("drive", sensor[F.col("folder")].alias("sensor"), "file")


def calibration_lines(spark: SparkSession, date: str) -> DataFrame:
    """(date, file, line_no, line) of a date's calibration files, for ``operators.calibration.parsed``."""
    text = spark.read.text(f"{date.rstrip('/')}/calib_*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return text.select(_part(F.col("path"), 2).alias("date"), _part(F.col("path"), 1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
