"""Calibration files as a relation (date, file, key, nums, text), and the transforms in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# The file whose R and T lead from the IMU to the LiDAR; other files' lead from the LiDAR to the camera.
IMU_FILE = "calib_imu_to_velo.txt"


def parsed(lines: DataFrame, value: str = "line", order: str = "line_no") -> DataFrame:
    """(date, file, key, nums, text) of lines ``key: value``; the value is numbers if all its tokens are, else text.

    Lines without a colon are left out; of a repeated key the last line counts; an empty value is an empty array.
    """
    v = F.col(value)
    at = F.instr(v, ":")
    body = F.trim(F.expr(f"substring(`{value}`, instr(`{value}`, ':') + 1)"), F.lit(" \t\r\n"))
    tokens = F.filter(F.split(body, r"\s+"), lambda t: t != "")
    nums = F.transform(tokens, lambda t: t.try_cast("double"))
    numeric = F.forall(nums, lambda n: n.isNotNull())
    key = F.trim(F.substring_index(v, ":", 1), F.lit(" \t\r\n"))
    last = F.row_number().over(W.partitionBy("date", "file", key).orderBy(F.col(order).desc()))
    rows = lines.where(at > 0).select(
        "date",
        "file",
        key.alias("key"),
        F.when(numeric, nums).alias("nums"),
        F.when(~numeric, body).alias("text"),
        last.alias("_nth"),
    )
    return rows.where("_nth = 1").drop("_nth")


def missing_files(present: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(date, file) of expected files that are absent: an anti join."""
    want = present.select("date").distinct().withColumn("file", F.explode(F.array(*(F.lit(f) for f in expected))))
    return want.join(present.select("date", "file").distinct(), ["date", "file"], "left_anti")


def matrix(nums: Column, columns: int) -> Column:
    """Row-major numbers as an array of rows; null without numbers."""
    return F.when(F.size(nums) > 0, F.transform(F.sequence(F.lit(1), F.size(nums), F.lit(columns)), lambda i: F.slice(nums, i, columns)))


def homogeneous(r: Column, t: Column) -> Column:
    """The 4 x 4 matrix of a rotation (9 numbers) and a shift (3 numbers)."""
    rows = [F.concat(F.slice(r, 3 * i + 1, 3), F.slice(t, i + 1, 1)) for i in range(3)]
    return F.array(*rows, F.array(*(F.lit(float(x)) for x in (0, 0, 0, 1))))


def norm(t: Column) -> Column:
    return F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, x: s + x * x))


def camera(calib: DataFrame, camera_id: str = "02") -> DataFrame:
    """One row a date: rotation, shift, rectification and projection of a camera, image size, focal lengths, centre.

    R and T are those of the LiDAR, never of the IMU's file.
    """
    names = {"R": "r", "T": "t", f"R_rect_{camera_id}": "r_rect", f"P_rect_{camera_id}": "p_rect", f"S_rect_{camera_id}": "s_rect", f"K_{camera_id}": "k", f"D_{camera_id}": "d"}
    rows = calib.where(F.col("key").isin(*names) & (~F.col("key").isin("R", "T") | (F.col("file") != IMU_FILE)))
    wide = rows.groupBy("date").agg(*(F.max(F.when(F.col("key") == k, F.col("nums"))).alias(v) for k, v in names.items()))
    p = F.col("p_rect")
    return wide.withColumns(
        {
            "fx": F.try_element_at(p, F.lit(1)),
            "fy": F.try_element_at(p, F.lit(6)),
            "cx": F.try_element_at(p, F.lit(3)),
            "cy": F.try_element_at(p, F.lit(7)),
            "width": F.try_element_at(F.col("s_rect"), F.lit(1)).cast("int"),
            "height": F.try_element_at(F.col("s_rect"), F.lit(2)).cast("int"),
            "t_norm": norm(F.col("t")),
            "t_4x4": homogeneous(F.col("r"), F.col("t")),
        }
    )


def imu_to_lidar(calib: DataFrame) -> DataFrame:
    """One row a date that has the IMU's file: imu_r, imu_t, imu_4x4 and the length of the shift."""
    rows = calib.where((F.col("file") == IMU_FILE) & F.col("key").isin("R", "T"))
    wide = rows.groupBy("date").agg(*(F.max(F.when(F.col("key") == k, F.col("nums"))).alias(v) for k, v in (("R", "imu_r"), ("T", "imu_t"))))
    return wide.withColumns({"imu_4x4": homogeneous(F.col("imu_r"), F.col("imu_t")), "imu_t_norm": norm(F.col("imu_t"))})


def transforms(calib: DataFrame, camera_id: str = "02") -> DataFrame:
    """(date, transforms): a struct of structs with all matrices as rows, for export; imu_to_lidar is null without its file."""
    c = camera(calib, camera_id).join(imu_to_lidar(calib), "date", "left")
    return c.select(
        "date",
        F.struct(
            F.struct(matrix(F.col("r"), 3).alias("rotation"), F.col("t").alias("shift"), F.col("t_4x4").alias("matrix")).alias("lidar_to_camera"),
            F.when(F.col("imu_r").isNotNull(), F.struct(matrix(F.col("imu_r"), 3).alias("rotation"), F.col("imu_t").alias("shift"), F.col("imu_4x4").alias("matrix"))).alias("imu_to_lidar"),
            F.struct(matrix(F.col("p_rect"), 4).alias("p_rect"), matrix(F.col("r_rect"), 3).alias("r_rect"), matrix(F.col("k"), 3).alias("k"), F.col("d"), F.struct("width", "height").alias("image_size")).alias("camera"),
        ).alias("transforms"),
    )


def summary(calib: DataFrame, camera_id: str = "02") -> DataFrame:
    """One row a date: image size, focal lengths, centre, and both shifts with their lengths in metres."""
    c = camera(calib, camera_id).join(imu_to_lidar(calib), "date", "left")
    return c.select("date", "width", "height", "fx", "fy", "cx", "cy", F.col("t").alias("lidar_to_camera_shift"), F.col("t_norm").alias("lidar_to_camera_m"), F.col("imu_t").alias("imu_to_lidar_shift"), F.col("imu_t_norm").alias("imu_to_lidar_m"))


@dataclass(frozen=True)
class Rig:
    """One rig's matrices on the driver, to become literals of a plan."""

    r: tuple[float, ...]
    t: tuple[float, ...]
    r_rect: tuple[float, ...]
    p_rect: tuple[float, ...]
    width: int
    height: int


def rig(calib: DataFrame, date: str, camera_id: str = "02") -> Rig:
    """The rig of one date; a calibration is a few dozen numbers."""
    row = camera(calib.where(F.col("date") == date), camera_id).first()
    if row is None:
        raise ValueError(f"no calibration for {date}")
    return Rig(tuple(row["r"]), tuple(row["t"]), tuple(row["r_rect"]), tuple(row["p_rect"]), row["width"], row["height"])
