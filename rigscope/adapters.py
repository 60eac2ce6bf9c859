"""Sensor relations from the benchmark tables, which stand in for recorded drives.

All counts of frames, drives and images grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.session import spread_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def lidar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive, frame_idx, point_key, x, y, z, reflectance): a frame of 1000 orders; point_key is a hash-like order key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("drive_"), F.expr("(l_orderkey div 1000) % 3").cast("string")).alias("drive"),
        F.expr("l_orderkey div 1000").cast("int").alias("frame_idx"),
        F.expr("pmod((l_orderkey * 31 + l_linenumber) * 1000003 + l_partkey * 7919 + l_suppkey * 104729 + cast(round(l_extendedprice * 100) as bigint), 4294967291)").alias("point_key"),
        ((F.col("l_quantity") - 25.5) * 2).alias("x"),
        ((F.col("l_extendedprice") - 53000) / 1000).alias("y"),
        ((F.col("l_tax") - 0.04) * 50).alias("z"),
        (F.col("l_discount") * 10).alias("reflectance"),
    )


def sensor_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive, sensor, frame_idx, ts_raw, ts_ns): a drive of ten users; frames in order of time."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy(F.expr("user_id div 10"), "event_type").orderBy("ts", "event_id")
    return e.select(
        F.expr("user_id div 10").cast("string").alias("drive"),
        F.col("event_type").alias("sensor"),
        (F.row_number().over(w) - 1).cast("int").alias("frame_idx"),
        F.col("ts").cast("string").alias("ts_raw"),
        (micros("ts") * 1000).alias("ts_ns"),
    )


def oxts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS/IMU packets of one drive per user."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    v = F.col("value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("drive"),
        (F.row_number().over(w) - 1).cast("int").alias("frame_idx"),
        (micros("ts") / 1e6).alias("timestamp"),
        (F.lit(49.0) + F.col("event_id") * 1e-6).alias("lat"),
        (F.lit(8.4) + v * 1e-6).alias("lon"),
        (v / 10 + 100).alias("alt"),
        (k * 1e-3).alias("roll"),
        (k * -1e-3).alias("pitch"),
        F.radians(k * 3.6 - 180).alias("yaw"),
        (v / 10).alias("vn"),
        (k / 10).alias("ve"),
        (v / 10).alias("vf"),
        (k / 10).alias("vl"),
        F.lit(0.1).alias("vu"),
        ((v - 50) / 20).alias("ax"),
        ((k - 50) / 20).alias("ay"),
        F.lit(9.8).alias("az"),
        ((v - 50) / 20).alias("af"),
        ((k - 50) / 20).alias("al"),
        F.lit(9.8).alias("au"),
        (k / 1000).alias("wx"),
        F.lit(None).cast("double").alias("wy"),
        F.lit(None).cast("double").alias("wz"),
        (k / 50).alias("pos_accuracy"),
        F.lit(None).cast("double").alias("vel_accuracy"),
        F.expr("cast(event_id % 12 as int)").alias("num_sats"),
    )


def luminance_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive, frame_idx, height, width, lum): each vector as an 8 x 8 luminance image, row by row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("cam_"), F.col("label").cast("string")).alias("drive"),
        F.col("vec_id").cast("int").alias("frame_idx"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round((v + 1) * 127.5)).alias("lum"),
    )


def tiled_images(spark: SparkSession, sf_dir: str, side: int = 4) -> DataFrame:
    """(drive, camera_id, frame_idx, height, width, n_channels, values): side x side vectors as one gray image.

    Of an image with fewer vectors than that, the vectors take turns.
    """
    n = side * side
    tiles = luminance_images(spark, sf_dir).select(F.expr(f"frame_idx div {n}").alias("frame_idx"), F.expr(f"frame_idx % {n}").alias("tile"), "lum")
    some = spread_by(tiles, "frame_idx").groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct("tile", "lum"))).alias("some"))
    size = 8 * side
    at = F.expr(
        f"transform(sequence(0, {size * size - 1}), i -> least(255, greatest(0, cast(some[cast(((i div {size}) div 8 * {side} + (i % {size}) div 8) % size(some) as int)].lum[cast((i div {size}) % 8 * 8 + i % 8 as int)] as int))))"
    )
    return some.select(F.lit("cam").alias("drive"), F.lit("image_00").alias("camera_id"), F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(size).alias("height"), F.lit(size).alias("width"), F.lit(1).alias("n_channels"), at.alias("values"))


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``tiled_images``, with red, green and blue: the gray values, and those a third and two thirds of the image on."""
    n = 32 * 32
    rgb = F.expr(f"flatten(transform(sequence(0, {n - 1}), i -> array(values[i], values[(i + {n // 3}) % {n}], values[(i + {2 * n // 3}) % {n}])))")
    return tiled_images(spark, sf_dir).withColumns({"camera_id": F.lit("image_02"), "n_channels": F.lit(3), "values": rgb})


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive, frame_idx, value): thirty numbers of a vector as the text of a GPS/IMU packet."""
    e = table(spark, sf_dir, "embeddings")
    numbers = F.transform(F.slice("embedding", 1, 30), lambda v: F.round(v.cast("double") * 1000).cast("int").cast("string"))
    return e.select(F.lit("packets").alias("drive"), F.col("vec_id").cast("int").alias("frame_idx"), F.concat(F.array_join(numbers, " "), F.lit("\n")).alias("value"))


def calibration_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, file, line_no, line): each supplier as a rig with rotation, shift, intrinsics and a text entry."""
    s = table(spark, sf_dir, "supplier")
    k = F.expr("cast(s_suppkey % 7 as double)")
    num = lambda c: c.cast("double").cast("string")
    lines = F.array(
        F.concat(F.lit("calib_time: 09-Jan-2012 13:57:"), F.expr("lpad(cast(s_suppkey % 60 as string), 2, '0')")),
        F.lit("R: 0 -1 0 0 0 -1 1 0 0"),
        F.concat(F.lit("T: "), num(k / 8), F.lit(" -0.08 -0.27")),
        F.concat(F.lit("P_rect_02: "), num(k + 720.5), F.lit(" 0 609.5593 44.85728 0 "), num(k + 720.5), F.lit(" 172.854 0.2163791 0 0 1 0.002745884")),
        F.lit("R_rect_02: 1 0 0 0 1 0 0 0 1"),
        F.lit("S_rect_02: 1242 375"),
        F.lit("empty:"),
        F.lit("a line without the mark"),
    )
    return s.select(F.col("s_suppkey").cast("string").alias("date"), F.lit("calib.txt").alias("file"), F.posexplode(lines).alias("line_no", "line"))


def calibration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``calibration_lines``, with each rig's entries in the three usual files; rigs of odd nations lack the IMU's."""
    s = table(spark, sf_dir, "supplier")
    k = F.expr("cast(s_suppkey % 7 as double)")
    num = lambda c: c.cast("double").cast("string")
    camera = F.array(
        F.concat(F.lit("K_02: "), num(k + 700.5), F.lit(" 0 600.5 0 "), num(k + 701.5), F.lit(" 170.25 0 0 1")),
        F.lit("D_02: -0.375 0.25 0.0625 -0.125 -0.5"),
        F.concat(F.lit("P_rect_02: "), num(k + 720.5), F.lit(" 0 609.5593 44.85728 0 "), num(k + 720.5), F.lit(" 172.854 0.2163791 0 0 1 0.002745884")),
        F.lit("R_rect_02: 1 0 0 0 1 0 0 0 1"),
        F.lit("S_rect_02: 1242 375"),
    )
    velo = F.array(F.lit("R: 0 -1 0 0 0 -1 1 0 0"), F.concat(F.lit("T: "), num(k / 8), F.lit(" -0.08 -0.27")))
    imu = F.array(F.lit("R: 1 0 0 0 1 0 0 0 1"), F.concat(F.lit("T: -0.8125 "), num(k / 4), F.lit(" -0.75")))
    files = F.array(
        F.struct(F.lit("calib_cam_to_cam.txt").alias("file"), camera.alias("lines")),
        F.struct(F.lit("calib_velo_to_cam.txt").alias("file"), velo.alias("lines")),
        F.struct(F.lit("calib_imu_to_velo.txt").alias("file"), imu.alias("lines")),
    )
    rows = s.select(F.col("s_suppkey").cast("string").alias("date"), "s_nationkey", F.explode(files).alias("f")).where("f.file <> 'calib_imu_to_velo.txt' or s_nationkey % 2 = 0")
    return rows.select("date", "f.file", F.posexplode("f.lines").alias("line_no", "line"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drive, camera_id, frame_idx, height, width): each vector as the size of an image; every tenth one is empty."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("concat('drive_', vec_id % 3)").alias("drive"),
        F.lit("image_02").alias("camera_id"),
        F.col("vec_id").cast("int").alias("frame_idx"),
        F.lit(375).alias("height"),
        F.expr("if(vec_id % 10 = 7, 0, cast(1000 + label * 50 as int))").alias("width"),
    )
