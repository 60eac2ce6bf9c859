"""Registered queries: every operator over the relations of ``adapters``, doubles rounded to ``DIGITS``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope import adapters as ad
from rigscope.functions.stats import rounded, selected, spread
from rigscope.operators import calibration, camera, fusion, gpsimu, lidar, sync, tiles
from rigscope.plans import report
from rigscope.session import fresh_path, share_code
from rigscope.sources import drives, files

DIGITS = 5
#: Added before rounding, so that exact halves go the same way in every engine.
NUDGE = 1e-9
FRAME = ["drive", "frame_idx"]
REFERENCE, FIRST_SENSOR = "view", "click"
BOX = (400.0, 100.0, 800.0, 300.0)
#: An illustrative rig: forward camera of 1242 x 375 pixels.
RIG = calibration.Rig(
    r=(0, -1, 0, 0, 0, -1, 1, 0, 0),
    t=(0, -0.08, -0.27),
    r_rect=(1, 0, 0, 0, 1, 0, 0, 0, 1),
    p_rect=(721.5377, 0, 609.5593, 44.85728, 0, 721.5377, 172.854, 0.2163791, 0, 0, 1, 0.002745884),
    width=1242,
    height=375,
)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(share_code(spark), sf_dir), DIGITS, NUDGE)

    QUERIES[f.__name__] = run
    return f


def _lidar(*metrics: Callable[[], list]) -> Query:
    return lambda spark, d: lidar.aggregate(ad.lidar_points(spark, d), *(m() for m in metrics))


for _name, _metrics in {
    "lidar_range_stats": [lidar.range_stats],
    "lidar_coord_stats": [lidar.coordinate_stats],
    "lidar_azimuth": [lidar.azimuth_coverage],
    "lidar_range_hist": [lidar.range_distribution],
    "lidar_reflectance": [lidar.reflectance_stats],
    "lidar_fov": [lidar.field_of_view],
    "lidar_density": [lidar.density],
}.items():
    _f = _lidar(*_metrics)
    _f.__name__ = _name
    query(_f)


@query
def lidar_flags(spark, d):
    flags = ["sufficient_points", "full_horizontal_coverage", "good_vertical_coverage", "reasonable_range", "good_reflectance"]
    return lidar.frame_flags(lidar.aggregate(ad.lidar_points(spark, d), lidar.density(), lidar.range_stats(), lidar.reflectance_stats(), lidar.field_of_view())).select(*FRAME, *flags)


@query
def lidar_frame_metrics(spark, d):
    return lidar.frame_metrics(ad.lidar_points(spark, d))


@query
def lidar_spatial_resolution(spark, d):
    return lidar.spatial_resolution(ad.lidar_points(spark, d))


@query
def lidar_spatial_resolution_full(spark, d):
    """The same with a sample of twice the size."""
    return lidar.spatial_resolution(ad.lidar_points(spark, d), sample_size=10_000)


@query
def lidar_sequence(spark, d):
    p = ad.lidar_points(spark, d)
    frames = lidar.aggregate(p, lidar.density(), lidar.range_stats(), lidar.field_of_view())
    return lidar.sequence_metrics(frames.join(lidar.spatial_resolution(p), FRAME, "left"))


@query
def lidar_sequence_full(spark, d):
    return report.lidar_summary(ad.lidar_points(spark, d))


@query
def lidar_all_neighbours(spark, d):
    """Every point of every frame, by blocks with halos."""
    return lidar.full_resolution(ad.lidar_points(spark, d))


@query
def lidar_percentiles(spark, d):
    p = lidar.with_geometry(ad.lidar_points(spark, d))
    ranks = {"range_p05": 0.05, "range_p25": 0.25, "range_median": 0.5, "range_p75": 0.75, "range_p95": 0.95}
    return selected(p, FRAME, F.col("dist"), ranks)


@query
def lidar_files(spark, d):
    """Frames written as files and read back by two ranges of frames: what the files of each frame hold."""
    path, middle = fresh_path(spark, "clouds"), 10
    files.write_clouds(ad.lidar_points(spark, d), path, "point_key")
    rows = files.read_clouds(spark, path, end=middle).unionByName(files.read_clouds(spark, path, start=middle))
    held = [F.count(F.lit(1)).alias("num_points"), (F.max("point_idx") + 1).alias("indexed")]
    return rows.groupBy(*FRAME).agg(*held, *(c for axis in ("x", "y", "z", "reflectance") for c in spread(F.col(axis).cast("double"), axis, "min", "max", "mean")))


@query
def lidar_json_reports(spark, d):
    """The sequence report of each drive as a JSON file, read back."""
    path, rows = fresh_path(spark, "reports"), lidar_sequence(spark, d)
    files.write_reports(rows, path)
    return files.read_reports(spark, path, rows.schema)


@query
def lidar_frame_sample(spark, d):
    return lidar.frame_sample(ad.lidar_points(spark, d), 5).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("num_points"))


@query
def lidar_point_sample(spark, d):
    return lidar.sample_points(ad.lidar_points(spark, d), 15_000).select(*FRAME, "point_key", "x", "y", "z", "reflectance", "sample_rank")


@query
def lidar_point_sample_full(spark, d):
    """The sample of the sequence's plot."""
    return lidar.sample_points(ad.lidar_points(spark, d), 5_000).select(*FRAME, "point_key", "x", "y", "z", "reflectance", "sample_rank")


@query
def lidar_sector_plot(spark, d):
    return lidar.sector_plot(lidar.aggregate(ad.lidar_points(spark, d), lidar.density(), lidar.azimuth_coverage()))


@query
def ts_elapsed(spark, d):
    return sync.intervals(ad.sensor_ts(spark, d)).select("drive", "sensor", "frame_idx", "elapsed_s")


@query
def ts_intervals(spark, d):
    return sync.intervals(ad.sensor_ts(spark, d)).select("drive", "sensor", "frame_idx", "interval_s")


@query
def ts_block_intervals(spark, d):
    """Times since the first frame and the frame before, by blocks of 64 frames with edges carried between them."""
    return sync.intervals_in_blocks(ad.sensor_ts(spark, d), block=64).select("drive", "sensor", "frame_idx", "elapsed_s", "interval_s")


@query
def drive_missing_files(spark, d):
    """Frames written as files, and what a whole drive would have beside them."""
    path = fresh_path(spark, "drives")
    files.write_clouds(ad.lidar_points(spark, d), path, "point_key")
    return drives.missing_files(spark, path)


@query
def ts_aligned(spark, d):
    return sync.aligned(ad.sensor_ts(spark, d)).groupBy("drive", "frame_idx").agg(F.count(F.lit(1)).alias("sensors"), F.count("ts_ns").alias("present"))


@query
def ts_completeness(spark, d):
    return sync.completeness(ad.sensor_ts(spark, d))


@query
def ts_frame_rates(spark, d):
    return sync.frame_rates(ad.sensor_ts(spark, d))


@query
def ts_offsets(spark, d):
    return sync.offsets(ad.sensor_ts(spark, d), REFERENCE)


@query
def ts_offset_stats(spark, d):
    return sync.offset_stats(ad.sensor_ts(spark, d), REFERENCE)


@query
def ts_jitter_grade(spark, d):
    return sync.sync_quality(ad.sensor_ts(spark, d), REFERENCE)


@query
def ts_summary(spark, d):
    return sync.summary(ad.sensor_ts(spark, d), REFERENCE, FIRST_SENSOR, nudge=1e-6)


@query
def ts_parse(spark, d):
    """Clock lines with nanoseconds: each user's event times as the text of one file."""
    e = ad.table(spark, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    files = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    return drives.timestamp_lines(files.select(F.col("user_id").cast("string").alias("drive"), F.lit("lidar").alias("sensor"), F.concat("value", F.lit("\n")).alias("value")))


@query
def oxts_parse(spark, d):
    return ad.packet_lines(spark, d).select(*FRAME, *drives.packet_fields(F.col("value")))


@query
def oxts_enu(spark, d):
    return gpsimu.local_enu(ad.oxts(spark, d)).select(*FRAME, "east", "north", "up")


@query
def oxts_frame(spark, d):
    return gpsimu.frame_metrics(ad.oxts(spark, d)).select(*FRAME, "latitude", "longitude", "altitude", "speed_2d_ms", "speed_3d_ms", "speed_kmh", "roll_deg", "pitch_deg", "yaw_deg", "num_sats")


def _sequences(spark, d, *columns: str) -> DataFrame:
    return gpsimu.sequence_metrics(ad.oxts(spark, d)).select("drive", *columns)


@query
def oxts_trajectory(spark, d):
    return _sequences(spark, d, "num_frames", "duration_sec", "total_distance_m", "max_displacement_m", "altitude_change_m")


@query
def oxts_speed(spark, d):
    return _sequences(spark, d, "speed_ms_min", "speed_ms_max", "speed_ms_mean", "speed_ms_std", "speed_kmh_min", "speed_kmh_max", "speed_kmh_mean")


@query
def oxts_orientation(spark, d):
    return _sequences(spark, d, *(f"{a}_{k}" for a in ("roll", "pitch", "yaw") for k in ("min", "max", "range")), "heading_change_deg")


@query
def oxts_accel(spark, d):
    return _sequences(spark, d, *(f"{a}_{k}" for a in ("ax", "ay", "az") for k in ("min", "max", "mean", "std")))


@query
def oxts_position_range(spark, d):
    return _sequences(spark, d, *(f"{a}_{k}" for a in ("latitude", "longitude", "altitude") for k in ("min", "max")))


@query
def oxts_flags(spark, d):
    flags = ["has_significant_motion", "has_turns", "has_stops", "has_high_speed", "altitude_variation", "reasonable_speeds", "reasonable_accelerations", "smooth_trajectory"]
    return gpsimu.verdict(gpsimu.sequence_metrics(ad.oxts(spark, d))).select("drive", *flags, "verdict")


@query
def oxts_series(spark, d):
    return gpsimu.series(gpsimu.frame_metrics(ad.oxts(spark, d))).select(*FRAME, "east", "north", "speed_kmh", "mean_speed_kmh", "altitude", "altitude_range", "yaw_deg")


@query
def ts_report(spark, d):
    """The nested report, flattened again."""
    one = sync.report(ad.sensor_ts(spark, d), REFERENCE).select("drive", "grade", F.explode("sensors").alias("s"))
    return one.select("drive", "grade", "s.sensor", "s.num_frames", "s.missing")


@query
def calib_parse(spark, d):
    c = calibration.parsed(ad.calibration_lines(spark, d))
    return c.select("date", "key", F.array_join(F.transform("nums", lambda x: F.round(x, 4).cast("decimal(20,4)").cast("string")), " ").alias("nums"), "text")


@query
def calib_matrices(spark, d):
    c = calibration.camera(calibration.parsed(ad.calibration_lines(spark, d)))
    flat = F.flatten(F.col("t_4x4"))
    return c.select("date", "fx", "fy", "cx", "cy", "width", "height", "t_norm", *(flat[i].alias(f"m{i}") for i in (0, 3, 5, 7, 8, 11, 15)))


@query
def calib_missing(spark, d):
    return calibration.missing_files(ad.calibration_files(spark, d).select("date", "file"), drives.CALIBRATION_FILES)


@query
def calib_missing_full(spark, d):
    """Of one-file rigs, each lacks the other."""
    return calibration.missing_files(ad.calibration_lines(spark, d).select("date", "file"), ("calib.txt", "calib_imu.txt"))


@query
def calib_imu(spark, d):
    c = calibration.imu_to_lidar(calibration.parsed(ad.calibration_files(spark, d)))
    flat = F.flatten(F.col("imu_4x4"))
    return c.select("date", "imu_t_norm", *(flat[i].alias(f"m{i}") for i in (0, 3, 5, 7, 10, 11, 15)))


@query
def calib_transforms(spark, d):
    t = calibration.transforms(calibration.parsed(ad.calibration_files(spark, d))).select("date", "transforms.*")
    at = lambda name, i, j, to: F.col(name)[i][j].alias(to)
    return t.select(
        "date",
        at("lidar_to_camera.matrix", 0, 3, "lidar_x"),
        at("lidar_to_camera.matrix", 0, 1, "lidar_r01"),
        at("imu_to_lidar.matrix", 0, 3, "imu_x"),
        at("imu_to_lidar.matrix", 1, 3, "imu_y"),
        at("imu_to_lidar.rotation", 0, 0, "imu_r00"),
        at("camera.k", 1, 1, "k11"),
        F.col("camera.d")[4].alias("d4"),
        at("camera.p_rect", 0, 0, "p00"),
        "camera.image_size.width",
        "camera.image_size.height",
    )


@query
def calib_summary(spark, d):
    c = calibration.summary(calibration.parsed(ad.calibration_files(spark, d)))
    return c.select("date", "width", "height", "fx", "fy", "cx", "cy", "lidar_to_camera_m", "imu_to_lidar_m")


def _projected(spark, d) -> DataFrame:
    return fusion.projected(ad.lidar_points(spark, d), RIG, (RIG.width, RIG.height))


@query
def proj_points(spark, d):
    return _projected(spark, d).select(*FRAME, "point_key", "u", "v", "depth")


@query
def proj_by_date(spark, d):
    points = ad.lidar_points(spark, d).withColumn("date", (F.col("point_key") % 10).cast("string"))
    cams = calibration.camera(calibration.parsed(ad.calibration_lines(spark, d)))
    return fusion.projected_by_date(points, cams).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean"), F.avg("depth").alias("depth_mean"))


def _quality(spark, d, *columns: str) -> DataFrame:
    return fusion.projection_quality(ad.lidar_points(spark, d), RIG).select(*FRAME, *columns)


@query
def proj_quality(spark, d):
    return _quality(spark, d, "total_points", "in_front_count", "points_in_image", "points_in_camera_fov", "fov_rate", "image_rate", *(f"depth_{k}" for k in ("min", "max", "mean", "median", "std", "p25", "p75")), "sufficient_projection_rate", "good_horizontal_coverage", "good_vertical_coverage", "balanced_depth_distribution")


@query
def proj_depth_hist(spark, d):
    return _quality(spark, d, *(f"depth_bin_{b}" for b in ("0_10m", "10_20m", "20_30m", "30_40m", "40_50m", "50_100m")))


@query
def proj_coverage(spark, d):
    return _quality(spark, d, "horizontal_coverage", "vertical_coverage")


@query
def proj_bands(spark, d):
    return _quality(spark, d, *(f"{b}_{k}" for b in fusion.BANDS for k in ("count", "pct", "avg_depth", "std_depth")))


@query
def region_frame(spark, d):
    return fusion.region_frames(ad.lidar_points(spark, d), RIG, BOX)


@query
def region_temporal(spark, d):
    return fusion.region_temporal(fusion.region_frames(ad.lidar_points(spark, d), RIG, BOX))


@query
def region_grid(spark, d):
    """Points in a table of boxes: one per nation, side by side."""
    boxes = ad.table(spark, d, "nation").select(F.col("n_name").alias("region"), (F.col("n_nationkey") * 50).cast("double").alias("x0"), (F.col("n_nationkey") * 50 + 60).cast("double").alias("x1"), F.lit(50.0).alias("y0"), F.lit(320.0).alias("y1"))
    return fusion.in_regions(_projected(spark, d), boxes)


@query
def fusion_motion_join(spark, d):
    regions = fusion.region_frames(ad.lidar_points(spark, d), RIG, BOX)
    motion = gpsimu.frame_metrics(ad.oxts(spark, d)).withColumn("drive", F.concat(F.lit("drive_"), "drive"))
    return fusion.with_motion(regions.select(*FRAME, "point_count"), motion)


@query
def fusion_overlay(spark, d):
    return fusion.overlay(_projected(spark, d)).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), *spread(F.col("shade"), "shade", "min", "max", "mean"))


@query
def fusion_zbuffer(spark, d):
    """The nearest point of every pixel of every frame."""
    return fusion.z_buffer(_projected(spark, d))


@query
def fusion_images(spark, d):
    """A PNG image a frame, read back: size, pixels seen, sum of their values."""
    return fusion.png_sums(fusion.rendered(fusion.z_buffer(_projected(spark, d)), RIG.width, RIG.height))


@query
def fusion_image_join(spark, d):
    """Points inside the image of their own frame, by frame."""
    p = fusion.projected_onto_images(ad.lidar_points(spark, d), ad.image_sizes(spark, d), RIG)
    return p.groupBy(*FRAME, "camera_id", "width").agg(F.count(F.lit(1)).alias("n"), *spread(F.col("u"), "u", "max", "mean"), *spread(F.col("depth"), "depth", "mean"))


@query
def fusion_overlay_frames(spark, d):
    """Colour values by each frame's own depths."""
    return fusion.overlay(_projected(spark, d), None).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), *spread(F.col("shade"), "shade", "min", "max", "mean"))


@query
def cam_brightness(spark, d):
    return camera.brightness(ad.luminance_images(spark, d))


@query
def cam_exposure(spark, d):
    return camera.exposure(ad.luminance_images(spark, d))


@query
def cam_sharpness(spark, d):
    return camera.sharpness(ad.luminance_images(spark, d))


@query
def cam_lum_hist(spark, d):
    return camera.luminance_histogram(ad.luminance_images(spark, d))


def _frames(spark, d, *which: str) -> DataFrame:
    """Kernel metrics of gray images tiled from vectors."""
    return camera.frame_metrics(_with_bytes(ad.tiled_images(spark, d)), which=which or camera.KERNELS)


def _with_bytes(images: DataFrame) -> DataFrame:
    return images.withColumn("data", F.expr("unhex(array_join(transform(values, v -> lpad(hex(v), 2, '0')), ''))"))


@query
def cam_kernel_brightness(spark, d):
    """What the kernel says of luminance, against SQL."""
    return _frames(spark, d, "light").select("frame_idx", "brightness_min", "brightness_max", "brightness_mean", "brightness_std", "brightness_median", "overexposed_pct", "underexposed_pct")


@query
def cam_kernel_sharpness(spark, d):
    return _frames(spark, d, "light").select("frame_idx", "sharpness")


@query
def cam_features(spark, d):
    return _frames(spark, d).select(*FRAME, "edge_pixels", "edge_density", "harris_corners", "fast_keypoints", "shi_tomasi_corners", "orb_keypoints")


@query
def cam_colour(spark, d):
    """Colour images: luminance of the three channels, and sharpness and edges of their gray values."""
    out = camera.frame_metrics(_with_bytes(ad.colour_images(spark, d)), which=("light", "edges"))
    return out.select(*FRAME, "camera_id", "brightness_min", "brightness_max", "brightness_mean", "brightness_std", "brightness_median", "overexposed_pct", "underexposed_pct", "sharpness", "edge_pixels")


@query
def cam_colour_flags(spark, d):
    """Luminance of colour images from bytes in either order of channels."""
    images = ad.colour_images(spark, d)
    turned = images.withColumn("values", F.expr("flatten(transform(sequence(0, size(values) div 3 - 1), i -> array(values[3 * i + 2], values[3 * i + 1], values[3 * i])))"))
    out = camera.frame_metrics(_with_bytes(turned), bgr=True, which=("light",))
    return out.select(*FRAME, "brightness_mean", "contrast", "dynamic_range", "good_exposure", "sufficient_contrast", "sharp_image")


@query
def cam_canny(spark, d):
    return _frames(spark, d, "edges").select(*FRAME, "edge_pixels", "edge_density")


@query
def cam_harris(spark, d):
    return _frames(spark, d, "harris").select(*FRAME, "harris_corners")


@query
def cam_fast(spark, d):
    return _frames(spark, d, "fast").select(*FRAME, "fast_keypoints")


@query
def cam_shi_tomasi(spark, d):
    return _frames(spark, d, "shi_tomasi").select(*FRAME, "shi_tomasi_corners")


@query
def cam_orb(spark, d):
    return _frames(spark, d, "orb").select(*FRAME, "orb_keypoints")


@query
def cam_oriented_keypoints(spark, d):
    """Keypoints with direction of images of 256 x 256, where the levels' limits bite; ties at a limit stay."""
    return camera.oriented_keypoints(_with_bytes(ad.tiled_images(spark, d, side=32))).drop("camera_id")


@query
def cam_tiled_metrics(spark, d):
    """Images of 256 x 256 by tiles of 48: sharpness, corners and edges as of whole images."""
    return tiles.frame_metrics(tiles.split(_with_bytes(ad.tiled_images(spark, d, side=32)), 48), 48).drop("camera_id")


@query
def cam_feature_strips(spark, d):
    return camera.strip_plot(_frames(spark, d, "orb"))


@query
def cam_keypoint_grid(spark, d):
    return camera.keypoint_grid(_frames(spark, d, "orb"))


@query
def cam_method_plot(spark, d):
    return camera.method_plot(_frames(spark, d))


@query
def cam_flags(spark, d):
    return _frames(spark, d, "light", "edges", "orb").select(*FRAME, "good_exposure", "sufficient_contrast", "sharp_image", "sufficient_edges", "sufficient_features", "verdict")


@query
def cam_sequence(spark, d):
    return camera.sequence_metrics(_frames(spark, d, "light", "orb"))


@query
def cam_sequence_full(spark, d):
    """The same by camera instead of drive."""
    return camera.sequence_metrics(_frames(spark, d, "light", "orb"), by="camera_id")


def _parts(spark, d) -> dict[str, DataFrame]:
    """The analyses of every source, images too."""
    images = ad.tiled_images(spark, d).withColumn("data", F.expr("unhex(array_join(transform(values, v -> lpad(hex(v), 2, '0')), ''))"))
    parts = report.run_summary(ad.sensor_ts(spark, d), ad.lidar_points(spark, d), ad.oxts(spark, d), images, RIG, REFERENCE)
    return {name: rounded(df, DIGITS, NUDGE) for name, df in sorted(parts.items())}


@query
def run_summary(spark, d):
    """A row a source and metric: known values, mean, least and most over the source's frames or drives."""
    return report.digest(_parts(spark, d))


@query
def run_summary_full(spark, d):
    """A row a frame or drive of each source, all its metrics as JSON text."""
    rows = [report.as_json(df).select(F.lit(name).alias("source"), "report") for name, df in _parts(spark, d).items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
