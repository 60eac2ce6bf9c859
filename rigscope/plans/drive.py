"""The whole analysis of a recorded drive: six stages, ten JSON reports.

Every stage is lazy; a report is written when its stage is done. Points are projected once and kept for the two
fusion reports.
"""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.operators import calibration, camera, fusion, gpsimu, lidar, sync
from rigscope.plans.report import write_summary
from rigscope.sources import drives

REGION = (400.0, 200.0, 800.0, 350.0)


def analyse(spark: SparkSession, base_path: str, drive: str, output_dir: str = "outputs", camera_id: str = "image_02", sampled_frames: int = 5, fusion_frames: tuple[int, ...] = (0, 50, 100), reference: str = "lidar", first_sensor: str = "gray_left") -> dict[str, str]:
    """Writes the reports of ``<base_path>/<drive>`` and returns their paths by name.

    Frames that a list names but the drive lacks are left out of the fusion reports.
    """
    base, out = base_path.rstrip("/"), Path(output_dir)
    root, done = f"{base}/{drive}", {}

    def report(name: str, df: DataFrame) -> None:
        done[name] = str(out / f"{name}.json")
        write_summary(df, done[name])

    ts = drives.timestamps(spark, root)
    report("timestamp_analysis", sync.report(ts, reference).join(sync.summary(ts, reference, first_sensor).select("drive", "num_sensors", "duration_sec"), "drive"))

    points = drives.lidar(spark, root).withColumn("point_key", F.col("point_idx"))
    ids = sorted(r["frame_idx"] for r in spark.read.format("binaryFile").load(f"{root}/velodyne_points/data/*.bin").select(F.regexp_extract("path", r"(\d{10})\.", 1).cast("int").alias("frame_idx")).collect())
    chosen = [ids[i] for i in lidar.seeded_frames(len(ids), sampled_frames)]
    resolved = lambda p: lidar.frame_metrics(p).join(lidar.spatial_resolution(p), ["drive", "frame_idx"], "left").withColumn("timestamp", sync.synthetic_time())
    report("lidar_frame_analysis", resolved(drives.lidar(spark, root, ids[0], ids[0] + 1).withColumn("point_key", F.col("point_idx"))))
    report("lidar_sequence_analysis", lidar.sequence_metrics(resolved(lidar.picked_frames(points, chosen))))

    pictures = lambda start, end: camera.frame_metrics(drives.images(spark, root, camera_id).where(F.col("frame_idx").between(start, end)), bgr=True)
    first = drives.images(spark, root, camera_id).agg(F.min("frame_idx").alias("m")).first()["m"]
    report("camera_frame_analysis", pictures(first, first).drop("orb_points"))
    report("camera_sequence_analysis", camera.sequence_metrics(pictures(first, first + 4)))

    packets = drives.oxts(spark, root).withColumn("timestamp", sync.synthetic_time())
    report("gps_imu_analysis", gpsimu.verdict(gpsimu.sequence_metrics(packets)))

    calib = calibration.parsed(drives.calibration_lines(spark, base))
    report("calibration", calibration.transforms(calib, camera_id[-2:]))
    rig = calibration.rig(calib, base.rsplit("/", 1)[-1], camera_id[-2:])

    fused = lidar.picked_frames(points, [i for i in fusion_frames if i in set(ids)])
    report("fusion_analysis", fusion.projection_quality(fused, rig))
    regions = fusion.region_frames(fused, rig, REGION)
    report("region_temporal_analysis", fusion.region_temporal(regions))

    quality = sync.sync_quality(ts, reference).drop("drive").limit(1)
    about = {"drive": F.lit(drive), "analysed_at": F.lit(time.strftime("%Y-%m-%d %H:%M:%S")), "lidar_frames": F.lit(len(ids)), "sampled": F.array(*(F.lit(i) for i in chosen))}
    report("analysis_summary", quality.select(*(c.alias(n) for n, c in about.items()), "*"))
    return done
