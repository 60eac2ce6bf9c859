"""Image quality: brightness, exposure, sharpness, edges and keypoints per frame, and their course over a sequence.

Two forms: expressions on luminance arrays (rows with ``lum``, row by row), which stay in the JVM, and one kernel over
image bytes (``mapInArrow``), which computes everything of an image in one visit, so that luminance, gray values
and edges are shared by the metrics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.functions import kernels as kn
from rigscope.functions.stats import cv_or_zero, flag, spread

FRAME = ["drive", "frame_idx"]
# Default thresholds.
THRESHOLDS = {"overexposed_max": 5.0, "underexposed_max": 10.0, "contrast_min": 30.0, "sharpness_min": 100.0, "edge_density_min": 2.0, "orb_keypoints_min": 500}
STRIPS = 5
#: Camera ids, names and kinds.
CAMERAS = {"image_00": ("gray_left", "gray"), "image_01": ("gray_right", "gray"), "image_02": ("color_left", "color"), "image_03": ("color_right", "color")}


def pixels(images: DataFrame) -> DataFrame:
    """(drive, frame_idx, y, x, lum) of luminance arrays."""
    w = F.col("width")
    return images.select(*FRAME, "width", F.posexplode("lum").alias("i", "lum")).select(*FRAME, F.floor(F.col("i") / w).cast("int").alias("y"), (F.col("i") % w).alias("x"), "lum")


def brightness(images: DataFrame) -> DataFrame:
    """Luminance statistics, contrast (deviation) and dynamic range of each frame."""
    p = images.select(*FRAME, F.explode("lum").alias("lum"))
    out = p.groupBy(*FRAME).agg(*spread(F.col("lum"), "brightness", "min", "max", "mean", "std", "median"))
    return out.withColumns({"contrast": F.col("brightness_std"), "dynamic_range": F.col("brightness_max") - F.col("brightness_min")})


def _share(lum: Column, test) -> Column:
    return F.try_divide(F.size(F.filter(lum, test)) * 100.0, F.size(lum))


def exposure(images: DataFrame) -> DataFrame:
    """Percentages over 240 and under 15 (both strict) and exposure quality; arrays in place, no shuffle."""
    out = images.select(*FRAME, _share(F.col("lum"), lambda v: v > 240).alias("overexposed_pct"), _share(F.col("lum"), lambda v: v < 15).alias("underexposed_pct"))
    return out.withColumn("exposure_quality", 100 - F.col("overexposed_pct") - F.col("underexposed_pct"))


def laplacian(lum: Column, height: Column, width: Column) -> Column:
    """3 x 3 Laplacian with mirrored borders of a luminance array."""

    def inside(i: Column, n: Column) -> Column:
        return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)

    def at(y: Column, x: Column) -> Column:
        return F.element_at(lum, (inside(y, height) * width + inside(x, width) + 1).cast("int"))

    def value(i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        return at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)

    return F.transform(F.sequence(F.lit(0), height * width - 1), value)


def sharpness(images: DataFrame) -> DataFrame:
    """Population variance of the Laplacian."""
    lap = images.select(*FRAME, F.explode(laplacian(F.col("lum"), F.col("height"), F.col("width"))).alias("lap"))
    return lap.groupBy(*FRAME).agg(F.var_pop("lap").alias("sharpness"))


def luminance_histogram(images: DataFrame, bins: int = 50, top: float = 255.0) -> DataFrame:
    """(drive, frame_idx, bin, n): bins of equal width on [0, top], the last one closed."""
    step = top / bins
    b = F.least(F.floor(F.col("lum") / step).cast("int"), F.lit(bins - 1))
    inside = images.select(*FRAME, F.explode("lum").alias("lum")).where(F.col("lum").between(0, top))
    return inside.groupBy(*FRAME, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_REAL = "brightness_min brightness_max brightness_mean brightness_std brightness_median contrast dynamic_range overexposed_pct underexposed_pct sharpness edge_density".split()
_WHOLE = "edge_pixels harris_corners fast_keypoints shi_tomasi_corners orb_keypoints".split()
FRAME_SCHEMA = ", ".join(
    ["drive string", "camera_id string", "frame_idx int", *(f"{n} double" for n in _REAL), *(f"{n} bigint" for n in _WHOLE), "orb_strips array<bigint>", "orb_points array<struct<x: double, y: double>>"]
)
ARROW_SCHEMA = pa.schema(
    [
        ("drive", pa.string()),
        ("camera_id", pa.string()),
        ("frame_idx", pa.int32()),
        *((n, pa.float64()) for n in _REAL),
        *((n, pa.int64()) for n in _WHOLE),
        ("orb_strips", pa.list_(pa.int64())),
        ("orb_points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
    ]
)


#: What the kernel can compute of an image.
KERNELS = ("light", "edges", "harris", "fast", "shi_tomasi", "orb")


def image_metrics(img: np.ndarray, which: tuple[str, ...] = KERNELS) -> dict:
    """What is asked for about one image (height x width, or x 3 in RGB order)."""
    g, out = kn.gray(img), {}
    if "light" in which:
        lum = kn.luminance(img)
        out |= {
            "brightness_min": float(lum.min()),
            "brightness_max": float(lum.max()),
            "brightness_mean": float(lum.mean()),
            "brightness_std": float(lum.std()),
            "brightness_median": float(np.median(lum)),
            "contrast": float(lum.std()),
            "dynamic_range": float(lum.max() - lum.min()),
            "overexposed_pct": float((lum > 240).mean() * 100),
            "underexposed_pct": float((lum < 15).mean() * 100),
            "sharpness": float(kn.laplacian(g).var()),
        }
    if "edges" in which:
        edges = kn.canny(g)
        out |= {"edge_pixels": int(edges.sum()), "edge_density": float(edges.mean() * 100)}
    if "harris" in which:
        out["harris_corners"] = kn.harris_count(g)
    if "fast" in which:
        out["fast_keypoints"] = len(kn.fast(g))
    if "shi_tomasi" in which:
        out["shi_tomasi_corners"] = len(kn.shi_tomasi(g))
    if "orb" in which:
        orb = kn.orb(g)
        out |= {"orb_keypoints": len(orb), "orb_strips": kn.strips(orb[:, 0], g.shape[0], STRIPS).tolist(), "orb_points": [{"x": float(x), "y": float(y)} for y, x, _ in orb]}
    return out


def image_of(raw, height: int, width: int, channels: int, bgr: bool) -> np.ndarray | None:
    """The pixels as an array; None without any. Bytes that don't fill the shape, and other shapes than gray or colour, fail."""
    img = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(img):
        return None
    if channels not in (1, 3, 4) or len(img) != height * width * channels:
        raise ValueError(f"{len(img)} bytes aren't a gray or colour image of {height} x {width} x {channels}")
    if channels == 1:
        return img.reshape(height, width)
    img = img.reshape(height, width, channels)
    return img[..., 2::-1] if bgr else img[..., :3]


def frame_metrics(images: DataFrame, thresholds: dict | None = None, bgr: bool = False, which: tuple[str, ...] = KERNELS) -> DataFrame:
    """Metrics and flags of frames (drive, camera_id, frame_idx, height, width, n_channels, data).

    Empty data and kernels not named in ``which`` give nulls; data of another size than its shape fails.
    """

    def run(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                h, w, c = (batch.column(k)[i].as_py() for k in (3, 4, 5))
                img = image_of(batch.column(6)[i].as_buffer(), h, w, c, bgr)
                found.append({} if img is None else image_metrics(img, which))
            made = [pa.array([m.get(f.name) for m in found], f.type) for f in list(ARROW_SCHEMA)[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], schema=ARROW_SCHEMA)

    made = images.select("drive", "camera_id", "frame_idx", "height", "width", "n_channels", "data").mapInArrow(run, FRAME_SCHEMA)
    return frame_flags(made, thresholds)


KEYPOINT_SCHEMA = pa.schema([("drive", pa.string()), ("camera_id", pa.string()), ("frame_idx", pa.int32()), ("level", pa.int32()), ("y", pa.int64()), ("x", pa.int64()), ("rank", pa.int64()), ("angle_deg", pa.float64())])


def oriented_keypoints(images: DataFrame, most: int = 2000, bgr: bool = False) -> DataFrame:
    """(drive, camera_id, frame_idx, level, y, x, rank, angle_deg): pyramid keypoints with their direction.

    Each level keeps its share of ``most`` by Harris response, and whatever ties with the last one kept (equal responses
    share a rank), so no choice depends on order. Images without data have none.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, c = (batch.column(k)[i].as_py() for k in (3, 4, 5))
                img = image_of(batch.column(6)[i].as_buffer(), h, w, c, bgr)
                found = kn.oriented(kn.gray(img), most) if img is not None else np.zeros((0, 5))
                key = [batch.column(k).take(pa.array(np.full(len(found), i))) for k in range(3)]
                made = [pa.array(found[:, k], f.type, safe=False) if f.type == pa.float64() else pa.array(found[:, k].astype(np.int64)).cast(f.type) for k, f in enumerate(list(KEYPOINT_SCHEMA)[3:])]
                yield pa.RecordBatch.from_arrays([*key, *made], schema=KEYPOINT_SCHEMA)

    schema = "drive string, camera_id string, frame_idx int, level int, y bigint, x bigint, rank bigint, angle_deg double"
    return images.select("drive", "camera_id", "frame_idx", "height", "width", "n_channels", "data").mapInArrow(run, schema)


def frame_flags(frames: DataFrame, thresholds: dict | None = None) -> DataFrame:
    t = THRESHOLDS | (thresholds or {})
    flags = {
        "good_exposure": (F.col("overexposed_pct") < t["overexposed_max"]) & (F.col("underexposed_pct") < t["underexposed_max"]),
        "sufficient_contrast": F.col("contrast") >= t["contrast_min"],
        "sharp_image": F.col("sharpness") >= t["sharpness_min"],
        "sufficient_edges": F.col("edge_density") >= t["edge_density_min"],
        "sufficient_features": F.col("orb_keypoints") >= t["orb_keypoints_min"],
    }
    have = {k: flag(v) for k, v in flags.items()}
    out = frames.withColumns(have)
    every = F.col("good_exposure")
    for k in list(have)[1:]:
        every = every & F.col(k)
    return out.withColumn("verdict", F.when(every, "GOOD").otherwise("CHECK"))


def sequence_metrics(frames: DataFrame, thresholds: dict | None = None, by: str = "drive") -> DataFrame:
    """Second-level aggregates over frame metrics, with flags."""
    t = THRESHOLDS | (thresholds or {})
    quality = 100 - F.col("overexposed_pct") - F.col("underexposed_pct")
    b, s, o = F.col("brightness_mean"), F.col("sharpness"), F.col("orb_keypoints").cast("double")
    out = frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.avg(b).alias("brightness_avg"),
        F.stddev_pop(b).alias("brightness_dev"),
        F.avg(s).alias("sharpness_avg"),
        F.stddev_pop(s).alias("sharpness_dev"),
        F.avg(quality).alias("exposure_quality_avg"),
        F.avg(o).alias("orb_avg"),
        F.stddev_pop(o).alias("orb_dev"),
    )
    out = out.withColumns({"brightness_cv": cv_or_zero(F.col("brightness_dev"), F.col("brightness_avg")), "sharpness_cv": cv_or_zero(F.col("sharpness_dev"), F.col("sharpness_avg"))})
    return out.withColumns(
        {
            "consistent_brightness": flag(F.col("brightness_cv") < 10),
            "consistent_sharpness": flag(F.col("sharpness_cv") < 20),
            "good_exposure": flag(F.col("exposure_quality_avg") > 80),
            "sufficient_features": flag(F.col("orb_avg") >= t["orb_keypoints_min"]),
        }
    )


def keypoint_grid(frames: DataFrame, columns: int = 50, rows: int = 15) -> DataFrame:
    """(drive, frame_idx, gx, gy, n): 2-D histogram of a frame's pyramid keypoints over their own extent."""
    p = frames.select(*FRAME, F.explode("orb_points").alias("p")).select(*FRAME, "p.x", "p.y")
    ends = p.groupBy(*FRAME).agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))))
    cell = lambda c, n: F.least(F.coalesce(F.floor(F.try_divide((F.col(c) - F.col(f"{c}0")) * n, F.col(f"{c}1") - F.col(f"{c}0"))), F.lit(n // 2)), F.lit(n - 1)).cast("int")
    return p.join(ends, FRAME).groupBy(*FRAME, cell("x", columns).alias("gx"), cell("y", rows).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def strip_plot(frames: DataFrame) -> DataFrame:
    """(drive, frame_idx, strip, n, pct): pyramid keypoints by horizontal strip of the image."""
    p = frames.select(*FRAME, "orb_keypoints", F.posexplode("orb_strips").alias("strip", "n"))
    return p.select(*FRAME, "strip", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("orb_keypoints")), F.lit(0.0)).alias("pct"))


def method_plot(frames: DataFrame) -> DataFrame:
    """(drive, frame_idx, method, n): counts of the five detectors."""
    return frames.select(*FRAME, F.expr("stack(5, 'harris', harris_corners, 'orb', orb_keypoints, 'fast', fast_keypoints, 'shi_tomasi', shi_tomasi_corners, 'canny', edge_pixels) as (method, n)"))
