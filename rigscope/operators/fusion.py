"""LiDAR points in a camera image: projection, its quality, and regions over time.

Extrinsics, rectification and projection are linear, so they are folded into one row of four factors for each result:
on the driver for a single rig, in the small camera table where points name theirs. A point's numbers are then a few
products, made once a row; per-frame results are one aggregate over all points, so frames without any projected point
survive without a join.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.functions.stats import cv_or_zero, flag, histogram, spread
from rigscope.operators.calibration import Rig

FRAME = ["drive", "frame_idx"]
# Vertical bands as fractions of the height, half-open.
BANDS = {"top_sky": (0.0, 0.33), "middle_objects": (0.33, 0.67), "bottom_road": (0.67, 1.0)}


RESULTS = ("x_rect", "y_rect", "z_rect", "_h0", "_h1", "_h2")
#: Pixels a side of the tiles by which points meet the boxes of a table.
TILE = 64
#: Tiles a side; what lies beyond belongs to the last ones, so that a box touches a bounded number whatever its size.
TILES = 64


def folded(rig: Rig) -> dict[str, list[float]]:
    """The factors of x, y, z and 1 in each of RESULTS."""
    r, rect, p = np.reshape(rig.r, (3, 3)), np.reshape(rig.r_rect, (3, 3)), np.reshape(rig.p_rect, (3, 4))
    turned = rect @ np.c_[r, rig.t]
    rows = np.r_[turned, p[:, :3] @ turned + np.c_[np.zeros((3, 3)), p[:, 3]]]
    return {name: row.tolist() for name, row in zip(RESULTS, rows, strict=True)}


def folded_columns(cameras: DataFrame, on: str = "date") -> DataFrame:
    """The camera table with one array of factors for each of RESULTS."""
    at = lambda c, i: F.element_at(F.col(c), i + 1)

    def times(left, right, n: int) -> Column:
        terms = [left(k) * right(k) for k in range(n)]
        return sum(terms[1:], terms[0])

    lifted = cameras.select(on, "p_rect", "width", "height", *(F.array(*(times(lambda k, i=i: at("r_rect", 3 * i + k), lambda k, j=j: at("r", 3 * k + j) if j < 3 else at("t", k), 3) for j in range(4))).alias(RESULTS[i]) for i in range(3)))
    homogeneous = [F.array(*(times(lambda k, i=i: at("p_rect", 4 * i + k), lambda k, j=j: at(RESULTS[k], j), 3) + (at("p_rect", 4 * i + 3) if j == 3 else F.lit(0.0)) for j in range(4))).alias(RESULTS[3 + i]) for i in range(3)]
    return lifted.select(on, "width", "height", *RESULTS[:3], *homogeneous)


def _placed(points: DataFrame, factors: dict[str, list]) -> DataFrame:
    """Points with RESULTS."""
    x, y, z = (F.col(a).cast("double") for a in "xyz")
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return points.withColumns({n: lift(f[0]) * x + lift(f[1]) * y + lift(f[2]) * z + lift(f[3]) for n, f in factors.items()})


def _imaged(placed: DataFrame) -> DataFrame:
    """Adds u, v and depth."""
    return placed.withColumns({"u": F.try_divide("_h0", "_h2"), "v": F.try_divide("_h1", "_h2"), "depth": F.col("z_rect")}).drop("_h0", "_h1", "_h2")


def _within(w, h) -> Column:
    return (F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h)


def projected(points: DataFrame, rig: Rig, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Points with u, v, depth, x_rect, y_rect, z_rect; those in front of the camera (z_rect > 0) and, with ``bounds``
    (width, height), inside the image. Depth is the rectified z.
    """
    out = _imaged(_placed(points, folded(rig)).where(F.col("z_rect") > 0))
    return out if bounds is None else out.where(_within(*bounds))


def projected_by_date(points: DataFrame, cameras: DataFrame, on: str = "date") -> DataFrame:
    """As ``projected``, for points that name their calibration: an equi-join with the small camera table."""
    joined = points.join(folded_columns(cameras, on).withColumnsRenamed({n: f"_m{n}" for n in RESULTS}), on)
    placed = _placed(joined, {n: [F.col(f"_m{n}")[i] for i in range(4)] for n in RESULTS}).drop(*(f"_m{n}" for n in RESULTS))
    return _imaged(placed.where(F.col("z_rect") > 0)).where(_within(F.col("width"), F.col("height")))


def projected_onto_images(points: DataFrame, images: DataFrame, rig: Rig) -> DataFrame:
    """As ``projected``, inside the image of the point's own frame: an equi-join of points and image sizes on drive and
    frame number. Points of frames without an image (or with an empty one) are left out."""
    sizes = images.where((F.col("width") > 0) & (F.col("height") > 0)).select(*FRAME, "camera_id", "width", "height")
    out = _imaged(_placed(points.join(sizes, FRAME), folded(rig)).where(F.col("z_rect") > 0))
    return out.where(_within(F.col("width"), F.col("height")))


def seen(points: DataFrame, rig: Rig) -> DataFrame:
    """All points: in_front, and u, v, depth of those inside the rig's image (null for others)."""
    flat = _imaged(_placed(points.select(*FRAME, "x", "y", "z"), folded(rig))).withColumn("in_front", F.col("z_rect") > 0)
    flat = flat.withColumn("in_image", F.col("in_front") & _within(rig.width, rig.height))
    return flat.select(*FRAME, "in_front", *(F.when(F.col("in_image"), F.col(c)).alias(c) for c in ("u", "v", "depth")))


def band_edges(height: int) -> dict[str, tuple[int, int]]:
    return {n: (int(a * height), int(b * height)) for n, (a, b) in BANDS.items()}


def band_stats(height: int) -> list[Column]:
    """Count, percentage, mean and deviation of depth by band; zeros for empty bands."""
    v, d, out = F.col("v"), F.col("depth"), []
    for name, (a, b) in band_edges(height).items():
        inside = (v >= a) & (v < b)
        out += [
            F.count_if(inside).alias(f"{name}_count"),
            F.coalesce(F.try_divide(F.count_if(inside) * 100.0, F.count("u")), F.lit(0.0)).alias(f"{name}_pct"),
            F.coalesce(F.avg(F.when(inside, d)), F.lit(0.0)).alias(f"{name}_avg_depth"),
            F.coalesce(F.stddev_pop(F.when(inside, d)), F.lit(0.0)).alias(f"{name}_std_depth"),
        ]
    return out


def coverage(width: int, height: int) -> list[Column]:
    """Extent of the projected points as percentages of the image; 0 without points."""
    return [F.coalesce((F.max(c) - F.min(c)) / n * 100, F.lit(0.0)).alias(a) for c, n, a in (("u", width, "horizontal_coverage"), ("v", height, "vertical_coverage"))]


def depth_stats() -> list[Column]:
    return spread(F.col("depth"), "depth", "min", "max", "mean", "median", "std", "p25", "p75")


def projection_quality(points: DataFrame, calib: Rig) -> DataFrame:
    """Per frame: rates, depth statistics and histogram, coverage, bands and flags.

    points_in_camera_fov counts the points inside the image, as points_in_image does; in_front_count is the number
    in front of the camera.
    """
    w, h = calib.width, calib.height
    out = seen(points, calib).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_if("in_front").alias("in_front_count"),
        F.count("depth").alias("points_in_image"),
        *depth_stats(),
        *histogram(F.col("depth"), "depth_bin"),
        *coverage(w, h),
        *band_stats(h),
    )
    rate = F.try_divide(F.col("points_in_image") * 100.0, F.col("total_points"))
    out = out.withColumns({"points_in_camera_fov": F.col("points_in_image"), "fov_rate": rate, "image_rate": rate})
    return out.withColumns(
        {
            "sufficient_projection_rate": flag(F.col("image_rate") > 60),
            "good_horizontal_coverage": flag(F.col("horizontal_coverage") > 90),
            "good_vertical_coverage": flag(F.col("vertical_coverage") > 50),
            "balanced_depth_distribution": flag(F.col("depth_mean") < 30),
        }
    )


def region_frames(points: DataFrame, calib: Rig, box: tuple[float, float, float, float]) -> DataFrame:
    """Per frame: count and depth statistics of the points in the closed box (and in the image); zeros without points."""
    x0, y0, x1, y1 = box
    d = F.when(F.col("u").between(x0, x1) & F.col("v").between(y0, y1), F.col("depth"))
    inside = seen(points, calib).select(*FRAME, d.alias("depth"))
    return inside.groupBy(*FRAME).agg(F.count("depth").alias("point_count"), *(F.coalesce(f("depth"), F.lit(0.0)).alias(f"{n}_depth") for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def region_temporal(regions: DataFrame) -> DataFrame:
    """Per drive: statistics over frames of the counts, and of the mean depths of frames that have points; flags."""
    n, d = F.col("point_count").cast("double"), F.when(F.col("avg_depth") > 0, F.col("avg_depth"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = regions.groupBy("drive").agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.avg(n).alias("count_mean"),
        F.stddev_pop(n).alias("count_std"),
        F.min("point_count").alias("count_min"),
        F.max("point_count").alias("count_max"),
        zero(F.avg(d)).alias("depth_mean"),
        zero(F.stddev_pop(d)).alias("depth_std"),
    )
    out = out.withColumns({"count_cv": cv_or_zero(F.col("count_std"), F.col("count_mean")), "depth_cv": cv_or_zero(F.col("depth_std"), F.col("depth_mean"))})
    return out.withColumns({"consistent_count": F.col("count_cv") < 20, "stable_depth": F.col("depth_cv") < 10, "always_visible": F.col("count_min") > 0})


def in_regions(proj: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, frame, count) for a table of boxes (region, x0, y0, x1, y1), which may be of any size.

    Boxes are dealt to the tiles that they touch, so that points meet them by an equi-join; the closed bounds decide.
    """
    tile = lambda c: F.greatest(F.least(F.floor(c / TILE), F.lit(TILES)), F.lit(-1))
    span = lambda a, b: F.explode(F.sequence(tile(F.col(a)), tile(F.col(b))))
    boxes = regions.where("x0 <= x1 and y0 <= y1").select("*", span("x0", "x1").alias("_tx")).select("*", span("y0", "y1").alias("_ty"))
    inside = (F.col("u") >= F.col("x0")) & (F.col("u") <= F.col("x1")) & (F.col("v") >= F.col("y0")) & (F.col("v") <= F.col("y1"))
    placed = proj.withColumns({"_tx": tile(F.col("u")), "_ty": tile(F.col("v"))})
    return placed.join(boxes, ["_tx", "_ty"]).where(inside).groupBy(*FRAME, "region").agg(F.count(F.lit(1)).alias("point_count"), F.avg("depth").alias("avg_depth"))


def with_motion(per_frame: DataFrame, motion: DataFrame) -> DataFrame:
    """Per-frame rows with speed_kmh and yaw_deg where a packet of that frame is known."""
    return per_frame.join(motion.select(*FRAME, "speed_kmh", "yaw_deg"), FRAME, "left")


def normalized_depth(depth: Column, lo: float = 0.0, hi: float = 50.0) -> Column:
    """Depth clipped to [lo, hi] and scaled to [0, 1]."""
    return (F.least(F.greatest(depth, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)


def overlay(proj: DataFrame, depth_range: tuple[float, float] | None = (0.0, 50.0)) -> DataFrame:
    """The overlay figure's points: u, v, depth and colour value. Without ``depth_range`` each frame has its own."""
    if depth_range is not None:
        return proj.select(*FRAME, "u", "v", "depth", normalized_depth(F.col("depth"), *depth_range).alias("shade"))
    ends = proj.groupBy(*FRAME).agg(F.min("depth").alias("_lo"), F.max("depth").alias("_hi"))
    shade = F.coalesce(F.try_divide(F.col("depth") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return proj.join(ends, FRAME).select(*FRAME, "u", "v", "depth", shade.alias("shade"))


def z_buffer(proj: DataFrame) -> DataFrame:
    """(drive, frame_idx, px, py, depth, hits): the nearest point that each pixel shows, and how many fall on it."""
    pixel = [F.floor("u").cast("int").alias("px"), F.floor("v").cast("int").alias("py")]
    return proj.groupBy(*FRAME, *pixel).agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("hits"))


def png_bytes(gray: np.ndarray) -> bytes:
    """An 8-bit gray image as PNG, lines unfiltered."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((len(gray), 1), np.uint8), gray], axis=1)
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_values(data: bytes) -> np.ndarray:
    """The pixels of what ``png_bytes`` made."""
    at, parts, width, height = 8, [], 0, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[at + 8 : at + 16])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:]


def rendered(pixels: DataFrame, width: int, height: int, depth_range: tuple[float, float] = (0.0, 50.0)) -> DataFrame:
    """(drive, frame_idx, png): each frame's pixels as a gray image, near ones bright, 0 where nothing is seen.

    A frame has a row for each pixel at most, so its size is the image's, however many points fell on it. Pixels outside
    the image are left out; frames without pixels have no image.
    """
    shade = normalized_depth(F.col("depth"), *depth_range)
    rows = pixels.select(*FRAME, "px", "py", (255 - F.floor(shade * 254 + 0.5)).cast("int").alias("value")).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))

    def draw(group: pa.Table) -> pa.Table:
        gray = np.zeros((height, width), np.uint8)
        gray[group.column("py").to_numpy(), group.column("px").to_numpy()] = group.column("value").to_numpy()
        return pa.table([group.column("drive")[:1], group.column("frame_idx")[:1], pa.array([png_bytes(gray)], pa.binary())], names=[*FRAME, "png"])

    return rows.groupBy(*FRAME).applyInArrow(draw, "drive string, frame_idx int, png binary")


def png_sums(images: DataFrame) -> DataFrame:
    """(drive, frame_idx, width, height, lit, total): what the bytes of each image say: its size, pixels seen, and their sum."""

    def read(batches):
        for batch in batches:
            got = [png_values(b) for b in batch.column(2).to_pylist()]
            columns = [[g.shape[1] for g in got], [g.shape[0] for g in got], [int((g > 0).sum()) for g in got], [int(g.sum(dtype=np.int64)) for g in got]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in columns)], names=[*FRAME, "width", "height", "lit", "total"])

    return images.select(*FRAME, "png").mapInArrow(read, "drive string, frame_idx int, width bigint, height bigint, lit bigint, total bigint")
