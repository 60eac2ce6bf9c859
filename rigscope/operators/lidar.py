"""Point-cloud quality: per frame, and per sequence of frames.

Points are rows (drive, frame_idx, x, y, z, reflectance); every frame metric is one aggregate on (drive, frame_idx),
so any choice of metrics is one shuffle of partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.functions.stats import RANGE_EDGES, cv, flag, histogram, share, spread
from rigscope.session import stored

FRAME = ["drive", "frame_idx"]
AXES = ["x", "y", "z"]

# Azimuth sectors in degrees, closed below, open above; the rear one wraps round.
SECTORS = {
    "front": (-22.5, 22.5),
    "front_left": (22.5, 67.5),
    "left": (67.5, 112.5),
    "rear_left": (112.5, 157.5),
    "rear": (157.5, 180),
    "rear_right": (-157.5, -112.5),
    "right": (-112.5, -67.5),
    "front_right": (-67.5, -22.5),
}


def validated(points: DataFrame) -> DataFrame:
    """Fails at analysis time if the columns aren't those of a point cloud."""
    lacking = [c for c in (*FRAME, "x", "y", "z", "reflectance") if c not in points.columns]
    if lacking:
        raise ValueError(f"not a point cloud: {', '.join(lacking)} missing")
    return points


def with_geometry(points: DataFrame) -> DataFrame:
    """Adds dist, horiz, azimuth and elevation (degrees). A y of -0.0 counts as 0."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    horiz = F.sqrt(x * x + y * y)
    return points.withColumns(
        {
            "dist": F.sqrt(x * x + y * y + z * z),
            "horiz": horiz,
            "azimuth": F.degrees(F.atan2(y + F.lit(0.0), x)),
            "elevation": F.degrees(F.atan2(z, horiz)),
        }
    )


def range_stats() -> list[Column]:
    return spread(F.col("dist"), "range", "min", "max", "mean", "median", "std", "p25", "p75")


def coordinate_stats() -> list[Column]:
    return [c for axis in "xyz" for c in spread(F.col(axis).cast("double"), axis, "min", "max", "mean", "std", "range")]


def azimuth_coverage() -> list[Column]:
    """Counts by sector. Exactly -157.5 degrees lies in the rear and in the rear right sector."""
    a, out = F.col("azimuth"), []
    for name, (lo, hi) in SECTORS.items():
        inside = (a >= lo) | (a <= -lo) if name == "rear" else (a >= lo) & (a < hi)
        out.append(F.count_if(inside).alias(f"sector_{name}"))
    return out


def range_distribution() -> list[Column]:
    return histogram(F.col("dist"), "bin")


def reflectance_stats() -> list[Column]:
    r = F.col("reflectance").cast("double")
    return [*spread(r, "reflectance", "min", "max", "mean", "median", "std"), share(r == 0).alias("zero_reflectance_pct")]


def field_of_view() -> list[Column]:
    return [(F.max("azimuth") - F.min("azimuth")).alias("horizontal_fov"), (F.max("elevation") - F.min("elevation")).alias("vertical_fov")]


def density() -> list[Column]:
    """Points, sensor height, and mean density: points over mean range times the number of bin edges."""
    mean = F.avg("dist")
    return [
        F.count(F.lit(1)).alias("num_points"),
        F.abs(F.min(F.col("z").cast("double"))).alias("sensor_height"),
        F.when(mean > 0, F.count(F.lit(1)) / (mean * len(RANGE_EDGES))).otherwise(F.lit(0.0)).alias("mean_point_density"),
    ]


def frame_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sufficient_points": flag(F.col("num_points") > 50_000),
            "full_horizontal_coverage": flag(F.col("horizontal_fov") > 355),
            "good_vertical_coverage": flag(F.col("vertical_fov") > 20),
            "reasonable_range": flag(F.col("range_mean") < 30),
            "good_reflectance": flag(F.col("zero_reflectance_pct") < 50),
        }
    )


def aggregate(points: DataFrame, *metrics: list[Column]) -> DataFrame:
    return with_geometry(points).groupBy(*FRAME).agg(*(c for m in metrics for c in m))


def frame_metrics(points: DataFrame) -> DataFrame:
    """All metrics and flags of every frame, in one aggregate."""
    return frame_flags(aggregate(validated(points), density(), range_stats(), coordinate_stats(), azimuth_coverage(), range_distribution(), reflectance_stats(), field_of_view()))


def sample_points(points: DataFrame, most: int, key: str = "point_key", multiplier: int = 2_654_435_761) -> DataFrame:
    """At most ``most`` points a frame: those whose keys hash lowest; the same ones in every run."""
    h = F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * multiplier, F.lit(1 << 32))
    w = W.partitionBy(*FRAME).orderBy(h, key, "x", "y", "z")
    return points.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= most)


def nearest_squares(p: np.ndarray) -> np.ndarray:
    """Squared distance of each point (of two or more) to its nearest neighbour.

    Points are put in order along the axis of widest spread; each meets the one a step away, then two steps, until the gap
    along that axis alone is as wide as every point's best distance. When few of many points are left, they go on alone.
    """
    axis, n = np.argmax(p.std(axis=0)), len(p)
    order = np.argsort(p[:, axis], kind="stable")
    p = p[order]
    columns, best = [np.ascontiguousarray(c) for c in p.T], np.full(n, np.inf)
    live, step = n, 0
    while live and step < n - 1 and (n <= 8192 or live > n // 16):
        step += 1
        squares = [(c[step:] - c[:-step]) ** 2 for c in columns]
        square = squares[0] + squares[1] + squares[2]
        np.minimum(best[step:], square, out=best[step:])
        np.minimum(best[:-step], square, out=best[:-step])
        live = np.count_nonzero(squares[axis] < np.maximum(best[step:], best[:-step]))
    for way in (1, -1) if live else ():
        rest = np.arange(n)
        for far in range(way * (step + 1), way * n, way):
            rest = rest[(rest + far >= 0) & (rest + far < n)]
            rest = rest[(columns[axis][rest + far] - columns[axis][rest]) ** 2 < best[rest]]
            if not len(rest):
                break
            best[rest] = np.minimum(best[rest], ((p[rest + far] - p[rest]) ** 2).sum(axis=1))
    out = np.empty(n)
    out[order] = best
    return out


def spatial_resolution(points: DataFrame, sample_size: int = 5000, key: str = "point_key") -> DataFrame:
    """Mean distance in centimetres of a frame's sampled points to their nearest neighbours; null for one point.

    A frame's sample is bounded, so one task per frame finds the neighbours.
    """

    def nearest(group: pa.Table) -> pa.Table:
        p = np.stack([group.column(c).to_numpy() for c in "xyz"], axis=1)
        value = float(np.sqrt(nearest_squares(p)).mean() * 100) if len(p) > 1 else None
        return pa.table([group.column("drive")[:1], group.column("frame_idx")[:1], pa.array([len(p)], pa.int64()), pa.array([value], pa.float64())], names=["drive", "frame_idx", "sampled", "spatial_resolution_cm"])

    picked = sample_points(points, sample_size, key).select(*FRAME, *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return picked.groupBy(*FRAME).applyInArrow(nearest, "drive string, frame_idx int, sampled bigint, spatial_resolution_cm double")


def frame_grids(points: DataFrame, finest: float = 1.0) -> DataFrame:
    """A row a frame: its number (frame), rows, finite points, what a point that isn't finite adds (odd: NaN or infinity), least
    corner, extents, and the width of a cell: ``finest`` times that at which points on a surface would be two a cell."""
    size = sum((F.abs(c) for c in AXES), F.lit(0.0))  # null, NaN or infinite if a coordinate is
    p = points.select(*FRAME, *(F.col(c).cast("double").alias(c) for c in AXES)).withColumn("finite", F.coalesce(size < math.inf, F.lit(False)))
    inside = {c: F.when(F.col("finite"), F.col(c)) for c in AXES}
    out = p.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("finite").alias("finite"),
        F.count_if(~F.col("finite") & size.isNotNull()).alias("odds"),
        F.max(F.when(~F.col("finite"), size)).alias("odd"),
        F.approx_count_distinct(F.when(F.col("finite"), F.struct(*AXES))).alias("places"),
        *(F.min(e).alias(f"{c}0") for c, e in inside.items()),
        *((F.max(e) - F.min(e)).alias(f"{c}s") for c, e in inside.items()),
    )
    out = out.withColumn("side", F.greatest(*(f"{c}s" for c in AXES)))
    width = F.when(F.col("side") > 0, F.greatest(F.col("side") * F.sqrt(F.lit(2.0) / F.greatest("places", F.lit(1))), F.lit(1e-290))).otherwise(1.0)
    return stored(out.select(F.monotonically_increasing_id().alias("frame"), "*", (width * finest).alias("width")), "neighbours-frames")


def _placed(points: DataFrame, frames: DataFrame) -> DataFrame:
    """The finite points with their frame's row, by a broadcast of the frames."""
    p = points.select(*FRAME, *(F.col(c).cast("double").alias(c) for c in AXES)).where(sum((F.abs(c) for c in AXES), F.lit(0.0)) < math.inf)
    return p.join(F.broadcast(frames), FRAME)


def _blocks(points: DataFrame, frames: DataFrame, across: int, halo: int) -> DataFrame:
    """(frame, block, reach, x, y, z): every point in its cubic block, ``across`` cells wide, and in those whose halo of ``halo`` cells
    it lies in. reach is what lies between a point and the end of its block's halo, infinite where the frame ends; null in a halo."""
    wide = F.col("width") * across
    sized = frames.select(*FRAME, "frame", *(f"{c}0" for c in AXES), wide.alias("wide"), (F.col("width") * halo).alias("margin"), *(F.floor(F.col(f"{c}s") / wide).alias(f"{c}n") for c in AXES))
    df = _placed(points, sized)
    df = df.withColumns({f"{c}b": F.floor((F.col(c) - F.col(f"{c}0")) / F.col("wide")) for c in AXES})
    df = df.withColumns({f"{c}r": F.col(c) - F.col(f"{c}0") - F.col(f"{c}b") * F.col("wide") for c in AXES})  # within the block
    below = {c: F.when(F.col(f"{c}b") > 0, F.col(f"{c}r")).otherwise(math.inf) for c in AXES}
    above = {c: F.when(F.col(f"{c}b") < F.col(f"{c}n"), F.col("wide") - F.col(f"{c}r")).otherwise(math.inf) for c in AXES}
    long = lambda n: F.lit(n).cast("long")
    df = df.select(
        "frame",
        *AXES,
        (F.col("xb") + F.shiftleft("yb", 20) + F.shiftleft("zb", 40)).alias("own"),
        (F.least(*below.values(), *above.values()) + F.col("margin")).alias("reach"),
        *(F.when(below[c] <= F.col("margin"), long(-1 << 20 * n)).when(above[c] <= F.col("margin"), long(1 << 20 * n)).otherwise(long(0)).alias(f"{c}o") for n, c in enumerate(AXES)),
    )
    xo, yo, zo = (F.col(f"{c}o") for c in AXES)
    offsets = F.when((xo == 0) & (yo == 0) & (zo == 0), F.array(long(0))).otherwise(F.array_distinct(F.array(long(0), xo, yo, zo, xo + yo, xo + zo, yo + zo, xo + yo + zo)))
    df = df.select("frame", *AXES, "own", "reach", F.explode(offsets).alias("offset"))
    # a float that is never more than the distance
    reach = F.col("reach")
    less = F.when(reach == math.inf, reach).when(reach < 1e-30, 0.0).otherwise(F.least(reach * (1 - 1e-6), F.lit(3e38)))
    return df.select("frame", (F.col("own") + F.col("offset")).alias("block"), F.when(F.col("offset") == 0, less).cast("float").alias("reach"), *AXES)


def _block_neighbours(each: bool) -> Callable[[pa.Table], pa.Table]:
    """Nearest neighbours of a block's distinct points. Unless ``each`` is asked for, those that are sure become one row."""

    def nearest(group: pa.Table) -> pa.Table:
        p, reach = np.stack([group.column(c).to_numpy() for c in AXES], axis=1), group.column("reach").to_numpy()
        order = np.lexsort(p.T)
        p, reach = p[order], reach[order]
        start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(axis=1)])
        copies, p, reach = np.diff(np.r_[start, len(p)]), p[start], reach[start].astype(float)
        d2 = np.where(copies > 1, 0.0, nearest_squares(p) if len(p) > 1 else math.inf)
        own = ~np.isnan(reach)
        p, copies, d2, reach = p[own], copies[own], d2[own], reach[own]
        alone = (copies == 1) & (len(start) == 1)
        sure = d2 <= reach**2
        roots = float(np.sqrt(d2[sure & ~alone]).sum())
        rows = slice(None) if each else ~sure
        n = len(p[rows])
        out = {c: pa.array(p[rows, i]) for i, c in enumerate(AXES)}
        out |= {"copies": pa.array(copies[rows], pa.int64()), "d2": pa.array(d2[rows], mask=alone[rows]), "sure": pa.array(sure[rows]), "roots": pa.nulls(n, pa.float64())}
        table = pa.table({"frame": pa.repeat(group.column("frame")[0], n), **out})
        if each:
            return table
        one = {c: [None] for c in table.column_names} | {"frame": [group.column("frame")[0].as_py()], "copies": [int(copies[sure].sum())], "sure": [True], "roots": [roots]}
        return pa.concat_tables([table, pa.table(one, table.schema)])

    return nearest


def _neighbours(points: DataFrame, frames: DataFrame, widen: float, each: bool, across: int = 24, halo: int = 2) -> DataFrame:
    """(frame, x, y, z, copies, d2, roots): the distinct finite points, each in a row or, unless ``each``, many of them in one with
    the sum of their distances in roots."""
    kinds = "frame bigint, x double, y double, z double, copies bigint, d2 double, sure boolean, roots double"
    found = stored(_blocks(points, frames, across, halo).groupBy("frame", "block").applyInArrow(_block_neighbours(each), kinds), "neighbours-blocks")
    columns = ["frame", *AXES, "copies", "d2", "roots"]
    done, scale, place = [found.where("sure").select(columns)], float(halo), ["i", "j", "k"]
    left = found.where("not sure").drop("sure")
    while not left.isEmpty():
        scale *= widen
        wide = F.col("width") * scale
        at = {a: F.floor((F.col(c) - F.col(f"{c}0")) / wide) for a, c in zip(place, AXES, strict=True)}
        there = _placed(points, frames).select("frame", *(at[a].alias(a) for a in place), *(F.col(c).alias(f"{c}o") for c in AXES))
        # stored, as its size decides how it is joined
        seek = stored(left.select(columns).join(F.broadcast(frames.select("frame", "side", "width", *(f"{c}0" for c in AXES))), "frame"), "neighbours-left")
        cells = seek.select("frame", *AXES, *(at[a].alias(f"_{a}") for a in place))
        for a in place:
            cells = cells.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(a, F.col(f"_{a}") + F.col("step")).drop("step", f"_{a}")
        square = sum(((F.col(c) - F.col(f"{c}o")) ** 2 for c in AXES), F.lit(0.0))
        other = ~((F.col("x") == F.col("xo")) & (F.col("y") == F.col("yo")) & (F.col("z") == F.col("zo")))
        best = cells.join(there, ["frame", *place]).where(other).groupBy("frame", *AXES).agg(F.min(square).alias("best"))
        sure = F.coalesce((F.col("best") <= wide * wide) | (wide >= F.col("side")), F.lit(False))
        level = stored(seek.join(best, ["frame", *AXES], "left").withColumn("d2", F.col("best")).withColumn("sure", sure).select(*columns, "sure"), "neighbours-level")
        done.append(level.where("sure").select(columns))
        left = level.where("not sure")
    return reduce(DataFrame.unionByName, done)


def neighbour_squares(points: DataFrame, finest: float = 1.0, widen: float = 4.0) -> DataFrame:
    """(drive, frame_idx, x, y, z, copies, d2): the squared distance of every distinct point to its nearest neighbour.

    A frame is dealt into blocks of cells; each block also gets the points of a halo around it, and a task finds in it what is nearest
    to its own points. What is found no farther than the halo's end is the nearest; for the few points that find none, an equi-join
    takes cells ``widen`` times as wide as the halo and the 26 around each, and wider ones until one cell holds the frame. Points at
    one place are at distance 0; d2 is null for a frame's only point and where a coordinate is null, and NaN or infinite where one is.
    """
    frames = frame_grids(points, finest)
    out = _neighbours(points, frames, widen, each=True).join(F.broadcast(frames.select("frame", *FRAME)), "frame").select(*FRAME, *AXES, "copies", "d2")
    size = sum((F.abs(c) for c in AXES), F.lit(0.0))
    odd = points.select(*FRAME, *(F.col(c).cast("double").alias(c) for c in AXES)).where(~F.coalesce(size < math.inf, F.lit(False))).groupBy(*FRAME, *AXES).agg(F.count(F.lit(1)).alias("copies"))
    odd = odd.join(F.broadcast(frames.select(*FRAME, (F.col("finite") + F.col("odds") > 1).alias("more"))), FRAME)
    return out.unionByName(odd.select(*FRAME, *AXES, "copies", F.when(F.col("more"), size).alias("d2")))


def full_resolution(points: DataFrame) -> DataFrame:
    """Mean distance in centimetres of all points of a frame to their nearest neighbours; null for one point. Points with a null
    coordinate are counted, but have no distance."""
    frames = frame_grids(points)
    roots = F.coalesce("roots", F.when(F.col("copies") == 1, F.sqrt("d2")), F.lit(0.0))
    sums = _neighbours(points, frames, 4.0, each=False).groupBy("frame").agg(F.sum(roots).alias("roots"))
    mean = F.when(F.col("finite") + F.col("odds") > 1, F.coalesce(F.col("odd"), F.when(F.col("finite") > 1, F.col("roots") / F.col("finite"))))
    return frames.join(sums, "frame", "left").select(*FRAME, "points", (mean * 100).alias("spatial_resolution_cm"))


def frame_sample(points: DataFrame, frames: int = 5) -> DataFrame:
    """The points of ``frames`` frames a drive, picked by hash: a semi join."""
    ids = points.select(*FRAME).distinct()
    w = W.partitionBy("drive").orderBy(F.pmod(F.col("frame_idx").cast("long") * 2_654_435_761, F.lit(1 << 32)), "frame_idx")
    chosen = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= frames).select(*FRAME)
    return points.join(chosen, FRAME, "left_semi")


def seeded_frames(total: int, frames: int = 5, seed: int = 42) -> list[int]:
    """``frames`` of the numbers below ``total``, drawn without replacement by NumPy's legacy generator, sorted."""
    return sorted(int(i) for i in np.random.RandomState(seed).choice(total, min(frames, total), replace=False))


def picked_frames(df: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of some named frames."""
    return df.where(F.col("frame_idx").isin(ids))


def sequence_metrics(frames: DataFrame, by: str = "drive") -> DataFrame:
    """Second-level aggregates over frame metrics (num_points, range_mean, horizontal_fov, spatial_resolution_cm)."""
    n, r, s = F.col("num_points").cast("double"), F.col("range_mean"), F.col("spatial_resolution_cm")
    out = frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_frames"),
        *spread(n, "points", "mean", "std", "min", "max"),
        cv(F.stddev_pop(n), F.avg(n)).alias("points_cv"),
        *spread(r, "range", "mean", "std"),
        cv(F.stddev_pop(s), F.avg(s)).alias("resolution_cv"),
        F.every(F.col("horizontal_fov") > 355).alias("all_full_coverage"),
    )
    return out.withColumns(
        {
            "sufficient_density": flag(F.col("points_mean") > 50_000),
            "consistent_points": flag(F.col("points_cv") < 5),
            "consistent_resolution": flag(F.col("resolution_cv") < 20),
            "full_coverage": flag(F.col("all_full_coverage")),
        }
    ).drop("all_full_coverage")


def sector_plot(frames: DataFrame) -> DataFrame:
    """(drive, frame_idx, sector, points, pct): the sector panel of the frame figure."""
    names = list(SECTORS)
    pairs = ", ".join(f"'{s}', sector_{s}" for s in names)
    return frames.select(*FRAME, "num_points", F.expr(f"stack({len(names)}, {pairs}) as (sector, points)")).select(*FRAME, "sector", "points", F.try_divide(F.col("points") * 100.0, F.col("num_points")).alias("pct"))
