"""Live forms of the frame analyses, for Structured Streaming. An extension: batch forms are the reference for results.

Sources are streams with an event time; late rows are dropped by watermark. Frame metrics are windowed aggregates;
trajectories keep each drive's origin and last position as state. ``live_trajectory`` takes packets as they arrive;
``live_segments`` in the order of their times, whatever batches they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rigscope.operators import lidar
from rigscope.operators.gpsimu import METRES_A_DEGREE


def live_lidar(points: DataFrame, time: str = "ts", late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Point counts, range and reflectance metrics of each drive and time window."""
    p = lidar.with_geometry(points.withWatermark(time, late))
    return p.groupBy("drive", F.window(time, window)).agg(
        F.count(F.lit(1)).alias("num_points"),
        F.avg("dist").alias("range_mean"),
        F.stddev_pop("dist").alias("range_std"),
        *lidar.azimuth_coverage(),
        *lidar.range_distribution(),
    )


def live_intervals(ts: DataFrame, time: str = "ts", late: str = "10 seconds", window: str = "10 seconds") -> DataFrame:
    """Frames and mean interval of each sensor and time window."""
    span = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    n = F.count(F.lit(1))
    return ts.withWatermark(time, late).groupBy("drive", "sensor", F.window(time, window)).agg(n.alias("num_frames"), F.try_divide(span / 1e3, n - 1).alias("mean_interval_ms"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lat0, lon0, east, north, distance, n = state.get if state.exists else (None, None, None, None, 0.0, 0)
    packets = pd.concat(list(frames)).sort_values("frame_idx")
    lat, lon = packets["lat"].to_numpy(float), packets["lon"].to_numpy(float)
    if len(lat):
        if lat0 is None:
            lat0, lon0 = float(lat[0]), float(lon[0])
        e, m = (lon - lon0) * METRES_A_DEGREE * np.cos(np.radians(lat0)), (lat - lat0) * METRES_A_DEGREE
        path_e, path_m = (e, m) if east is None else (np.r_[east, e], np.r_[north, m])
        distance += float(np.hypot(np.diff(path_e), np.diff(path_m)).sum())
        east, north, n = float(e[-1]), float(m[-1]), n + len(lat)
    state.update((lat0, lon0, east, north, distance, n))
    yield pd.DataFrame({"drive": [key[0]], "num_frames": [n], "east": [east], "north": [north], "total_distance_m": [distance]})


def live_trajectory(packets: DataFrame) -> DataFrame:
    """After each batch: a drive's packets, position from its origin, and distance so far."""
    return packets.groupBy("drive").applyInPandasWithState(
        _advance,
        "drive string, num_frames bigint, east double, north double, total_distance_m double",
        "lat0 double, lon0 double, east double, north double, distance double, n bigint",
        "update",
        GroupStateTimeout.NoTimeout,
    )


SEGMENTS = "drive string, frame_idx bigint, start_us bigint, time_us bigint, east double, north double, segment_m double, total_distance_m double"


class _Segments(StatefulProcessor):
    """A drive's packets wait until the watermark has passed them; then they are placed in order of time.

    State: origin and last position, and the packets that wait (those of the allowed lateness). A timer wakes the drive
    for the first of them, or, if none waits, to forget a drive that has been silent for ``idle``.
    """

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "lat0 double, lon0 double, start bigint, us bigint, east double, north double, distance double")
        self.waiting = handle.getListState("waiting", "us bigint, frame_idx bigint, lat double, lon double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [p for f in rows for p in zip(f["us"].tolist(), f["frame_idx"].tolist(), f["lat"].astype(float).tolist(), f["lon"].astype(float).tolist(), strict=True)]
        yield from self._place(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._place(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _place(self, key, new: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        held = [*(tuple(p) for p in self.waiting.get()), *new] if self.waiting.exists() else new
        due, later, out = sorted(p for p in held if p[0] <= passed), [p for p in held if p[0] > passed], []
        last = tuple(np.nan if x is None else x for x in self.last.get()) if self.last.exists() else None
        for us, frame, lat, lon in due:
            if last is None or us - last[3] > self.idle:
                last = lat, lon, us, us, np.nan, np.nan, 0.0
            lat0, lon0, start, _, east, north, distance = last
            e, n = (lon - lon0) * METRES_A_DEGREE * np.cos(np.radians(lat0)), (lat - lat0) * METRES_A_DEGREE
            step = float(np.sqrt((e - east) ** 2 + (n - north) ** 2))
            distance += 0.0 if np.isnan(step) else step
            last = lat0, lon0, start, us, float(e), float(n), distance
            out.append((key[0], frame, start, us, float(e), float(n), step, distance))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-min(later)[0] // 1000))
        else:
            self.waiting.clear()
        if last is not None and not later:
            if last[3] + self.idle <= passed:
                last = None
            else:
                self.handle.registerTimer(-(-(last[3] + self.idle) // 1000))
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
        if out:
            yield pd.DataFrame(out, columns=["drive", "frame_idx", "start_us", "time_us", "east", "north", "segment_m", "total_distance_m"])


def live_segments(packets: DataFrame, time: str = "ts", late: str = "10 seconds", idle_seconds: float = 600.0) -> DataFrame:
    """Each packet (drive, frame_idx, time, lat, lon) with its place from the drive's origin and its distance from the
    packet before in time (ties by frame), once the watermark has passed it: the same rows however packets are batched.

    A drive silent for more than ``idle_seconds`` starts anew (``start_us`` tells its recordings apart) and leaves no
    state. Packets later than ``late`` are dropped, those without a time take no part; without a position, ``east``,
    ``north`` and the distances to and from it are null. Needs the RocksDB state store.
    """
    p = packets.where(F.col(time).isNotNull()).withWatermark(time, late)
    p = p.select("drive", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.unix_micros(time).alias("us"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(time).alias("_time"))
    return p.groupBy("drive").transformWithStateInPandas(_Segments(int(idle_seconds * 1e6)), SEGMENTS, "Append", "EventTime")
