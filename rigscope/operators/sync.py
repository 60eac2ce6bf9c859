"""Clock synchronisation of sensor streams.

Streams are rows (drive, sensor, frame_idx, ts_raw, ts_ns): line n of a sensor is frame n, and streams are aligned by
that ordinal, never by time. A missing line is a null ts_raw; a blank line has text but no time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.functions.blocks import carried

STREAM = ["drive", "sensor"]


def aligned(ts: DataFrame) -> DataFrame:
    """Every sensor of a drive over all of the drive's frames: short streams are padded with nulls."""
    spans = ts.groupBy("drive").agg(F.max("frame_idx").alias("last"), F.collect_set("sensor").alias("sensors"))
    spine = spans.select("drive", "last", F.explode("sensors").alias("sensor")).select("drive", "sensor", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame_idx"))
    return spine.join(ts, [*STREAM, "frame_idx"], "left")


def completeness(ts: DataFrame) -> DataFrame:
    """(drive, sensor, frames, missing): missing lines against the drive's longest stream.

    The spine need not be built for that: what a sensor lacks is the drive's length less its lines.
    """
    longest = W.partitionBy("drive")
    per = ts.groupBy(*STREAM).agg(F.count("ts_raw").alias("present"), (F.max("frame_idx") + 1).alias("n"))
    return per.withColumn("frames", F.max("n").over(longest).cast("long")).select(*STREAM, "frames", (F.col("frames") - F.col("present")).alias("missing"))


def intervals(ts: DataFrame) -> DataFrame:
    """Adds elapsed_s since the stream's first frame, and interval_ns and interval_s to the frame before; null next to missing times."""
    w = W.partitionBy(*STREAM).orderBy("frame_idx")
    t = F.col("ts_ns")
    apart = t - F.lag(t).over(w)
    return ts.withColumns({"elapsed_s": (t - F.first(t).over(w)) / 1e9, "interval_ns": apart, "interval_s": apart / 1e9})


def intervals_in_blocks(ts: DataFrame, block: int = 1 << 16) -> DataFrame:
    """As ``intervals``, for streams too long for one task: blocks of frames, with edge rows carried between them."""
    t = F.col("ts_ns")
    rows, apart = carried(ts, STREAM, "frame_idx", ["ts_ns"], block), t - F.col("previous_ts_ns")
    return rows.select(*ts.columns, ((t - F.col("first_ts_ns")) / 1e9).alias("elapsed_s"), apart.alias("interval_ns"), (apart / 1e9).alias("interval_s"))


def frame_rates(ts: DataFrame) -> DataFrame:
    """Interval statistics (sample deviation, milliseconds) and frame rate of each stream, from sums of whole nanoseconds."""
    return intervals(ts).groupBy(*STREAM).agg(*_rates())


def _rates() -> list:
    i = F.col("interval_ns")
    whole, n = F.sum(i), F.count(i)
    return [
        F.count("ts_raw").alias("num_frames"),
        F.try_divide(whole, n * 1e6).alias("mean_interval_ms"),
        (F.stddev_samp(i) / 1e6).alias("std_interval_ms"),
        (F.min(i) / 1e6).alias("min_interval_ms"),
        (F.max(i) / 1e6).alias("max_interval_ms"),
        F.when(whole > 0, n * 1e9 / whole).otherwise(F.lit(0.0)).alias("frame_rate_hz"),
    ]


def synthetic_time(rate_hz: float = 10.0):
    """Seconds since frame 0 of a sensor without a clock of its own."""
    return F.col("frame_idx") / rate_hz


def offsets(ts: DataFrame, reference: str) -> DataFrame:
    """(drive, sensor, frame_idx, offset_ms) of every other sensor against the reference's frame of the same number.

    One window over (drive, frame_idx) carries the reference's time to its peers: one shuffle, no join.
    """
    w = W.partitionBy("drive", "frame_idx")
    ref = F.max(F.when(F.col("sensor") == reference, F.col("ts_ns"))).over(w)
    return ts.withColumn("offset_ms", (F.col("ts_ns") - ref) / 1e6).where(F.col("sensor") != reference).select(*STREAM, "frame_idx", "offset_ms")


def offset_stats(ts: DataFrame, reference: str) -> DataFrame:
    """Mean and sample deviation of the offsets, and drift: the last known offset less the first."""
    return offsets(ts, reference).groupBy(*STREAM).agg(*_offsets())


def _offsets() -> list:
    o, known = F.col("offset_ms"), F.when(F.col("offset_ms").isNotNull(), F.col("frame_idx"))
    return [F.avg(o).alias("mean_offset_ms"), F.stddev_samp(o).alias("std_offset_ms"), (F.max_by(o, known) - F.min_by(o, known)).alias("drift_ms")]


def streams(ts: DataFrame, reference: str) -> DataFrame:
    """What ``frame_rates``, ``completeness`` and ``offset_stats`` say of each stream, in a row: one scan, one aggregate.

    ``offset_stats`` has no row of the reference; here its offsets are null. ``last_frame`` and ``last_elapsed_s`` are
    the stream's last frame and its time since the first.
    """
    w = W.partitionBy("drive", "frame_idx")
    ref = F.max(F.when(F.col("sensor") == reference, F.col("ts_ns"))).over(w)
    rows = intervals(ts).withColumn("offset_ms", F.when(F.col("sensor") != reference, (F.col("ts_ns") - ref) / 1e6))
    last = [F.max("frame_idx").alias("last_frame"), F.max_by("elapsed_s", "frame_idx").alias("last_elapsed_s")]
    per = rows.groupBy(*STREAM).agg(*_rates(), *_offsets(), *last)
    longest = F.max("last_frame").over(W.partitionBy("drive")) + 1
    return per.withColumn("frames", longest.cast("long")).withColumn("missing", F.col("frames") - F.col("num_frames"))


def _jitter() -> list:
    return [F.coalesce(F.greatest(F.max("std_offset_ms"), F.lit(0.0)), F.lit(0.0)).alias("max_jitter_ms"), F.max(F.abs("drift_ms")).alias("max_drift_ms"), F.sum("missing").alias("missing_total")]


def sync_quality(ts: DataFrame, reference: str) -> DataFrame:
    """Per drive: jitter (largest offset deviation, at least 0), largest drift, missing frames, grade."""
    return graded(streams(ts, reference).groupBy("drive").agg(*_jitter()).select("drive", "missing_total", "max_jitter_ms", "max_drift_ms"))


def graded(df: DataFrame) -> DataFrame:
    j = F.col("max_jitter_ms")
    return df.withColumns({"grade": F.when(j < 2, "Excellent").when(j < 5, "Good").otherwise("High"), "complete": F.col("missing_total") == 0})


def summary(ts: DataFrame, reference: str, first_sensor: str, nudge: float = 0.0) -> DataFrame:
    """One row a drive: sensors, frames, duration of the first-loaded sensor (null if its stream is short), quality.

    Times are rounded to two decimals; ``nudge`` is added before, to settle exact halves.
    """
    two = lambda c: F.round(F.col(c) + nudge, 2).alias(c)
    whole = F.when((F.col("sensor") == first_sensor) & (F.col("last_frame") + 1 == F.col("frames")), F.col("last_elapsed_s"))
    per = streams(ts, reference).groupBy("drive").agg(F.count(F.lit(1)).alias("num_sensors"), F.max("frames").alias("num_frames"), F.max(whole).alias("duration_sec"), *_jitter())
    return graded(per).select("drive", "num_sensors", "num_frames", two("duration_sec"), two("max_jitter_ms"), two("max_drift_ms"), "missing_total", "grade", "complete")


def report(ts: DataFrame, reference: str) -> DataFrame:
    """One row a drive: quality, and an array of each sensor's rate, gaps and offsets, rounded to two decimals."""
    two = lambda c: F.round(c, 2).alias(c)
    one = F.struct("sensor", "num_frames", "missing", *(two(c) for c in ("mean_interval_ms", "std_interval_ms", "min_interval_ms", "max_interval_ms", "frame_rate_hz", "mean_offset_ms", "std_offset_ms", "drift_ms")))
    per = streams(ts, reference).groupBy("drive").agg(F.sort_array(F.collect_list(one)).alias("sensors"), *_jitter())
    return graded(per).select("drive", "sensors", "missing_total", "max_jitter_ms", "max_drift_ms", "grade", "complete")
