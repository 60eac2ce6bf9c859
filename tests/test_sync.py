import random

from rigscope.operators import sync
from rigscope.sources import drives

SCHEMA = "drive string, sensor string, frame_idx int, ts_raw string, ts_ns bigint"


def test_short_stream_and_single_frame(spark):
    ms = 1_000_000
    rows = [("d", "lidar", i, "t", i * 100 * ms) for i in range(4)] + [("d", "cam", i, "t", i * 100 * ms + i * ms) for i in range(3)] + [("d", "gps", 0, "t", 5 * ms)]
    ts = spark.createDataFrame(rows, SCHEMA)
    assert {r["sensor"]: r["missing"] for r in sync.completeness(ts).collect()} == {"lidar": 0, "cam": 1, "gps": 3}
    assert sync.aligned(ts).count() == 12
    stats = {r["sensor"]: r for r in sync.offset_stats(ts, "lidar").collect()}
    assert stats["cam"]["mean_offset_ms"] == 1 and stats["cam"]["drift_ms"] == 2 and stats["cam"]["std_offset_ms"] == 1
    assert stats["gps"]["std_offset_ms"] is None
    q = sync.sync_quality(ts, "lidar").first()
    assert q["max_jitter_ms"] == 1 and q["grade"] == "Excellent" and not q["complete"] and q["missing_total"] == 4
    rate = {r["sensor"]: r for r in sync.frame_rates(ts).collect()}
    assert rate["lidar"]["frame_rate_hz"] == 10 and rate["lidar"]["std_interval_ms"] == 0 and rate["gps"]["frame_rate_hz"] == 0


def test_only_single_frames_have_no_jitter(spark):
    ts = spark.createDataFrame([("d", "lidar", 0, "t", 0), ("d", "cam", 0, "t", 9)], SCHEMA)
    assert sync.sync_quality(ts, "lidar").first()["max_jitter_ms"] == 0


def test_lines(spark):
    text = "2011-09-26 13:02:25.594360375\n\n2011-09-26 13:02:26\nnot a time\n"
    rows = drives.timestamp_lines(spark.createDataFrame([("d", "lidar", text)], "drive string, sensor string, value string")).orderBy("frame_idx").collect()
    assert [r["ts_ns"] for r in rows] == [1317042145594360375, None, 1317042146000000000, None]
    assert rows[1]["ts_raw"] == "" and len(rows) == 4
    ts = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    assert sync.completeness(ts).first()["missing"] == 0  # a blank line is no missing one


def test_summary_of_short_first_sensor(spark):
    ts = spark.createDataFrame([("d", "a", 0, "t", 0), ("d", "b", 0, "t", 0), ("d", "b", 1, "t", 10**9)], SCHEMA)
    assert sync.summary(ts, "b", "a").first()["duration_sec"] is None
    assert sync.summary(ts, "b", "b").first()["duration_sec"] == 1


def test_blocks_carry_what_windows_see(spark):
    g = random.Random(0)
    rows = [(d, s, i, "t", None if g.random() < 0.1 else i * 1000 + g.randrange(50)) for d in "ab" for s in ("x", "y") for i in range(300) if g.random() < 0.4 or i > 280] + [("c", "x", 7, "t", 1)]
    ts = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(sync.intervals(ts))
    for block in (1, 7, 64, 1 << 16):
        got = sync.intervals_in_blocks(ts, block)
        assert got.columns == sync.intervals(ts).columns and key(got) == want
    assert sync.intervals_in_blocks(ts.where("false")).count() == 0
