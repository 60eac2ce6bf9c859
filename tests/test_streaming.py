import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rigscope.operators import gpsimu
from rigscope.streaming import frames


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_lidar(spark, tmp_path):
    src = spark.range(100).selectExpr("'d' as drive", "timestamp_seconds(id / 50) as ts", "cast(id as double) as x", "0d as y", "0d as z")
    src.write.parquet(str(tmp_path / "p"))
    live = frames.live_lidar(spark.readStream.schema(src.schema).parquet(str(tmp_path / "p")))
    rows = drained(live, "live_lidar", "complete").orderBy("window").collect()
    assert [r["num_points"] for r in rows] == [50, 50] and rows[0]["range_mean"] == 24.5 and rows[0]["sector_front"] == 50


def test_live_trajectory(spark, tmp_path):
    g = np.random.default_rng(0)
    rows = [("d", i, 49 + float(g.random()) * 1e-3, 8 + float(g.random()) * 1e-3) for i in range(30)]
    src = spark.createDataFrame(rows, "drive string, frame_idx int, lat double, lon double")
    src.coalesce(1).write.parquet(str(tmp_path / "p"))
    live = frames.live_trajectory(spark.readStream.schema(src.schema).parquet(str(tmp_path / "p")))
    got = drained(live, "live_trajectory", "update").first()
    batch = gpsimu.segments(gpsimu.local_enu(src.selectExpr("*", "0d as alt"))).agg({"segment_m": "sum"}).first()[0]
    assert got["num_frames"] == 30 and abs(got["total_distance_m"] - batch) < 1e-6


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def packets(g):
    """Packets of three drives in order of arrival, at most 5 s late; one drive pauses for 20 minutes, one packet has no place."""
    rows = []
    for d in "abc":
        for i in range(60):
            t = 1_700_000_000.0 + i * 0.7 + (1_200 if d == "b" and i >= 30 else 0)
            rows.append((d, i, t, None if (d, i) == ("c", 17) else 49 + float(g.random()) * 1e-3, 8 + float(g.random()) * 1e-3, t + float(g.random()) * 5))
    rows.sort(key=lambda r: r[5])
    return pd.DataFrame([r[:5] for r in rows], columns=["drive", "frame_idx", "t", "lat", "lon"])


@pytest.mark.parametrize("parts", [1, 2, 6])
def test_live_segments_in_any_batches(spark, rocks, tmp_path, parts):
    g = np.random.default_rng(parts)
    p = packets(np.random.default_rng(0))
    end = pd.DataFrame([("end", 0, 1_700_100_000.0, 0.0, 0.0)], columns=p.columns)
    cuts = sorted(g.integers(1, len(p), parts - 1).tolist())
    for k, f in enumerate([*(p.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True)), end]):
        path = tmp_path / f"{k}.json"
        f.to_json(path, orient="records", lines=True, double_precision=15)
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    src = spark.readStream.schema("drive string, frame_idx int, t double, lat double, lon double").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    live = frames.live_segments(src.withColumn("ts", F.timestamp_seconds("t")))
    got = drained(live, f"live_segments_{parts}", "append").where("drive <> 'end'").toPandas().sort_values(["drive", "frame_idx"])
    whole = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "drive string, frame_idx int, t double, lat double, lon double")
    parts_of = whole.withColumn("name", F.col("drive")).withColumn("drive", F.concat("drive", (F.col("t") > 1_700_000_600).cast("string")))
    want = gpsimu.segments(gpsimu.local_enu(parts_of.withColumn("alt", F.lit(0.0)))).toPandas().sort_values(["name", "frame_idx"])
    assert len(got) == 180 and got["frame_idx"].tolist() == want["frame_idx"].tolist()
    for c in ("east", "north", "segment_m"):
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-6, equal_nan=True), c
    assert got.groupby("drive")["start_us"].nunique().to_dict() == {"a": 1, "b": 2, "c": 1}
    last = got.sort_values("time_us").groupby("drive").last()["total_distance_m"]
    assert np.isclose(last["a"], want[want["name"] == "a"]["segment_m"].sum())
