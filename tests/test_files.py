import json
import os
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from rigscope.session import share_code
from rigscope.sources import files


@pytest.fixture
def clouds(tmp_path):
    g = np.random.default_rng(0)
    out = {}
    for drive in ("a", "b"):
        for i in range(6):
            p = tmp_path / drive / files.FOLDER / f"{i:010d}.bin"
            p.parent.mkdir(parents=True, exist_ok=True)
            out[drive, i] = g.normal(size=(i + 3, 4)).astype("<f4")
            p.write_bytes(out[drive, i].tobytes())
    return tmp_path, out


def test_files_out_of_a_range_are_never_opened(spark, clouds):
    path, _ = clouds
    for i in (0, 1, 4, 5):
        (path / "a" / files.FOLDER / f"{i:010d}.bin").write_bytes(b"broken")
    (path / "b" / files.FOLDER / "notes.txt").write_text("no cloud")
    load = lambda **o: files.read_clouds(share_code(spark), str(path), **o)
    assert sorted(map(tuple, load(drives="a", start=2, end=4).groupBy("frame_idx").count().collect())) == [(2, 5), (3, 6)]
    with pytest.raises(Exception, match="quadruples"):
        load().count()
    assert load(drives="b", start=5).where("x > -100").count() == 8
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = load(push=True).where("drive = 'a' and frame_idx >= 2 and frame_idx < 4").groupBy("frame_idx").count().collect()
        assert sorted(map(tuple, got)) == [(2, 5), (3, 6)]
        assert load(push=True).where("drive in ('b') and frame_idx = 5 and x > -100").count() == 8
        with pytest.raises(Exception, match="quadruples"):
            load(push=True).where("drive = 'a' and x > -100").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_opened_are_counted(clouds, monkeypatch):
    path, want = clouds
    reader, count = files.PushedCloudReader(str(path), 200), []
    rest = reader.pushFilters([In(("drive",), ("b", "c")), GreaterThanOrEqual(("frame_idx",), 1), LessThan(("frame_idx",), 5), StringContains(("drive",), "b"), EqualTo(("x",), 1.0)])
    assert rest == [StringContains(("drive",), "b"), EqualTo(("x",), 1.0)]
    parts = reader.partitions()
    assert [(p.drive, p.first, p.last) for p in parts] == [("b", 1, 2), ("b", 3, 3), ("b", 4, 4)]  # 64 + 80, 96, 112 bytes

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "open_input_stream":
                count.append(1)
            return getattr(self.fs, name)

    opened = files.opened
    monkeypatch.setattr(files, "opened", lambda p: (Counting(opened(p)[0]), opened(p)[1]))
    rows = [b for p in parts for b in reader.read(p)]
    assert len(count) == 4 and [b.num_rows for b in rows] == [len(want["b", i]) for i in range(1, 5)]


def test_clouds_round_trip(spark, clouds, tmp_path):
    path, want = clouds
    out = str(tmp_path / "copy")
    files.write_clouds(files.read_clouds(share_code(spark), str(path), bytesAPartition="100"), f"file://{out}")
    assert {(p.parts[-4], int(p.stem)): p.read_bytes() for p in Path(out).rglob("*.bin")} == {k: v.tobytes() for k, v in want.items()}
    assert not [p for p in os.listdir(out) if p.startswith("_")]
    files.write_clouds(files.read_clouds(spark, str(path)).where("false"), str(tmp_path / "none"))
    assert files.read_clouds(spark, str(tmp_path / "none")).count() == 0


def test_failed_jobs_leave_nothing(spark, tmp_path):
    out = tmp_path / "reports"
    rows = share_code(spark).range(40).select(F.concat(F.lit("d"), "id").alias("drive"), "id")
    bad = rows.withColumn("drive", F.when(F.col("id") < 39, F.col("drive")))
    for df in (bad, rows.withColumn("drive", F.lit("same")), rows.withColumn("drive", F.lit("../up"))):
        with pytest.raises(Exception, match="name|two rows"):
            files.write_reports(df.repartition(4), str(out))
        assert not out.exists() or not os.listdir(out)
    files.write_reports(rows, str(out))
    assert len(os.listdir(out)) == 40 and json.loads((out / "d7.json").read_text()) == {"drive": "d7", "id": 7}
    files.write_reports(rows.withColumn("id", F.col("id") + 1), str(out))  # replaces
    assert sorted(map(tuple, files.read_reports(spark, str(out), rows.schema).collect())) == sorted((f"d{i}", i + 1) for i in range(40))


def test_attempts_that_failed_are_left_out(tmp_path):
    w = files.ReportWriter(str(tmp_path), "drive")
    lost, kept = (w.put([("x.json", b)]) for b in (b"lost", b"kept"))
    w.commit([kept, None])
    assert (tmp_path / "x.json").read_bytes() == b"kept" and os.listdir(tmp_path) == ["x.json"] and lost.files
    assert uuid.UUID(w.folder.rpartition("-")[2])
