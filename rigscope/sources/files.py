"""Point clouds and reports as Python data sources: pruned reads, and writes that are seen as a whole or not at all.

``pointcloud`` reads and writes <path>/<drive>/velodyne_points/data/%010d.bin (float32 quadruples) as rows (drive,
frame_idx, point_idx, x, y, z, reflectance). Drives and frames are chosen in the listing, by options or by pushed
filters, so files out of a range are never opened; partitions are stretches of a drive's frames of about
``bytesAPartition``, and only their bounds are kept on the driver. ``drivejson`` writes a row as <path>/<name>.json.

Filters are pushed with the option ``push`` in a session that sets ``spark.sql.python.filterPushdown.enabled``. Spark keeps what was pushed
with the loaded relation, also for its next query, so each query must load one of its own; options have no such snare.

Writers put files under a staging folder, each task attempt under its own; the commit moves those that the successful
attempts name to their places and deletes the rest, and a failed job deletes all. A file that a path has already is
replaced. Paths are URIs of any file system that Arrow knows, or local ones.

Cases: a null drive or frame, and a report's name that is null, repeated or not a plain file name, fail the job; an empty
table writes no file; a file whose length isn't a multiple of 16 bytes fails the read; folders without clouds give no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

CLOUD = "drive string, frame_idx int, point_idx bigint, x float, y float, z float, reflectance float"
FOLDER = "velodyne_points/data"
NAME = re.compile(r"(\d{10})\.bin")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


def listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


@dataclass
class Frames(InputPartition):
    """Frames ``first`` to ``last`` of a drive."""

    drive: str
    first: int
    last: int


@dataclass
class Bounds:
    """What pushed filters leave: drives (None: all) and frames in a closed range, of a set if one is named."""

    drives: set[str] | None = None
    least: float = float("-inf")
    most: float = float("inf")
    frames: set[int] | None = None

    def take(self, f: Filter) -> bool:
        """Narrows the bounds by a filter; whether that says all that the filter says."""
        column = getattr(f, "attribute", None)
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if column == ("drive",) and values is not None:
            self.drives = values if self.drives is None else self.drives & values
        elif column == ("frame_idx",) and values is not None:
            self.frames = values if self.frames is None else self.frames & values
        elif column == ("frame_idx",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, f.value + isinstance(f, GreaterThan))
        elif column == ("frame_idx",) and isinstance(f, (LessThan, LessThanOrEqual)):
            self.most = min(self.most, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def holds(self, frame: int) -> bool:
        return self.least <= frame <= self.most and (self.frames is None or frame in self.frames)


class CloudReader(DataSourceReader):
    def __init__(self, path: str, most: int, bounds: Bounds | None = None):
        self.path, self.most, self.bounds = path.rstrip("/"), most, bounds or Bounds()

    def frames(self, fs: pafs.FileSystem, root: str, drive: str) -> list[tuple[int, int]]:
        """(frame, bytes) of a drive's files within bounds, from their names alone."""
        found = ((NAME.fullmatch(i.base_name), i.size) for i in listed(fs, f"{root}/{drive}/{FOLDER}"))
        return sorted((int(m[1]), size or 0) for m, size in found if m and self.bounds.holds(int(m[1])))

    def partitions(self) -> list[Frames]:
        fs, root = opened(self.path)
        drives = self.bounds.drives
        if drives is None:
            drives = {i.base_name for i in listed(fs, root) if i.type == pafs.FileType.Directory and not i.base_name.startswith("_")}
        out: list[Frames] = []
        for drive in sorted(drives):
            held = 0
            for frame, size in self.frames(fs, root, drive):
                if not out or out[-1].drive != drive or held + size > self.most:
                    out.append(Frames(drive, frame, frame))
                    held = 0
                out[-1].last, held = frame, held + size
        return out or [Frames("", 0, -1)]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        names = [c.split(" ")[0] for c in CLOUD.split(", ")]
        for frame, _ in self.frames(fs, root, part.drive) if part.first <= part.last else []:
            if part.first <= frame <= part.last:
                with fs.open_input_stream(f"{root}/{part.drive}/{FOLDER}/{frame:010d}.bin") as f:
                    raw = f.read()
                if len(raw) % 16:
                    raise ValueError(f"{part.drive}, frame {frame}: {len(raw)} bytes aren't float32 quadruples")
                p = np.frombuffer(raw, "<f4").reshape(-1, 4)
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([part.drive] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], names=names)


class PushedCloudReader(CloudReader):
    """Takes bounds from the filters that Spark pushes."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.take(f)]


@dataclass
class Staged(WriterCommitMessage):
    """(staged, final) paths of what an attempt wrote, within the target folder."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Staging:
    """Writes files aside and moves them into place when the whole job has succeeded."""

    def __init__(self, path: str):
        self.path, self.folder = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def put(self, files: Iterable[tuple[str, bytes]]) -> Staged:
        fs, root = opened(self.path)
        attempt, done = f"{self.folder}/{uuid.uuid4().hex}", Staged()
        for name, data in files:
            at = f"{attempt}/{name}"
            fs.create_dir(f"{root}/{at}".rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{root}/{at}") as f:
                f.write(data)
            done.files.append((at, name))
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows for one file")
        fs.create_dir(root, recursive=True)
        for folder in {name.rpartition("/")[0] for _, name in files} - {""}:
            fs.create_dir(f"{root}/{folder}", recursive=True)
        for at, name in files:
            if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/{name}")
            fs.move(f"{root}/{at}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/{self.folder}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.folder}")


class CloudWriter(Staging, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.put(self.frames(iterator))

    def frames(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """(name, content) of each frame; a frame's rows follow one another."""
        key, held = None, []
        name = lambda k: f"{k[0]}/{FOLDER}/{k[1]:010d}.bin"
        for batch in batches:
            drive, frame = batch.column("drive"), batch.column("frame_idx")
            if drive.null_count or frame.null_count:
                raise ValueError("a point without drive or frame")
            code, number = drive.dictionary_encode(), frame.to_numpy()
            index = code.indices.to_numpy()
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in ("x", "y", "z", "reflectance")], axis=1)
            edges = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (number[1:] != number[:-1])]) if len(p) else []
            for a, b in zip(edges, [*edges[1:], len(p)], strict=True):
                now = drive[int(a)].as_py(), int(number[a])
                if now != key and held:
                    yield name(key), b"".join(held)
                    held = []
                key = now
                held.append(p[a:b].tobytes())
        if held:
            yield name(key), b"".join(held)


class PointClouds(DataSource):
    """Options: path, bytesAPartition (64 MiB), drives (comma-separated), start and end (closed-open frame range), push."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema: StructType) -> CloudReader:
        get = self.options.get
        bounds = Bounds(set(get("drives").split(",")) if get("drives") else None, float(get("start", "-inf")), float(get("end", "inf")) - 1)
        kind = PushedCloudReader if get("push") else CloudReader
        return kind(self.options["path"], int(get("bytesAPartition", 64 << 20)), bounds)

    def writer(self, schema: StructType, overwrite: bool) -> CloudWriter:
        return CloudWriter(self.options["path"])


class ReportWriter(Staging, DataSourceWriter):
    def __init__(self, path: str, key: str):
        super().__init__(path)
        self.key = key

    def write(self, iterator) -> Staged:
        return self.put(map(self.file, iterator))

    def file(self, row) -> tuple[str, bytes]:
        name = row[self.key]
        if name is None or not re.fullmatch(r"[^/\\]*[^/\\.][^/\\]*", str(name)):
            raise ValueError(f"no file can have the name {name!r}")
        return f"{name}.json", json.dumps(row.asDict(recursive=True), indent=2, default=str).encode()


class DriveReports(DataSource):
    """Options: path, and key, the column that names the files (drive)."""

    @classmethod
    def name(cls) -> str:
        return "drivejson"

    def schema(self) -> str:
        raise ValueError("drivejson is for writing; spark.read.json with multiLine reads its files")

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], self.options.get("key", "drive"))


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources."""
    for source in (PointClouds, DriveReports):
        spark.dataSource.register(source)
    return spark


def write_clouds(points: DataFrame, path: str, order: str = "point_idx") -> None:
    """Writes points (drive, frame_idx, x, y, z, reflectance) as a file a frame, each in one task, in the given order."""
    rows = points.repartition("drive", "frame_idx").sortWithinPartitions("drive", "frame_idx", order)
    rows = rows.selectExpr("drive", "frame_idx", f"cast({order} as bigint) as point_idx", *(f"cast({c} as float) as {c}" for c in ("x", "y", "z", "reflectance")))
    registered(points.sparkSession)
    rows.write.format("pointcloud").mode("append").save(path)


def read_clouds(spark: SparkSession, path: str, **options) -> DataFrame:
    """A relation of its own for each call; options as ``PointClouds`` names them."""
    return registered(spark).read.format("pointcloud").options(**options).load(path)


def write_reports(rows: DataFrame, path: str, key: str = "drive") -> None:
    """Writes each row as a JSON file named by its ``key``."""
    registered(rows.sparkSession)
    rows.write.format("drivejson").option("key", key).mode("append").save(path)


def read_reports(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
