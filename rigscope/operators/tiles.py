"""Image metrics by tiles, for images that no task can hold: the results of the whole-image kernels.

An image is a relation of gray tiles (drive, camera_id, frame_idx, height, width, ty, tx, data): ``side`` x ``side`` pixels
row by row, less at the lower and right end of the image of height x width. Tiles send their rims to the tiles around
them, so each sees ``HALO`` pixels beyond its own; what a kernel says of a tile's own pixels is then what it says of the
whole image. Edges that grow from strong pixels along weak ones cross tiles: pieces of edge are nodes, linked where
pixels touch over a border, and strength spreads over the links by rounds, one border a round.

Cases: an image of one row, column or pixel works as in the whole-image kernels; tiles without data are left out, and
images without tiles have no row. Repeated tiles are an error of the source and count twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.functions import kernels as kn
from rigscope.session import spread_by

IMAGE = ["drive", "camera_id", "frame_idx"]
HALO = 4  # circle of the corners and their neighbours
_KEY = "drive string, camera_id string, frame_idx int, height int, width int, ty int, tx int"
_KEYS = [*IMAGE, "height", "width", "ty", "tx"]
_PLACES = [("height", pa.int32()), ("width", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32())]
_NAMES = [("drive", pa.string()), ("camera_id", pa.string()), ("frame_idx", pa.int32())]
_PIECE = pa.struct([("node", pa.int64()), ("strong", pa.bool_()), ("pixels", pa.int64()), ("rim", pa.list_(pa.int64()))])
_TILE = pa.schema([*_NAMES, *_PLACES, ("n", pa.int64()), ("lap", pa.int64()), ("lap2", pa.int64()), ("corners", pa.int64()), ("pieces", pa.list_(_PIECE))])
_RIM = pa.schema([*_NAMES, *_PLACES, ("y", pa.int32()), ("x", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("part", pa.binary())])


def split(images: DataFrame, side: int) -> DataFrame:
    """Tiles of images that fit a task (drive, camera_id, frame_idx, height, width, data in gray)."""

    def run(batches):
        schema = pa.schema([*_NAMES, *_PLACES, ("data", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(5)[i].as_buffer()
                if raw is None:
                    continue
                h, w = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                img = np.frombuffer(raw, np.uint8).reshape(h, w)
                rows = [(y, x, img[y * side : (y + 1) * side, x * side : (x + 1) * side].tobytes()) for y in range(-(-h // side)) for x in range(-(-w // side))]
                key = [batch.column(k).take(pa.array(np.full(len(rows), i))) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], schema=schema)

    return images.select(*IMAGE, "height", "width", "data").mapInArrow(run, f"{_KEY}, data binary")


def with_halos(tiles: DataFrame, side: int, halo: int = HALO) -> DataFrame:
    """Each tile with its surroundings: parts (y, x, h, w, part) of its own and the tiles around, in the image's pixels."""
    if side < halo:
        raise ValueError(f"tiles of {side} pixels can't give {halo} pixels to their neighbours")

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                h, w, ty, tx = (batch.column(k)[i].as_py() for k in range(3, 7))
                raw = batch.column(7)[i].as_buffer()
                if raw is None:
                    continue
                y0, x0 = ty * side, tx * side
                y1, x1 = min(h, y0 + side), min(w, x0 + side)
                img = np.frombuffer(raw, np.uint8).reshape(y1 - y0, x1 - x0)
                for v in range(max(0, ty - 1), min(-(-h // side), ty + 2)):
                    for u in range(max(0, tx - 1), min(-(-w // side), tx + 2)):
                        a, b = max(y0, v * side - halo), min(y1, (v + 1) * side + halo)
                        c, d = max(x0, u * side - halo), min(x1, (u + 1) * side + halo)
                        rows.append((i, v, u, a, c, b - a, d - c, img[a - y0 : b - y0, c - x0 : d - x0].tobytes()))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), *(pa.array([r[k] for r in rows], pa.binary() if k == 7 else pa.int32()) for k in range(1, 8))], schema=_RIM)

    rims = tiles.select(*_KEYS, "data").mapInArrow(run, f"{_KEY}, y int, x int, h int, w int, part binary")
    return spread_by(rims, *_KEYS).groupBy(*_KEYS).agg(F.collect_list(F.struct("y", "x", "h", "w", "part")).alias("parts"))  # nine at most


def pieces_of(peak: np.ndarray) -> np.ndarray:
    """For each marked pixel, in order, the number of the first pixel of its piece (8-connected)."""
    number = np.where(peak, np.cumsum(peak).reshape(peak.shape) - 1, -1)
    p = np.pad(number, 1, constant_values=-1)
    h, w = peak.shape
    beside = [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    both = [(number >= 0) & (s >= 0) for s in beside]
    a = np.concatenate([number[m] for m in both])
    b = np.concatenate([s[m] for s, m in zip(beside, both, strict=True)])
    root = np.arange(int(peak.sum()))
    while (root[a] != root[b]).any():
        u, v = root[a], root[b]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != root[root]).any():
            root = root[root]
    return root


def _measured(parts: list[dict], height: int, width: int, ty: int, tx: int, side: int, low: float, high: float) -> tuple | None:
    y0, x0 = min(p["y"] for p in parts), min(p["x"] for p in parts)
    y1, x1 = max(p["y"] + p["h"] for p in parts), max(p["x"] + p["w"] for p in parts)
    img = np.zeros((y1 - y0, x1 - x0), np.uint8)
    for p in parts:
        img[p["y"] - y0 : p["y"] - y0 + p["h"], p["x"] - x0 : p["x"] - x0 + p["w"]] = np.frombuffer(p["part"], np.uint8).reshape(p["h"], p["w"])
    top, left = ty * side, tx * side
    own = slice(top - y0, min(height, top + side) - y0), slice(left - x0, min(width, left + side) - x0)
    lap = kn.laplacian(img)[own].astype(np.int64)
    corners = kn.fast(img)
    inside = (corners[:, 0] >= own[0].start) & (corners[:, 0] < own[0].stop) & (corners[:, 1] >= own[1].start) & (corners[:, 1] < own[1].stop)
    peak, mag = (v[own] for v in kn.edge_peaks(img, low))
    found = []
    if peak.any():
        root = pieces_of(peak)
        y, x = np.nonzero(peak)
        place = (y + top) * np.int64(width) + x + left
        rim = (y == 0) | (x == 0) | (y == peak.shape[0] - 1) | (x == peak.shape[1] - 1)
        strong = np.zeros(len(root), bool)
        np.logical_or.at(strong, root, mag[y, x] > high)
        size = np.bincount(root, minlength=len(root))
        order = np.argsort(root[rim], kind="stable")
        edge, owner = place[rim][order], root[rim][order]
        for k in np.unique(root).tolist():
            lo, hi = np.searchsorted(owner, [k, k + 1])
            if strong[k] or lo < hi:  # weak pieces that touch no other tile stay weak
                found.append({"node": int(place[k]), "strong": bool(strong[k]), "pixels": int(size[k]), "rim": edge[lo:hi].tolist()})
    return lap.size, int(lap.sum()), int((lap * lap).sum()), int(inside.sum()), found


def tile_metrics(tiles: DataFrame, side: int, low: float = 50, high: float = 150) -> DataFrame:
    """Of each tile: pixels, sums of the Laplacian and its square, corners, and pieces of edge with their rim pixels."""

    def run(batches):
        for batch in batches:
            rows = [_measured(batch.column(7)[i].as_py(), *(batch.column(k)[i].as_py() for k in range(3, 7)), side, low, high) for i in range(batch.num_rows)]
            made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(_TILE)[7:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), *made], schema=_TILE)

    schema = f"{_KEY}, n bigint, lap bigint, lap2 bigint, corners bigint, pieces array<struct<node: bigint, strong: boolean, pixels: bigint, rim: array<bigint>>>"
    return with_halos(tiles, side).mapInArrow(run, schema)


def grown(pieces: DataFrame) -> DataFrame:
    """The weak pieces (image, node, pixels) that strong ones reach over borders of tiles."""
    rim = pieces.select(*IMAGE, "width", "node", "strong", "pixels", F.explode("rim").alias("place"))
    y, x = F.expr("place div width"), F.col("place") % F.col("width")
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    beside = rim.withColumn("s", F.explode(steps)).select(*IMAGE, F.col("node").alias("from"), F.col("strong").alias("lit"), (y + F.col("s.dy")).alias("y"), (x + F.col("s.dx")).alias("x"))
    weak = rim.where("not strong").select(*IMAGE, "node", "pixels", y.alias("y"), x.alias("x"))
    links = beside.join(weak, [*IMAGE, "y", "x"]).where("`from` <> node").select(*IMAGE, "from", "lit", "node", "pixels").distinct().checkpoint()
    reached = front = links.where("lit").select(*IMAGE, "node", "pixels").distinct().checkpoint()
    while not front.isEmpty():
        onward = links.join(front.select(*IMAGE, F.col("node").alias("from")), [*IMAGE, "from"]).select(*IMAGE, "node", "pixels").distinct()
        front = onward.join(reached.select(*IMAGE, "node"), [*IMAGE, "node"], "left_anti").checkpoint()
        reached = reached.union(front)
    return reached


def frame_metrics(tiles: DataFrame, side: int, low: float = 50, high: float = 150) -> DataFrame:
    """(drive, camera_id, frame_idx, num_pixels, sharpness, fast_keypoints, edge_pixels, edge_density) of each image."""
    t = tile_metrics(tiles, side, low, high).checkpoint()
    pieces = t.select(*IMAGE, "width", F.inline("pieces"))
    n, mean = F.sum("n"), F.sum("lap") / F.sum("n")
    strong = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + F.when(p["strong"], p["pixels"]).otherwise(0))
    sums = t.groupBy(*IMAGE).agg(n.alias("num_pixels"), (F.sum("lap2") / n - mean * mean).alias("sharpness"), F.sum("corners").alias("fast_keypoints"), F.sum(strong).alias("sure"))
    more = grown(pieces).groupBy(*IMAGE).agg(F.sum("pixels").alias("more"))
    both = sums.join(more, IMAGE, "left").withColumn("edge_pixels", F.col("sure") + F.coalesce("more", F.lit(0)))
    return both.select(*IMAGE, "num_pixels", "sharpness", "fast_keypoints", "edge_pixels", (F.col("edge_pixels") * 100.0 / F.col("num_pixels")).alias("edge_density"))
