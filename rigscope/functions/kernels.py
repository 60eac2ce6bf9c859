"""Image kernels in NumPy for what Spark has no primitive for: edges and keypoints of one image.

Definitions follow the usual ones of computer-vision libraries (reflect-101 borders, L1 gradient magnitude in the
edge detector, 9 of 16 contiguous circle pixels). Counts of the pyramid detector follow its definition; they need not
equal those of any one implementation.
"""

from __future__ import annotations

import numpy as np

# The circle of radius 3, clockwise from the top, as (dx, dy).
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]

#: Corners whose surroundings are held at a time.
CORNERS_AT_ONCE = 1024


def gray(img: np.ndarray) -> np.ndarray:
    """uint8 gray of an RGB image by fixed-point weights; gray images pass."""
    if img.ndim == 2:
        return img.astype(np.uint8)
    r, g, b = (img[..., i].astype(np.int64) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


def luminance(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img.astype(np.float64)
    return 0.299 * img[..., 0] + 0.587 * img[..., 1] + 0.114 * img[..., 2]


def _padded(img: np.ndarray, n: int) -> np.ndarray:
    return np.pad(img, n, mode="reflect" if min(img.shape) > n else "edge")


def _shift(p: np.ndarray, n: int, dy: int, dx: int) -> np.ndarray:
    return p[n + dy : p.shape[0] - n + dy, n + dx : p.shape[1] - n + dx]


def laplacian(img: np.ndarray) -> np.ndarray:
    p = _padded(img.astype(np.float64), 1)
    return _shift(p, 1, -1, 0) + _shift(p, 1, 1, 0) + _shift(p, 1, 0, -1) + _shift(p, 1, 0, 1) - 4 * _shift(p, 1, 0, 0)


def sobel(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _padded(img.astype(np.float64), 1)
    s = lambda dy, dx: _shift(p, 1, dy, dx)
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    return gx, gy


def box(img: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows, anchored at size // 2."""
    before, after = size // 2, size - 1 - size // 2
    p = np.pad(img, ((before, after), (before, after)), mode="reflect" if min(img.shape) > size else "edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def dilate(img: np.ndarray) -> np.ndarray:
    p = np.pad(img, 1, constant_values=-np.inf)
    return np.max([_shift(p, 1, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)


def edge_peaks(img: np.ndarray, low: float = 50) -> tuple[np.ndarray, np.ndarray]:
    """Pixels where the gradient is over ``low`` and greatest along its direction, and its size everywhere."""
    gx, gy = sobel(img)
    mag = np.abs(gx) + np.abs(gy)
    p = np.pad(mag, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    down = (gx * gy) >= 0
    first = np.where(flat, _shift(p, 1, 0, -1), np.where(steep, _shift(p, 1, -1, 0), np.where(down, _shift(p, 1, -1, -1), _shift(p, 1, -1, 1))))
    second = np.where(flat, _shift(p, 1, 0, 1), np.where(steep, _shift(p, 1, 1, 0), np.where(down, _shift(p, 1, 1, 1), _shift(p, 1, 1, -1))))
    return (mag > first) & np.where(flat | steep, mag >= second, mag > second) & (mag > low), mag


def canny(img: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge mask: gradient, thinning along its direction, and growth of strong edges along weak ones."""
    peak, mag = edge_peaks(img, low)
    edge = peak & (mag > high)
    while True:
        grown = peak & (dilate(edge.astype(np.float64)) > 0)
        if (grown == edge).all():
            return edge
        edge = grown


def _structure(img: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gx, gy = sobel(img)
    return box(gx * gx, block), box(gx * gy, block), box(gy * gy, block)


def harris_response(img: np.ndarray, block: int = 2, k: float = 0.04) -> np.ndarray:
    a, b, c = _structure(img, block)
    return a * c - b * b - k * (a + c) ** 2


def harris_count(img: np.ndarray) -> int:
    """Pixels whose dilated response is over 1 % of the largest; 0 if none is positive."""
    r = dilate(harris_response(img))
    top = r.max(initial=0)
    return int((r > 0.01 * top).sum()) if top > 0 else 0


def fast(img: np.ndarray, threshold: int = 20) -> np.ndarray:
    """(y, x, score) of corners: 9 contiguous circle pixels all brighter or all darker; local maxima of the score only."""
    h, w = img.shape
    if h < 7 or w < 7:
        return np.zeros((0, 3))
    v = img.astype(np.int64)
    core = v[3:-3, 3:-3]
    ring = np.stack([v[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dx, dy in CIRCLE]) - core
    both = np.concatenate([ring, ring[:8]])
    bright = np.max([both[i : i + 9].min(axis=0) for i in range(16)], axis=0)
    dark = np.max([(-both[i : i + 9]).min(axis=0) for i in range(16)], axis=0)
    score = np.maximum(bright, dark)
    score = np.where(score > threshold, score, 0).astype(np.float64)
    p = np.pad(score, 1)
    others = np.max([_shift(p, 1, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    y, x = np.nonzero((score > 0) & (score > others))
    return np.stack([y + 3, x + 3, score[y, x]], axis=1)


def shi_tomasi(img: np.ndarray, most: int = 1000, quality: float = 0.01, distance: float = 10) -> np.ndarray:
    """(y, x, score) of the strongest corners, at least ``distance`` apart."""
    a, b, c = _structure(img, 3)
    e = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    top = e.max(initial=0)
    if top <= 0:
        return np.zeros((0, 3))
    y, x = np.nonzero((e >= quality * top) & (e == dilate(e)) & (e > 0))
    order = np.lexsort((x, y, -e[y, x]))
    kept: list[tuple[int, int, float]] = []
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}  # kept corners by squares of that side: only neighbours can be too near
    side = max(distance, 1)
    for i, v, u in zip(order.tolist(), y[order].tolist(), x[order].tolist(), strict=True):
        cy, cx = int(v // side), int(u // side)
        around = (q for a in (-1, 0, 1) for b in (-1, 0, 1) for q in cells.get((cy + a, cx + b), ()))
        if all((v - q[0]) ** 2 + (u - q[1]) ** 2 >= distance**2 for q in around):
            kept.append((v, u, float(e[y[i], x[i]])))
            cells.setdefault((cy, cx), []).append((v, u))
            if len(kept) == most:
                break
    return np.array(kept).reshape(-1, 3)


def pyramid(img: np.ndarray, most: int, levels: int, scale: float, border: int):
    """Of each level: its number, the places of its rows and columns in the image, its pixels, corners (y, x) off the
    border, their Harris responses, and its share of ``most``."""
    for level, want in enumerate(shares(most, levels, scale)):
        f = scale**level
        h, w = int(round(img.shape[0] / f)), int(round(img.shape[1] / f))
        if min(h, w) < 7:
            return
        ys, xs = ((np.arange(n) + 0.5) * f - 0.5 for n in (h, w))
        small = resized(img, ys, xs)
        edge = min(border, max(3, min(h, w) // 8))
        k = fast(small)
        k = k[(k[:, 0] >= edge) & (k[:, 0] < h - edge) & (k[:, 1] >= edge) & (k[:, 1] < w - edge)][:, :2].astype(int)
        if len(k):
            yield level, ys, xs, small, k, harris_response(small, 7)[k[:, 0], k[:, 1]], want


def shares(most: int, levels: int, scale: float) -> list[int]:
    """How many of ``most`` keypoints each level may keep, falling by 1 / scale."""
    factor = 1 / scale
    first = most * (1 - factor) / (1 - factor**levels)
    return [int(round(first * factor**level)) for level in range(levels)]


def orb(img: np.ndarray, most: int = 2000, levels: int = 8, scale: float = 1.2, border: int = 31) -> np.ndarray:
    """(y, x, response) of pyramid corners: FAST at each level, ranked by Harris response, shares falling by level."""
    out = []
    for _, ys, xs, _, k, r, want in pyramid(img, most, levels, scale, border):
        best = np.lexsort((k[:, 1], k[:, 0], -r))[:want]
        out.append(np.stack([ys[k[best, 0]], xs[k[best, 1]], r[best]], axis=1))
    return np.concatenate(out)[:most] if out else np.zeros((0, 3))


def oriented(img: np.ndarray, most: int = 2000, levels: int = 8, scale: float = 1.2, border: int = 31, radius: int = 15) -> np.ndarray:
    """(level, y, x, rank, degrees) of pyramid corners in their level's pixels, those that tie at a level's cut included.

    A corner's direction is that from it to the centroid of the gray values within ``radius``; outside the image is black.
    """
    d = np.arange(-radius, radius + 1)
    dy, dx = (v.ravel() for v in np.meshgrid(d, d, indexing="ij"))
    disc = dy * dy + dx * dx <= radius * radius
    dy, dx = dy[disc], dx[disc]
    out = [np.zeros((0, 5))]
    for level, _, _, small, k, r, want in pyramid(img, most, levels, scale, border):
        rank = 1 + len(r) - np.searchsorted(np.sort(r), r, side="right")
        k, rank = k[rank <= want], rank[rank <= want]
        dark = np.pad(small, radius).astype(np.int64)
        for x in range(0, len(k), CORNERS_AT_ONCE):
            y0, x0 = (c[:, None] + radius for c in k[x : x + CORNERS_AT_ONCE].T)
            v = dark[y0 + dy, x0 + dx]
            angle = np.degrees(np.arctan2((v * dy).sum(axis=1), (v * dx).sum(axis=1)))
            out.append(np.column_stack([np.full(len(v), level), k[x : x + CORNERS_AT_ONCE], rank[x : x + CORNERS_AT_ONCE], angle]))
    return np.concatenate(out)


def resized(img: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear values at the given coordinates."""
    h, w = img.shape
    y, x = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    v = img.astype(np.float64)
    top = v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx
    low = v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def strips(y: np.ndarray, height: int, n: int = 5) -> np.ndarray:
    """Counts over n strips of height // n rows; the last one takes the rest."""
    step = max(1, height // n)
    return np.bincount(np.minimum(y.astype(int) // step, n - 1), minlength=n)
