import numpy as np
import pytest

from rigscope.functions import kernels as kn
from rigscope.operators import tiles


def images(spark, some):
    rows = [("d", "image_00", i, *img.shape, bytearray(img.tobytes())) for i, img in enumerate(some)]
    return spark.createDataFrame(rows, "drive string, camera_id string, frame_idx int, height int, width int, data binary")


def snake(n):
    """A weak edge that winds through the whole picture, strong at its one end."""
    img = np.zeros((n, n), np.uint8)
    for k, y in enumerate(range(4, n - 4, 8)):
        img[y : y + 4, 4 : n - 4] = 30
        x = n - 8 if k % 2 == 0 else 4
        img[y : min(y + 12, n - 4), x : x + 4] = 30
    img[4:8, 4:8] = 200
    return img


@pytest.mark.parametrize("side", [4, 7, 16, 33, 200])
def test_tiles_give_what_whole_images_give(spark, side):
    g = np.random.default_rng(side)
    smooth = np.kron(g.integers(0, 120, (9, 11)), np.ones((6, 6))).astype(np.uint8)
    some = [snake(56), smooth, g.integers(0, 255, (40, 33)).astype(np.uint8), g.integers(0, 60, (31, 50)).astype(np.uint8), np.zeros((1, 1), np.uint8), g.integers(0, 255, (1, 40)).astype(np.uint8), g.integers(0, 255, (2, 9)).astype(np.uint8)]
    got = {r["frame_idx"]: r for r in tiles.frame_metrics(tiles.split(images(spark, some), side), side).collect()}
    assert len(got) == len(some)
    for i, img in enumerate(some):
        edges = kn.canny(img)
        assert (got[i]["num_pixels"], got[i]["fast_keypoints"], got[i]["edge_pixels"]) == (img.size, len(kn.fast(img)), edges.sum()), i
        assert got[i]["sharpness"] == pytest.approx(kn.laplacian(img).var()) and got[i]["edge_density"] == pytest.approx(edges.mean() * 100)
    whole = kn.canny(some[0])
    strong = sum(kn.canny(some[0], 149, 150).ravel())
    assert whole.sum() > 5 * strong > 0  # most of it grows, over many borders


def test_pieces_against_a_flood():
    g = np.random.default_rng(0)
    for share in (0.1, 0.4, 0.7):
        m = g.random((14, 17)) < share
        root, at = tiles.pieces_of(m), {p: k for k, p in enumerate(zip(*np.nonzero(m), strict=True))}
        seen = {}
        for p in at:
            if p not in seen:
                todo = [p]
                while todo:
                    q = todo.pop()
                    if q not in seen:
                        seen[q] = at[p]
                        todo += [n for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (n := (q[0] + dy, q[1] + dx)) in at]
        assert root.tolist() == [seen[p] for p in at]


def test_cases(spark):
    empty = images(spark, [np.zeros((3, 3), np.uint8)]).where("frame_idx > 0")
    assert tiles.frame_metrics(tiles.split(empty, 8), 8).count() == 0
    with pytest.raises(ValueError, match="3 pixels"):
        tiles.with_halos(tiles.split(empty, 3), 3)
