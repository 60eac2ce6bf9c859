import numpy as np
import pytest

from rigscope.functions import kernels as kn
from rigscope.operators import camera


def test_exposure_is_strict(spark):
    df = spark.createDataFrame([("d", 0, 1, 4, [240.0, 15.0, 241.0, 14.0])], "drive string, frame_idx int, height int, width int, lum array<double>")
    r = camera.exposure(df).first()
    assert (r["overexposed_pct"], r["underexposed_pct"], r["exposure_quality"]) == (25, 25, 50)


def test_laplacian_forms_agree(spark):
    img = np.random.default_rng(0).integers(0, 255, (5, 7)).astype(float)
    df = spark.createDataFrame([("d", 0, 5, 7, img.ravel().tolist())], "drive string, frame_idx int, height int, width int, lum array<double>")
    assert camera.sharpness(df).first()["sharpness"] == pytest.approx(kn.laplacian(img).var())


def test_edges_of_a_square():
    img = np.zeros((40, 40), np.uint8)
    img[10:30, 10:30] = 200
    e = kn.canny(img)
    assert 60 <= e.sum() <= 90 and not e[15:25, 15:25].any() and not e[:8].any()
    assert not kn.canny(np.full((20, 20), 9, np.uint8)).any()


def test_corners():
    img = np.zeros((60, 60), np.uint8)
    img[20:40, 20:40] = 255
    s = kn.shi_tomasi(img)
    assert len(s) == 4 and {(round(y / 20), round(x / 20)) for y, x, _ in s} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert kn.harris_count(img) >= 4 and kn.harris_count(np.zeros((9, 9), np.uint8)) == 0
    assert len(kn.shi_tomasi(np.zeros((9, 9), np.uint8))) == 0
    dot = np.zeros((15, 15), np.uint8)
    dot[7, 7] = 255
    assert [(int(y), int(x)) for y, x, _ in kn.fast(dot)] == [(7, 7)]
    assert len(kn.fast(np.zeros((5, 5), np.uint8))) == 0 and len(kn.orb(np.zeros((40, 40), np.uint8))) == 0


def test_fast_against_definition():
    img = np.random.default_rng(4).integers(0, 255, (16, 16)).astype(np.uint8)

    def score(y, x):
        ring = [int(img[y + dy, x + dx]) - int(img[y, x]) for dx, dy in kn.CIRCLE]
        return max(max(min(s * ring[(i + j) % 16] for j in range(9)) for i in range(16)) for s in (1, -1))

    all_scores = {(y, x): score(y, x) for y in range(3, 13) for x in range(3, 13)}
    want = {p for p, s in all_scores.items() if s > 20 and all(s > max(all_scores.get((p[0] + a, p[1] + b), 0), 0) * (all_scores.get((p[0] + a, p[1] + b), 0) > 20) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}
    assert {(int(y), int(x)) for y, x, _ in kn.fast(img)} == want


def test_strips():
    assert kn.strips(np.array([0, 1, 2, 7, 8, 11]), 12).tolist() == [2, 1, 0, 1, 2]


def test_gray_and_kernel_frames(spark):
    img = np.random.default_rng(5).integers(0, 255, (24, 32, 3)).astype(np.uint8)
    rows = [("d", "image_02", 0, 24, 32, 3, bytearray(img[..., ::-1].tobytes())), ("d", "image_00", 1, 24, 32, 1, bytearray(img[..., 0].tobytes())), ("d", "image_00", 2, 24, 32, 1, None)]
    df = spark.createDataFrame(rows, "drive string, camera_id string, frame_idx int, height int, width int, n_channels int, data binary")
    got = {r["frame_idx"]: r for r in camera.frame_metrics(df, bgr=True).collect()}
    lum = img @ np.array([0.299, 0.587, 0.114])
    assert got[0]["brightness_mean"] == pytest.approx(lum.mean()) and got[0]["sharpness"] == pytest.approx(kn.laplacian(kn.gray(img)).var())
    assert got[1]["brightness_max"] == img[..., 0].max() and got[2]["sharpness"] is None and not got[2]["sharp_image"] and got[2]["verdict"] == "CHECK"
    some = camera.frame_metrics(df, bgr=True, which=("fast",)).where("frame_idx = 0").first()
    assert some["fast_keypoints"] == got[0]["fast_keypoints"] and some["sharpness"] is None
    with pytest.raises(Exception, match="gray or colour"):
        camera.frame_metrics(df.withColumn("height", df["height"] + 1)).collect()
    s = camera.sequence_metrics(camera.frame_metrics(df, bgr=True)).first()
    assert s["num_frames"] == 3 and not s["sufficient_features"]
    assert camera.keypoint_grid(camera.frame_metrics(df)).count() >= 0


def test_shi_tomasi_keeps_its_distance():
    img = np.random.default_rng(8).integers(0, 255, (60, 80)).astype(np.uint8)
    a, b, c = kn._structure(img, 3)
    e = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    peaks = sorted((-e[y, x], y, x) for y in range(60) for x in range(80) if e[y, x] >= 0.01 * e.max() and e[y, x] == e[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max())
    kept = []
    for _, y, x in peaks:
        if all((y - q[0]) ** 2 + (x - q[1]) ** 2 >= 100 for q in kept):
            kept.append((y, x))
    assert [(int(y), int(x)) for y, x, _ in kn.shi_tomasi(img)] == kept and len(kept) > 10


def test_oriented_keypoints_keep_ties(spark):
    """A picture that repeats: corners tie; all that tie at a level's cut stay, with the direction by definition."""
    g = np.random.default_rng(2)
    img = np.tile(g.integers(0, 255, (20, 20)).astype(np.uint8), (6, 6))
    every, some = kn.oriented(img, 10**6), kn.oriented(img, 40)
    first = every[every[:, 0] == 0]
    want = kn.shares(40, 8, 1.2)
    assert len(first) > want[0] and len({tuple(r) for r in every[:, :3].tolist()}) == len(every)
    h = kn.harris_response(img, 7)
    for level in range(8):
        a, b = every[every[:, 0] == level], some[some[:, 0] == level]
        assert b.tolist() == a[a[:, 3] <= want[level]].tolist()
    response = [h[int(y), int(x)] for _, y, x, *_ in first]
    assert first[:, 3].tolist() == [1 + sum(o > v for o in response) for v in response]
    assert len(some[some[:, 0] == 0]) > want[0]  # ties at the cut
    for _, y, x, _, angle in some[some[:, 0] == 0][:10]:
        inside = [(dy, dx, int(img[int(y) + dy, int(x) + dx])) for dy in range(-15, 16) for dx in range(-15, 16) if dy * dy + dx * dx <= 225 and 0 <= y + dy < 120 and 0 <= x + dx < 120]
        assert angle == pytest.approx(np.degrees(np.arctan2(sum(dy * v for dy, _, v in inside), sum(dx * v for _, dx, v in inside))))
    rows = [("d", "image_00", 0, 120, 120, 1, bytearray(img.tobytes())), ("d", "image_00", 1, 120, 120, 1, None), ("d", "image_00", 2, 5, 5, 1, bytearray(25))]
    df = spark.createDataFrame(rows, "drive string, camera_id string, frame_idx int, height int, width int, n_channels int, data binary")
    got = camera.oriented_keypoints(df, 40).collect()
    assert {r["frame_idx"] for r in got} == {0} and sorted((r["level"], r["y"], r["x"], r["rank"]) for r in got) == sorted(tuple(map(int, r[:4])) for r in some.tolist())
