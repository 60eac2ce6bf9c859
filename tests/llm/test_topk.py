import numpy as np
import pytest

from rigscope.llm import topk


def brute(rows, k, every):
    v = {i: np.floor(256 * np.array(x, float)).astype(np.int64) for i, x in rows}
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, r + 1, c, -n) for r, (n, c) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5, every=5):
    df = spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id bigint, embedding array<float>, score string")
    return sorted(tuple(r) for r in topk.top_k(df, k, every).collect())


@pytest.mark.parametrize("blocks", [8192, 16])
def test_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES_A_BLOCK", blocks)
    monkeypatch.setattr(topk, "LAST_BLOCK", blocks)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 4)
    g = np.random.default_rng(0)
    rows = [(i, g.normal(0, 0.2, 16).astype("f4").tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    assert run(spark, rows) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.1, -0.2]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (10, [-1.0, 2.0]), (10, [-1.0, 2.0])]
    assert run(spark, rows) == brute([rows[0], rows[1], rows[5]], 5, 5)
    assert run(spark, [(5, [None, 1.0]), (6, [1.0, 1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def searched(q, x, k, first=topk.FIRST_BLOCK, q_ids=None, x_ids=None):
    """What blocks of growing size give for each query, and the share of all entries that was read."""
    best, a, size, read = topk.Best(len(q), k), 0, first, 0
    q_ids, x_ids = -1 - np.arange(len(q)) if q_ids is None else q_ids, np.arange(len(x)) if x_ids is None else x_ids
    while a < len(x):
        read += topk.search(q, q_ids, x[a : a + size], x_ids[a : a + size], best, count=True)
        a, size = a + size, min(2 * size, topk.LAST_BLOCK)
    return [[(c, -s) for s, c in row] for row in best.rows], read / (len(q) * x.size)


def product(q, x, k):
    score = lambda a, b: min(max(int(a.astype(object) @ b.astype(object)), topk.LEAST), topk.MOST)
    return [[(j, -n) for n, j in sorted((-score(a, b), j) for j, b in enumerate(x))[:k]] for a in q]


def test_large_components_stay_exact():
    g = np.random.default_rng(1)
    for scale in (2**10, 2**20, 2**29, 2**40):
        q, x = g.integers(-scale, scale, (3, 8)), g.integers(-scale, scale, (50, 8))
        q, x = (q.astype(object), x.astype(object)) if scale > 2**28 else (q, x)
        assert searched(q, x, 4)[0] == product(q, x, 4)


@pytest.mark.parametrize("first", [16, 4096])
def test_reading_stops_early_on_skewed_lists(first):
    """A few large components decide: most entries are never read; with alike components about half are."""
    g = np.random.default_rng(2)
    m, d = 3000, 32
    skewed = np.floor(g.normal(0, 10, (m, d)) * np.r_[np.full(2, 100), np.full(d - 2, 0.3)]).astype(np.int64)
    alike = np.floor(g.normal(0, 30, (m, d))).astype(np.int64)
    for x in (skewed, alike):
        got, share = searched(x[:20], x, 5, first)
        assert got == product(x[:20], x, 5)
        if first == 16:
            assert share < (0.25 if x is skewed else 0.6)


def test_share_read_on_the_given_table():
    table = pytest.importorskip("pyarrow.dataset").dataset("/root/testdata/sf0.1/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
    ((ids, v),) = topk.usable(table.column(0), table.column(1), 256).values()
    asked = ids % 50 == 0
    assert searched(v[asked], v, 5, q_ids=ids[asked], x_ids=ids)[1] < 0.6


def test_ids_beyond_doubles(spark):
    """Ids that doubles can't tell apart, and one that is repeated in the block."""
    big = 1 << 60
    rows = [(5, [1.0, 0.5]), (big, [0.9, 0.5]), (big + 1, [0.9, 0.5]), (big + 2, [0.9, 0.5]), (7, [0.1, 0.1]), (7, [0.1, 0.1])]
    assert [r[2] for r in run(spark, rows, k=3) if r[0] == 5] == [big, big + 1, big + 2]


def test_scores_beyond_a_long(spark):
    """Such scores count as the nearest long; ties among these go to the smaller id, and no row is lost."""
    rows = [(5, [3e18, 1.0]), (6, [3e18, 0.0]), (7, [-3e18, 0.0]), (8, [1e30, 2.0]), (9, [1e38, -1.0]), (11, [1e-3, 0.0])]
    got = [r for r in run(spark, rows) if r[0] == 5]
    assert [(r[2], r[3]) for r in got] == [(6, topk.MOST), (8, topk.MOST), (9, topk.MOST), (11, 0), (7, topk.LEAST)]
    df = spark.createDataFrame([(5, [1e300, 1.0]), (6, [1.7e308, 0.0]), (7, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r)[2:] for r in topk.top_k(df, 5, 5).orderBy("rank").collect()] == [(6, topk.MOST), (7, 256 * 512)]


def test_repeated_rows_do_not_crowd_out_others(spark):
    rows = [(5, [1.0, 0.0])] + [(7, [1.0, 0.1])] * 12 + [(i, [0.5 - i / 1000, 0.0]) for i in range(11, 20)]
    want = sorted((-int(256 * (256 * 1)), 7) if i == 7 else (-int(256 * np.floor(256 * np.float32(v[0]).astype(float))), i) for i, v in {i: v for i, v in rows if i != 5}.items())[:5]
    got = [r for r in run(spark, rows) if r[0] == 5]
    assert [(-r[3], r[2]) for r in got] == want


def test_own_rows_and_lengths(spark):
    rows = [(0, [1.0, 1.0]), (0, [3.0, 3.0]), (1, [1.0, 2.0]), (2, [1.0]), (5, [2.0]), (3, [])]
    got = run(spark, rows)
    assert {(r[0], r[2]) for r in got} == {(0, 1), (5, 2)}
    assert [r[3] for r in got if r[0] == 0] == [3 * 3 * 256 * 256, 3 * 256 * 256]
