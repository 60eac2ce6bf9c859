import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rigscope.llm import periods, queries


def brute_runs(w, least=6, times=4):
    """By definition: maximal stretches for every period, kept where no smaller period holds."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fib(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    g = random.Random(0)
    out = [[], ["a"], list("aaaaa"), list("aaaaaa"), list("ababab"), list("abababab"), list("aab" * 5), fib(300), list("a" * 10 + "b") * 6, list("aabaab" * 2 + "aab" * 4 + "x" + "aab" * 4)]
    thue = [bin(i).count("1") % 2 for i in range(256)]
    out += [list(map(str, thue)), list(map(str, thue)) * 5]
    for _ in range(300):
        k = g.choice([1, 2, 2, 3, 5, 40])
        w = [str(g.randrange(k)) for _ in range(g.randrange(1, 60))]
        for _ in range(g.randrange(4)):
            p = [str(g.randrange(k)) for _ in range(g.randrange(1, 12))]
            at = g.randrange(len(w) + 1)
            w[at:at] = (p * g.randrange(1, 9))[: g.randrange(1, 80)]
        out.append(w)
    return out


def test_runs_equal_brute_force():
    texts = cases()
    number = {}
    h = np.array([number.setdefault(x, 7919 * len(number) + 1) for w in texts for x in w], np.uint64)
    begins = np.r_[0, np.cumsum([len(w) for w in texts])]
    got = periods.find_runs(h, begins)
    of = np.searchsorted(begins, got[:, 0], side="right") - 1
    total = 0
    for t, w in enumerate(texts):
        want = brute_runs(w)
        total += len(want)
        assert [(int(s - begins[t]), int(x), int(q)) for s, x, q in got[of == t]] == want, w
    assert total > 300
    with pytest.raises(ValueError):
        periods.find_runs(h, begins, times=3)


def test_wavelet():
    g = np.random.default_rng(0)
    v = g.permutation(200)
    tree = periods.Wavelet(v, 8)
    for _ in range(200):
        lo, hi = sorted(g.integers(0, 201, 2))
        x = int(g.integers(0, 256))
        assert tree.less(np.array([lo]), np.array([hi]), np.array([x]))[0] == (v[lo:hi] < x).sum()
        if hi > lo:
            n = int(g.integers(0, hi - lo))
            assert tree.nth(np.array([lo]), np.array([hi]), np.array([n]))[0] == np.sort(v[lo:hi])[n]


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, x, q in runs for i in range(s + q, s + x)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
        sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    g = random.Random(4)
    rows = [(i, g.choice([" ", "\n", " \t", "　 "]).join(w)) for i, w in enumerate(cases())]
    rows += [(1000 + i, " ".join(f"w{g.randrange(500)}" for _ in range(g.randrange(200)))) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "a b " * 9), (3, rows[3][1]), (7, "é é é é é é é"), (7, "x y")]
    docs_of(rows, "runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periods(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((contract(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_empty_table_and_long_text(spark, docs_of):
    assert periods.collapse(docs_of([])).count() == 0
    g = random.Random(8)
    words = [f"w{g.randrange(50_000)}" for _ in range(300_000)]
    words[1000:200_000] = (words[1000:31_000] * 7)[: 199_000]
    row = periods.collapse(docs_of([" ".join(words)])).first()
    (s, n, q), = [tuple(r) for r in row["runs"]]
    assert q == 30_000 and s <= 1000 and s + n >= 200_000 and all(words[i] == words[i + q] for i in range(s, s + n - q))
    assert row["collapsed"].split(" ") == words[: s + q] + words[s + n :]
