import re

import numpy as np

from rigscope.llm import licenses


def test_finds_copies_edits_and_places(spark, docs_of):
    apache = licenses.NOTICES["apache-2.0-header"]
    words = apache.split()
    edited = " ".join(words[:8] + ["really"] + words[8:12] + words[13:])
    texts = ["before " + apache + " after", edited, "nothing here", None, "", "Mit   LICENSE. released UNDER the mit license", "MIT", " ".join(["x"] * 50 + ["Released under the MIT License."] + ["y"] * 50 + ["Released under the MIT License."]), "All rights reserved.", "é All rights reserved"]
    rows = [tuple(r) for r in licenses.scan(docs_of(texts, "coverage"), licenses.notices(spark)).collect()]
    by = {}
    for r in rows:
        by.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    assert by[0]["apache-2.0-header"][0][2] == 1 and by[0]["apache-2.0-header"][0][4] == 1
    start, end = by[0]["apache-2.0-header"][0][6:]
    assert texts[0].encode()[start:end].decode().startswith("Licensed under") and texts[0].encode()[start:end].decode().endswith("License")
    assert 0.9 <= by[1]["apache-2.0-header"][0][2] < 1
    assert set(by) == {0, 1, 5, 7, 8, 9}
    assert len(by[7]["mit"]) == 2 and by[8].keys() == {"all-rights-reserved"} and by[9]["all-rights-reserved"][0][6] == 3


def test_repeats_back_to_back(spark, docs_of):
    texts = ["All rights reserved. Copyright B. All rights reserved.", "Released under the MIT License. " * 3, "x all rights reserved " + "all rights reserved " * 40, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."]
    rows = [tuple(r) for r in licenses.scan(docs_of(texts), licenses.notices(spark)).collect()]
    of = lambda i, t: sorted((r[4], r[5]) for r in rows if r[:2] == (i, t))
    assert of(0, "all-rights-reserved") == [(0, 2), (5, 7)]
    assert of(1, "mit") == [(0, 4), (5, 9), (10, 14)]
    assert of(2, "all-rights-reserved") == [(1 + 3 * k, 3 + 3 * k) for k in range(41)]
    assert of(3, "cc-by-nc-4.0") == [(0, 6), (7, 13)]


def test_tables(spark, docs_of):
    assert licenses.scan(docs_of([]), licenses.notices(spark)).count() == 0
    own = spark.createDataFrame([("a", "one two"), ("b", None), (None, "x y z"), ("c", ""), ("a", "one two")], "template_id string, text string")
    assert sorted((r["doc_id"], r["template_id"], r["first_word"]) for r in licenses.scan(docs_of(["zero one two", "one", "two one"]), own).collect()) == [(0, "a", 1)]


def test_winnowing_guarantee():
    g = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    at = licenses.winnow(g, 5)
    assert all(((at >= i) & (at < i + 5)).any() for i in range(196))


def best_alignments(a, b):
    """The full table by definition: its best score."""
    s = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    return s.max()


def score_of(a, b, matched, first, last):
    """The best score of alignments that use exactly the words first to last of b and match so many."""
    part, most = b[first : last + 1], -1e9
    for lo in range(len(a)):
        for hi in range(lo, len(a)):
            x = a[lo : hi + 1]
            s = np.full((len(x) + 1, len(part) + 1), -1e9)
            s[0, 0] = 0
            for i in range(len(x) + 1):
                for j in range(len(part) + 1):
                    if i and j:
                        s[i, j] = max(s[i, j], s[i - 1, j - 1] + (2 if x[i - 1] == part[j - 1] else -1))
                    if i:
                        s[i, j] = max(s[i, j], s[i - 1, j] - 1)
                    if j:
                        s[i, j] = max(s[i, j], s[i, j - 1] - 1)
            most = max(most, s[-1, -1])
    return most


def test_alignment_against_full_table():
    g = np.random.default_rng(1)
    a = g.integers(0, 6, 12).astype(np.uint64)
    texts = [np.concatenate([g.integers(0, 6, 5), a[:4], g.integers(0, 6, g.integers(0, 3)), a[5:], g.integers(0, 6, 4)]).astype(np.uint64) for _ in range(25)]
    texts += [np.zeros(0, np.uint64), np.full(9, 77, np.uint64)]
    got = licenses.align(a, texts, [5] * len(texts), 40)
    for b, (matched, first, last) in zip(texts[:-2], got, strict=False):
        assert 0 <= first <= last < len(b) and matched <= min(len(a), last - first + 1)
        assert score_of(a, b, matched, first, last) == best_alignments(a, b)
        assert 2 * matched >= best_alignments(a, b)
    assert got[-2:] == [(0, 0, 0)] * 2
    assert [licenses.align(a, [b], [5], 40)[0] for b in texts] == got  # alone as among others


def test_scan_against_brute_force(spark, docs_of):
    """Planted templates, whole and edited, in noise: each is found where it is, by a search over all windows of words."""
    g = np.random.default_rng(7)
    noise = lambda n: [f"n{i}" for i in g.integers(0, 500, n)]
    words = {k: re.findall(r"[a-z0-9]+", t.lower()) for k, t in (licenses.NOTICES | licenses.BODIES).items()}
    names, texts, want = sorted(words), [], []
    for d in range(60):
        t = noise(int(g.integers(0, 40)))
        for _ in range(int(g.integers(0, 4))):
            k = names[g.integers(len(names))]
            w = list(words[k])
            if g.random() < 0.4 and len(w) > 30:
                w[int(g.integers(5, len(w) - 5))] = "changed"
            want.append((d, k, len(t)))
            t += w + noise(int(g.integers(1, 30)))
        texts.append(" ".join(t))
    rows = licenses.scan(docs_of(texts), licenses.templates(spark)).collect()
    found = {(r["doc_id"], r["template_id"], r["first_word"]): r for r in rows}
    assert all(w in found for w in want) and len(want) > 50
    for r in rows:
        t, a = texts[r["doc_id"]].split(), words[r["template_id"]]
        span = t[r["first_word"] : r["last_word"] + 1]
        assert r["coverage"] >= 0.6 and r["matched_words"] <= len(a) and r["coverage"] == r["matched_words"] / len(a)
        assert texts[r["doc_id"]].encode()[r["first_byte"] : r["end_byte"]].decode() == " ".join(span)
        common, left = 0, list(a)
        for x in span:
            if x in left:
                left.remove(x)
                common += 1
        assert common >= r["matched_words"]
    exact = {(d, k, p) for d, t in enumerate(texts) for k, a in words.items() for p in range(len(t.split()) - len(a) + 1) if t.split()[p : p + len(a)] == a}
    assert {x for x in exact if len(words[x[1]]) > 2} <= set(found)


def test_repeated_rows_and_ties(spark, docs_of):
    same = [(4, "x Released under the MIT License. y")] * 3
    twins = spark.createDataFrame([("a", "one two three four"), ("b", "one two three four")], "template_id string, text string")
    assert len(licenses.scan(docs_of(same), licenses.notices(spark)).collect()) == 3
    assert sorted(r["template_id"] for r in licenses.scan(docs_of(["zero one two three four"]), twins).collect()) == ["a", "b"]


def test_very_long_text(spark, docs_of):
    text = "some words here " * 700_000 + licenses.BODIES["isc"] + " end"
    rows = licenses.scan(docs_of([text]), licenses.templates(spark)).collect()
    assert ("isc", 2_100_000, 1.0) in {(r["template_id"], r["first_word"], r["coverage"]) for r in rows}


def one_by_one(a, b, found, least, band):
    """The spans by definition: each fingerprint in turn, alone, without a bound or anything known."""
    spans = []
    for shift, place in found:
        while not any(f <= place <= z for f, z, _ in spans):
            lo = max([z + 1 for _, z, _ in spans if z < place], default=0)
            hi = min([f for f, _, _ in spans if f > place], default=len(b))
            matched, first, last = licenses.align(a, [b[lo:hi]], [shift - lo], band)[0]
            if not matched or matched < least * len(a):
                break
            spans.append((lo + first, lo + last, matched))
    return sorted(spans)


def test_spans_against_one_by_one():
    g = np.random.default_rng(3)
    some = 0
    for n in (1, 3, 9, 24):
        for letters in (2, 4, 12):
            a = g.integers(0, letters, n).astype(np.uint64)
            texts = [np.concatenate([x for _ in range(g.integers(1, 9)) for x in (a[g.integers(0, 2) : n - g.integers(0, 2)], g.integers(0, letters + 2, g.integers(0, 6)).astype(np.uint64))]) for _ in range(3)]
            texts.append(np.zeros(0, np.uint64))
            found = [sorted({(int(p - q), int(p)) for p in range(len(b)) for q in range(n) if b[p] == a[q] and g.random() < 0.5}) for b in texts]
            for least in (0.6, 0.95):
                want = [one_by_one(a, b, f, least, 4) for b, f in zip(texts, found, strict=True)]
                assert licenses.spans_of(a, texts, found, least, 4) == want
                some += sum(map(len, want))
    assert some > 80


def test_one_run_in_every_line(spark, docs_of, monkeypatch):
    """20,000 hits of a run of a whole license: bounded at once, hardly any alignment; copies among them are found."""
    line = "permission is hereby granted {} and the other words of this line here\n"
    lines = [line.format(f"n{i}") for i in range(20_000)]
    lines[700] = licenses.BODIES["isc"] + "\n"
    text = "".join(lines)
    assert len(text) > 1 << 20
    a, made, real = {}, [], licenses.align
    monkeypatch.setattr(licenses, "align", lambda a, texts, shifts, band: made.append(len(texts)) or real(a, texts, shifts, band))
    raw = np.frombuffer(text.encode(), np.uint8)
    h = licenses.word_hashes(raw, np.array([0, len(raw)]))[0]
    for name in ("isc", "mit-body"):
        body = np.frombuffer(licenses.BODIES[name].encode(), np.uint8)
        a[name] = licenses.word_hashes(body, np.array([0, len(body)]))[0]
    for name, seq in a.items():
        places = {int(x): i for i, x in enumerate(licenses.grams(seq, 3))}
        found = sorted((p - places[x], p) for p, x in enumerate(licenses.grams(h, 3).tolist()) if x in places)
        assert len(found) > 20_000
        spans = licenses.spans_of(seq, [h], [found], 0.6, 8)[0]
        assert [s[2] for s in spans] == ([len(seq)] if name == "isc" else [])
    assert sum(made) < 1_000
    rows = licenses.scan(docs_of([text]), licenses.templates(spark)).where("template_id = 'isc'").collect()
    assert [r["coverage"] for r in rows] == [1.0]
