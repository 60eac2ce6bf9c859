import random

import numpy as np
import pytest

from rigscope.llm import langid, quality, toxicity
from rigscope.llm.common import fold

SYLLABLES = {"aa": "ba be bi lo la".split(), "bb": "sch ung keit ver ein".split(), "cc": "ción os ar ez ñi".split()}


def labelled(spark, n=400, seed=0):
    g = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = g.choice(list(SYLLABLES))
        t = ["".join(g.choice(SYLLABLES[lang]) for _ in range(g.randrange(1, 4))) for _ in range(g.randrange(5, 60))]
        toxic, good = g.random() < 0.25, g.random() < 0.7
        if toxic:
            for _ in range(3):
                t[g.randrange(len(t))] = g.choice(["idiot", "grumblor" + g.choice("xyz"), "trash"])
        if not good:
            t = [w + g.choice(["###", "%%%"]) for w in t] if g.random() < 0.5 else [g.choice(t)] * 30
        rows.append((i, " ".join(t), lang, "s", 1, "clash"))
        if g.random() < 0.9:
            labels.append((i, int(good), int(toxic), "clash"))
    rows += [(n, None, None, None, None, None), (n + 1, "", "aa", "s", 0, ""), (n + 2, "123 ... !", "aa", "s", 0, ""), (3, rows[3][1], rows[3][2], "s", 1, ""), (None, "ba be", "aa", "s", 1, "")]
    labels += [(n, 1, 0, ""), (None, 1, 1, ""), (5, None, None, ""), (6, 7, 9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string")


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled(spark)
    return docs.cache(), labels.cache()


def held_out_accuracy(scores, labels, column, out_of, held, threshold):
    rows = scores.where(fold("doc_id", out_of) == held).join(labels.where(f"{column} in (0, 1)").select("doc_id", column), "doc_id").collect()
    assert len(rows) > 30
    return np.mean([(r["score"] >= threshold) == r[column] for r in rows])


def test_toxicity(tables, spark):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert held_out_accuracy(out, labels, "toxic", 3, 1, 0.7) > 0.93
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("score < 0.7").count()
    again = toxicity.score(docs.repartition(3), toxicity.fit(docs.repartition(3), labels))
    close = {r["doc_id"]: r["score"] for r in again.collect()}
    assert all(abs(close[r["doc_id"]] - r["score"]) < 1e-6 for r in out.collect())


def test_label_model_discounts_what_agrees():
    """From votes alone: good voters are told from a crowd that repeats one bad one, and their rates are found."""
    g = np.random.default_rng(0)
    y = g.random(4000) < 0.4
    good = np.stack([(y ^ (g.random(4000) < 0.15)) for _ in range(4)], 1)
    twin = (y ^ (g.random(4000) < 0.4))[:, None] ^ (g.random((4000, 12)) < 0.02)
    x = np.concatenate([good, twin], 1).astype(np.float32)
    q, model = toxicity.label_model(x, np.where(good.sum(1) >= 2, 0.9, 0.1))
    assert ((q > 0.5) == y).mean() > 0.9
    assert model["rates"][1, :4] == pytest.approx(np.full(4, 0.85), abs=0.08) and model["rates"][0, :4] == pytest.approx(np.full(4, 0.15), abs=0.08)
    assert model["correlation"][4:, 4:].sum() / 132 > 0.8 and abs(model["correlation"][:4, :4]).max() < 0.2
    assert model["weight"][4:].max() < 0.12 and model["weight"][:4].min() > 0.8


def test_label_model_against_plain_loops():
    """One round, by definition."""
    g = np.random.default_rng(3)
    x = (g.random((300, 5)) < 0.4).astype(np.float32)
    x[:, 3] = x[:, 1]
    start = np.where(x[:, 0] > 0, 0.9, 0.2)
    q, model = toxicity.label_model(x, start, rounds=1)
    rate = [[(u @ x[:, j] + 0.5) / (u.sum() + 1) for j in range(5)] for u in (1 - start, start)]
    rest = np.array([[x[i, j] - start[i] * rate[1][j] - (1 - start[i]) * rate[0][j] for j in range(5)] for i in range(300)])
    for i in range(300):
        logit = np.log(start.mean() / (1 - start.mean()))
        for j in range(5):
            r = [(rest[:, j] * rest[:, k]).mean() / np.sqrt((rest[:, j] ** 2).mean() * (rest[:, k] ** 2).mean()) for k in range(5) if k != j]
            p = [c[j] if x[i, j] else 1 - c[j] for c in rate]
            logit += np.log(p[1] / p[0]) / (1 + sum(v for v in r if v > 0.1))
        assert np.log(q[i] / (1 - q[i])) == pytest.approx(logit, abs=1e-3)
    assert model["weight"][1] == pytest.approx(0.5, abs=0.01)


def test_quality(tables, spark):
    docs, labels = tables
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert held_out_accuracy(out, labels, "quality", 5, 0, 0.3) > 0.9
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("score >= 0.3").count()


def test_vote_is_exact_nearest_neighbours():
    g = np.random.default_rng(1)
    x = quality.unit(np.abs(g.normal(size=(60, quality.TERMS))).astype(np.float32))
    x[30:36] = x[20]  # equal cosines: the first ones vote
    y = (g.random(40) < 0.5).astype(np.float32)
    mean = x[:40].mean(0)
    basis = quality.latent_basis(x[:40], mean, 8)
    u, s, vt = np.linalg.svd(x[:40] - mean, full_matrices=False)
    assert np.linalg.norm((x[:40] - mean) @ basis) == pytest.approx(np.sqrt((s[:8] ** 2).sum()), rel=0.02)
    v = quality.unit(x[:40] @ basis - mean @ basis)
    got = quality.vote({"mean": mean, "basis": basis, "v": v, "y": y}, x, np.zeros(60, bool), 5)
    z = quality.unit(x @ basis - mean @ basis)
    cos = z @ v.T
    for i in range(60):
        near = np.argsort(-cos[i], kind="stable")[:5]
        w = np.maximum(cos[i, near], 1e-6) ** 8
        assert got[i] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-3)


def test_quality_terms():
    raw = [b"ab ab cd", b"", b"x"]
    c = quality.term_counts(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 8, 8, 9]))
    assert c[:, : quality.PAIRS].sum(axis=1).tolist() == [7, 0, 0] and c[:, quality.PAIRS].tolist() == [1, 0, 0] and c[:, quality.PAIRS + 1].tolist() == [1, 0, 0]
    assert c[:, quality.PAIRS + 2 :].sum(axis=1).tolist() == [3, 0, 1] and c[0, quality.PAIRS + 2 :].max() == 2


def test_long_texts_in_stretches(monkeypatch):
    g = np.random.default_rng(5)
    text = " ".join("w" * int(n) + str(k) for n, k in zip(g.integers(1, 9, 3000), g.integers(0, 60, 3000))).encode()
    data = np.frombuffer(text, np.uint8)
    offs = np.array([0, len(data)])
    whole, hits = quality._counts(data, offs), toxicity.entries_of(data, offs, np.sort(np.array([toxicity.key(b"ww1", 0), toxicity.key(b"wwww", 4)], np.uint64)))
    monkeypatch.setattr(quality.tn, "SLICE_BYTES", 200)
    spans = list(quality.tn.stretches(data, 300))
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] and text[b[0]] == 32 for a, b in zip(spans[:-1], spans[1:])) and len(spans) > 20
    assert list(quality.tn.stretches(np.frombuffer(b"x" * 1000 + b" y", np.uint8), 100)) == [(0, 1000), (1000, 1002)]
    monkeypatch.setattr(quality.tn, "stretches", lambda d: iter(spans))
    assert (quality.term_counts(data, offs) == whole).all()
    again = toxicity.entries_of(data, offs, np.sort(np.array([toxicity.key(b"ww1", 0), toxicity.key(b"wwww", 4)], np.uint64)))
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(hits, again))


def test_language(tables, spark):
    docs, _ = tables
    out = langid.predict(docs, langid.fit(docs)).withColumnRenamed("score", "p").withColumn("held", fold("doc_id", 4) == 2)
    rows = out.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    real = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]) and "idiot" not in r["text"] and "trash" not in r["text"] and "grumb" not in r["text"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in real if r["held"]]) > 0.95
    none = [r for r in rows if not r["text"] or not any(c.isalpha() for c in r["text"])]
    assert len(none) == 3 and all(r["lang_pred"] == "und" and r["p"] == 0 for r in none)
    assert all(0 <= r["p"] <= 1 for r in rows) and out.count() == docs.count()


def test_gradients():
    g = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in langid.start_weights(3, 4).items()}
    data = g.integers(97, 123, 90).astype(np.uint8)
    first, last = np.array([0, 0, 30]), np.array([30, 30, 90])
    start, end, label = np.array([0, 16, 50]), np.array([16, 30, 66]), np.array([0, 2, 1])
    loss, grad = langid.gradients(p, data, start, end, first, last, label)
    for k in p:
        for _ in range(4):
            i = tuple(g.integers(0, n) for n in p[k].shape)
            if k.endswith("x"):
                i = (int(data[g.integers(0, 90)]), i[1])
            q = {n: v.copy() for n, v in p.items()}
            q[k][i] += 1e-3
            up = langid.gradients(q, data, start, end, first, last, label)[0]
            q[k][i] -= 2e-3
            assert (up - langid.gradients(q, data, start, end, first, last, label)[0]) / 2e-3 == pytest.approx(float(grad[k][i]), rel=0.05, abs=2e-5)


def plain_states(p, d, x):
    """One state after another, in plain loops."""
    h, out, s = len(p["fc"]), [], np.zeros(len(p["fc"]))
    for b in x if d == "f" else x[::-1]:
        a = p[f"{d}x"][b].astype(float)
        g = 1 / (1 + np.exp(-(a[: 2 * h] + s @ p[f"{d}g"])))
        c = np.tanh(a[2 * h :] + (g[h:] * s) @ p[f"{d}c"])
        s = (1 - g[:h]) * s + g[:h] * c
        out.append(s)
    return out if d == "f" else out[::-1]


def plain_distributions(p, x, start, end):
    """Distributions at [start, end) of a text, states from CONTEXT bytes before and behind on."""
    lo, hi = max(0, start - langid.CONTEXT), min(len(x), end + langid.CONTEXT)
    n = min(langid.WINDOW, end - start)
    f = plain_states(p, "f", x[lo:end])[start - lo :][:n]
    b = plain_states(p, "b", x[start:hi])[:n]
    y = np.array([np.concatenate([u, v]) @ p["o"] + p["bias"] for u, v in zip(f, b, strict=True)])
    y = np.exp(y - y.max(axis=1, keepdims=True))
    return y / y.sum(axis=1, keepdims=True)


def test_every_position_against_plain_loops():
    g = np.random.default_rng(6)
    p = langid.start_weights(3, 5)
    texts = ["", "é", "Ab c " * 30, "".join(map(chr, g.integers(32, 500, 700))), "x"]
    raw = [t.encode() for t in texts]
    got = langid.pooled(p, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for t, q in zip(raw, got, strict=True):
        x = langid.tn.LOWER[np.frombuffer(t, np.uint8)]
        each = [plain_distributions(p, x, a, min(a + langid.WINDOW, len(x))) for a in range(0, len(x), langid.WINDOW)]
        assert sum(map(len, each)) == len(x)
        want = np.concatenate(each).mean(axis=0) if each else np.zeros(3)
        assert q == pytest.approx(want, abs=1e-4)


def test_windows_stand_for_whole_sequences(tables):
    """What lies beyond the context has faded: state carried over the whole text gives nearly the same."""
    docs, _ = tables
    model = langid.fit(docs)
    x = langid.tn.LOWER[np.frombuffer(" ".join(r["text"] for r in docs.where("lang = 'aa'").limit(12).collect() if r["text"]).encode(), np.uint8)]
    p = model["p"]
    y = np.array([np.concatenate([u, v]) @ p["o"] + p["bias"] for u, v in zip(plain_states(p, "f", x), plain_states(p, "b", x), strict=True)])
    y = np.exp(y - y.max(axis=1, keepdims=True))
    whole = (y / y.sum(axis=1, keepdims=True)).mean(axis=0)
    assert len(x) > 4 * langid.WINDOW
    assert langid.pooled(p, x, np.array([0, len(x)]))[0] == pytest.approx(whole, abs=0.02)


def test_very_long_text(tables, spark):
    docs, _ = tables
    model = langid.fit(docs)
    long = spark.createDataFrame([(0, "schung keitver " * 400_000), (1, "ba")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(long, model).collect()} == {0: "bb", 1: "aa"}


def test_nothing_to_learn_from(tables, spark):
    docs, labels = tables
    none, empty = labels.where("false"), docs.where("false")
    assert quality.score(docs, quality.fit(docs, none)).select("score").distinct().count() == 1
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("score >= 0.7").count() > 0  # the seed list still votes
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    for out in (quality.score(empty, quality.fit(docs, labels)), toxicity.score(empty, toxicity.fit(docs, labels)), langid.predict(empty, langid.fit(docs))):
        assert out.count() == 0
