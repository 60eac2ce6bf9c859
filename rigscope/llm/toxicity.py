"""Operator 5: toxicity by weak supervision.

Voters are lexicon entries and patterns. Entries are whole words and word beginnings: a seed list, and those that
a bounded sample of labelled rows (``sample``, the rows whose ids hash lowest) shows to be typical of toxic texts.
Patterns vote on how many entries a text has, how densely, and whether it has none. Labels choose the voters and scale
the scores at the end; between, a generative label model is fitted to the votes alone, by expectation-maximisation from
a plain count of votes.

The model has a class prior, each voter's rate in either class (its accuracy), and the correlations of voters within the
classes, all estimated from the votes; correlated voters share their evidence, so that many voters for one thing don't
count many times. A linear classifier is trained on the posterior labels and scores every text; slope and offset of its
scores are fitted to the sample's labels, so that they are probabilities.

Cases: null and empty texts have no votes but that of having no entry, and get the classifier's score for it;
rows with null or other labels than 0 and 1 teach nothing; repeated rows are scored each; an empty sample leaves
the seed list and a fixed prior; empty tables give no rows; other columns are ignored; long texts are searched in
stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm.common import fold, kept, scored, written
from rigscope.llm.quality import training_rows, training_texts

SEEDS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting imbecile idiota imbécile stupide dumm idiotisch basura estúpido ordure abschaum".split()
LETTERS = ~tn.mask((65, 90), (97, 122), (128, 255))
BEGINNINGS = (4, 5, 6, 7, 8)
MOST_ENTRIES = 20_000
MOST_VOTERS = 400
EXTRAS = 5
ROWS_A_BLOCK = 20_000
_TAG = {n: np.uint64((n * 0x9E3779B97F4A7C15) & (1 << 64) - 1) for n in (0, *BEGINNINGS)}


def units(data: np.ndarray, offs: np.ndarray):
    """Per kind (0: whole word, n: first n bytes): hashes, rows, starts, ends of the lower-cased words."""
    starts, ends, row = tn.words(data, offs, LETTERS)
    for n in (0, *BEGINNINGS):
        if n:
            long = ends - starts > n
            s, e, r = starts[long], starts[long] + n, row[long]
        else:
            s, e, r = starts, ends, row
        yield n, tn.span_hashes(data, s, e) ^ _TAG[n], r, s, e


def key(entry: bytes, n: int) -> int:
    data = np.frombuffer(entry, np.uint8)
    return int((tn.span_hashes(data, np.array([0]), np.array([len(data)])) ^ _TAG[n])[0])


def entries_of(data: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, entry and count of the entries in each row (``keys`` sorted), and the rows' numbers of words."""
    if len(offs) == 2 and len(data) > 4 * tn.SLICE_BYTES:
        parts = [_entries(data[a:b], np.array([0, b - a]), keys) for a, b in tn.stretches(data)]
        found, back = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        count = np.bincount(back.ravel(), weights=np.concatenate([p[2] for p in parts]), minlength=len(found)).astype(np.int64)
        return np.zeros(len(found), np.int64), found, count, np.sum([p[3] for p in parts], axis=0)
    return _entries(data, offs, keys)


def _entries(data: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(offs) - 1
    rows, found, n_words = [], [], np.zeros(n, np.int64)
    for kind, h, r, _, _ in units(data, offs):
        if not kind:
            n_words = np.bincount(r, minlength=n)
        if len(keys) and len(h):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            rows.append(r[hit])
            found.append(at[hit])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, n_words
    both, count = np.unique(np.concatenate(rows) * (len(keys) + 1) + np.concatenate(found), return_counts=True)
    return both // (len(keys) + 1), both % (len(keys) + 1), count, n_words


def features(n: int, row: np.ndarray, entry: np.ndarray, count: np.ndarray, n_words: np.ndarray, voters: int) -> np.ndarray:
    """Votes of the entries, then of the patterns: none, two or more, four or more, over 0.3 %, over 1 % of the words."""
    x = np.zeros((n, voters + EXTRAS), np.float32)
    x[row, entry] = 1
    hits = np.bincount(row, weights=count, minlength=n)
    kinds = np.bincount(row, minlength=n)
    share = hits / np.maximum(n_words, 1)
    for i, v in enumerate((hits == 0, hits >= 2, kinds >= 4, share > 0.003, share > 0.01)):
        x[:, voters + i] = v
    return x


def first_guess(x: np.ndarray) -> np.ndarray:
    """Posteriors to start from: by how many entries fire. Patterns are the last EXTRAS columns."""
    fired = x[:, :-EXTRAS].sum(axis=1)
    return np.where(fired == 0, 0.05, np.where(fired == 1, 0.6, 0.9))


def label_model(x: np.ndarray, start: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 of each row of votes, and the model: prior, rates (class x voter), correlations, weights.

    Correlations are those of what the classes leave unexplained of two voters' votes. A voter's evidence is divided by
    its design effect, one plus its correlations with the others (those over 0.1): k copies of a voter count as one.
    """
    q, x = np.clip(start.astype(np.float64), 0.05, 0.95), x.astype(np.float64)
    model: dict = {}
    for _ in range(rounds):
        prior = np.clip(q.mean(), 0.01, 0.99)
        rate1 = (q @ x + 0.5) / (q.sum() + 1)
        rate0 = ((1 - q) @ x + 0.5) / ((1 - q).sum() + 1)
        rest = (x - np.outer(q, rate1) - np.outer(1 - q, rate0)).astype(np.float32)
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / len(x) / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(axis=0))
        on, off = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
        logit = np.log(prior / (1 - prior)) + x @ (weight * on) + (1 - x) @ (weight * off)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        model = {"prior": prior, "rates": np.array([rate0, rate1]), "correlation": correlation, "weight": weight}
    return q, model


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    a = np.c_[x.astype(np.float64), np.ones(len(x))]
    w, pull = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (q - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def scaled(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into logits of the labels; none where these can't tell."""
    if not 0 < y.mean() < 1:
        return 1.0, 0.0
    (slope,), offset = linear(f[:, None], y, 1e-3)
    return (float(slope), offset) if slope > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", out_of: int = 3, held: int = 1, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> dict:
    usable = labels.where(fold(doc_id, out_of) != held)
    chosen = training_rows(docs, usable, label, sample, doc_id)
    rows = written(training_texts(docs, chosen, doc_id, text), "toxicity-sample")

    def toxic_units(batches):
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            for a, b in tn.slices(offs):
                d, o = tn.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
                for n, h, r, s, e in units(d, o):
                    order = np.lexsort((r, h))
                    h, r, s, e = h[order], r[order], s[order], e[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
                    _, first, count = np.unique(h[new], return_index=True, return_counts=True)
                    raw = d.tobytes()
                    spans = [raw[x:y] for x, y in zip(s[new][first].tolist(), e[new][first].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), n, np.int32)), pa.array(spans, pa.binary()), pa.array(count)], names=["kind", "entry", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([b - a], pa.int64())], names=["kind", "entry", "n"])

    counts = rows.where("label = 1").mapInArrow(toxic_units, "kind int, entry binary, n long").groupBy("kind", "entry").agg(F.sum("n").alias("n"))
    counts = counts.where("n >= 4").orderBy(F.col("n").desc(), "kind", "entry").limit(MOST_ENTRIES).toArrow().to_pylist()
    n_toxic = next((r["n"] for r in counts if r["kind"] == -1), 0)
    table = {(r["kind"], r["entry"]) for r in counts if r["kind"] >= 0 and r["n"] >= 0.005 * n_toxic} | {(0, w.encode()) for w in SEEDS}
    table = sorted(table)
    at = sorted((key(e, n), n, e) for n, e in table)
    keys = np.array([k for k, _, _ in at], np.uint64)

    def counted(batches):
        n = np.zeros((2, len(at)), np.int64)
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            label = batch.column(0).to_numpy()
            for a, b in tn.slices(offs):
                row, entry, _, _ = entries_of(tn.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], keys)
                np.add.at(n, (label[a:b][row], entry), 1)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])

    in0, in1 = np.zeros((2, len(at)))
    for r in rows.mapInArrow(counted, "n binary").collect():  # a row for each task of the sample
        n = np.frombuffer(r["n"], np.int64).reshape(2, -1)
        in0, in1 = in0 + n[0], in1 + n[1]
    by_label = dict(rows.groupBy("label").count().collect())
    n0, n1 = by_label.get(0, 0), by_label.get(1, 0)
    ratio = (in1 + 0.1) / max(n1, 1) / ((in0 + 0.5) / max(n0, 1))
    good = [i for i in range(len(at)) if ratio[i] >= 40 and in1[i] >= max(4, 0.01 * n1)]
    kept: list[int] = []
    have: set[bytes] = set()
    for i in sorted(good, key=lambda i: (at[i][1] or 99, -in1[i], at[i][2])):  # short beginnings stand for what begins with them
        if not any(at[i][2][:n] in have for n in range(1, len(at[i][2]))):
            kept.append(i)
            if at[i][1]:
                have.add(at[i][2])
    kept = sorted(kept, key=lambda i: -in1[i])[:MOST_VOTERS]
    seeds = [i for i in range(len(at)) if at[i][1] == 0 and at[i][2].decode() in SEEDS and i not in kept]
    voters = keys[np.array(sorted({*kept, *seeds}), np.int64)]
    if not n0 + n1:
        return {"keys": voters, "w": np.r_[np.full(len(voters), 4.0), np.zeros(EXTRAS)], "b": -2.0}

    def voted(batches):
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            for a, b in tn.slices(offs, rows=ROWS_A_BLOCK):
                x = features(b - a, *entries_of(tn.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], voters), len(voters))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.packbits(v > 0).tobytes() for v in x], pa.binary())], names=["label", "votes"])

    got = sorted((r["label"], r["votes"]) for r in rows.mapInArrow(voted, "label int, votes binary").toArrow().to_pylist())  # a bit a voter and row of the sample
    x = np.unpackbits(np.frombuffer(b"".join(v for _, v in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(voters) + EXTRAS].astype(np.float32)
    w, b = linear(x, label_model(x, first_guess(x))[0])
    slope, offset = scaled(x @ w + b, np.array([label for label, _ in got], np.float64))
    w, b = w * slope, b * slope + offset
    return {"keys": voters, "w": w, "b": b}


def kernel(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    found = entries_of(tn.LOWER[data], offs, model["keys"])
    x = features(len(offs) - 1, *found, len(model["keys"]))
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ model["w"] + model["b"], -30, 30)))


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and score of every row."""
    return scored(docs, keep, text, kernel, model, ROWS_A_BLOCK).toDF(*keep, "score")


def accepted(docs: DataFrame, model: dict, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows that score less than ``threshold``."""
    return kept(docs, text, kernel, model, lambda s: s < threshold, ROWS_A_BLOCK)
