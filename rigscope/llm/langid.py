"""Operator 4: language identification by a bidirectional gated recurrent network over bytes.

The network reads the whole byte sequence of a text (letters, spaces and all else, ASCII in lower case) in both
directions and gives every byte position a distribution over the languages. A document's probabilities are the means
over all its positions.

A text is labelled in windows of ``WINDOW`` positions that run side by side, so that a task's memory depends on neither
the number nor the length of its texts. A direction enters a window with the state that it has gained from the
``CONTEXT`` bytes before it (behind it, for the way back); what lies further away has faded from a gated state. At a
text's own ends the state is zero. Windows know neither words nor characters: state is carried across both.

Training: backpropagation through time in numpy, with Adam, over windows of labelled rows, chosen in two steps: of each
language the ``rows`` whose ids hash lowest (ids alone are ranked), then of their whole texts the ``windows`` that hash
lowest. The weights are a few thousand numbers and are broadcast.

Cases: texts that are null or hold no letter are ``und`` with score 0, as is everything if no row has a label; rows
without id teach nothing; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm.common import BROADCAST_KEYS, fold

WINDOW, CONTEXT = 256, 32
TRAINING_WINDOW = 64
HIDDEN = 8
LOGITS = 1 << 21  # numbers kept at once while windows are labelled


def windows(offs: np.ndarray, size: int):
    """Windows of ``size`` positions over each text: start, end, first and last of its text, row."""
    count = -(-np.diff(offs) // size)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[row] + nth * size
    return start, np.minimum(start + size, offs[row + 1]), offs[row], offs[row + 1], row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights(classes: int, h: int, seed: int = 3) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}x"] = (g.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)  # by byte: update, reset, candidate
        p[f"{d}g"] = (g.standard_normal((h, 2 * h)) / np.sqrt(h)).astype(np.float32)
        p[f"{d}c"] = (g.standard_normal((h, h)) / np.sqrt(h)).astype(np.float32)
    p["o"] = (g.standard_normal((2 * h, classes)) * 0.3).astype(np.float32)
    p["bias"] = np.zeros(classes, np.float32)
    return p


def states(p: dict, d: str, data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, steps: int, keep: bool = False):
    """Yields the state of each sequence after each of ``steps`` bytes from ``at`` on (d: "f" onwards, "b" back).

    Places outside [first, last) leave a state as it is. With ``keep`` what the backward pass needs comes along.
    """
    h = p[f"{d}c"].shape[0]
    x_in, g_in, c_in = p[f"{d}x"], p[f"{d}g"], p[f"{d}c"]
    s = np.zeros((len(at), h), x_in.dtype)
    for t in range(steps):
        place = at + (t if d == "f" else -t)
        real = (place >= first) & (place < last)
        x = data[np.clip(place, 0, len(data) - 1)]
        a = x_in[x]
        g = sigmoid(a[:, : 2 * h] + s @ g_in)
        z, r = g[:, :h], g[:, h:]
        c = np.tanh(a[:, 2 * h :] + (r * s) @ c_in)
        new = s + z * (c - s)
        if not real.all():
            new[~real] = s[~real]
        yield (new, (x, real, s, z, r, c)) if keep else new
        s = new


def logits(p: dict, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position x window x class, for positions from ``start`` on; those beyond ``end`` mean nothing."""
    h, n = p["fc"].shape[0], int((end - start).max())
    y = np.empty((n, len(start), len(p["bias"])), p["o"].dtype)
    for t, s in enumerate(states(p, "f", data, start - CONTEXT, first, last, n + CONTEXT)):
        if t >= CONTEXT:
            np.add(s @ p["o"][:h], p["bias"], out=y[t - CONTEXT])
    for t, s in enumerate(states(p, "b", data, start + n - 1 + CONTEXT, first, last, n + CONTEXT)):
        if t >= CONTEXT:
            y[n - 1 - (t - CONTEXT)] += s @ p["o"][h:]
    return y


def softmax(y: np.ndarray) -> np.ndarray:
    y = np.exp(y - y.max(axis=-1, keepdims=True))
    y /= y.sum(axis=-1, keepdims=True)
    return y


def pooled(p: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x classes: means over all positions; zeros without any."""
    rows, classes = len(offs) - 1, len(p["bias"])
    total = np.zeros((rows, classes))
    data = tn.LOWER[data]
    start, end, first, last, row = windows(offs, WINDOW)
    order = np.argsort(start - end, kind="stable")  # windows of like length together
    most = max(64, LOGITS // (WINDOW * classes))
    for a in range(0, len(order), most):
        i = order[a : a + most]
        y = softmax(logits(p, data, start[i], end[i], first[i], last[i]))
        y[np.arange(len(y))[:, None] >= (end - start)[i][None, :]] = 0
        np.add.at(total, row[i], y.sum(axis=0))
    return total / np.maximum(np.diff(offs), 1)[:, None]


def gradients(p: dict, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over the windows' positions, and its gradients through time, context included."""
    h, n = p["fc"].shape[0], int((end - start).max())
    trace = {d: list(states(p, d, data, at, first, last, n + CONTEXT, keep=True)) for d, at in (("f", start - CONTEXT), ("b", start + n - 1 + CONTEXT))}
    both = np.concatenate([np.stack([s for s, _ in trace["f"][CONTEXT:]]), np.stack([s for s, _ in trace["b"][CONTEXT:]])[::-1]], axis=2)
    y = softmax(both @ p["o"] + p["bias"])
    real = np.arange(n)[:, None] < (end - start)[None, :]
    total = max(1, int(real.sum()))
    loss = -float((np.log(np.take_along_axis(y, label[None, :, None], axis=2)[:, :, 0] + 1e-9) * real).sum()) / total
    y[:, np.arange(len(start)), label] -= 1
    dy = y * (real[:, :, None] / y.dtype.type(total))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"], g["bias"] = np.einsum("tnh,tnc->hc", both, dy, optimize=True), dy.sum(axis=(0, 1))
    back = dy @ p["o"].T
    for d, part in (("f", back[:, :, :h]), ("b", back[::-1, :, h:])):
        ds, taken, pulls = np.zeros((len(start), h), y.dtype), [], []
        for t in range(n + CONTEXT - 1, -1, -1):
            x, live_at, s, z, r, c = trace[d][t][1]
            if t >= CONTEXT:
                ds = ds + part[t - CONTEXT]
            live = ds * live_at[:, None]
            dz, dc = live * (c - s) * z * (1 - z), live * z * (1 - c * c)
            drs = dc @ p[f"{d}c"].T
            gates = np.concatenate([dz, drs * s * r * (1 - r)], axis=1)
            g[f"{d}c"] += (r * s).T @ dc
            g[f"{d}g"] += s.T @ gates
            taken.append(x)
            pulls.append(np.concatenate([gates, dc], axis=1))
            ds = (ds - live) + live * (1 - z) + drs * r + gates @ p[f"{d}g"].T
        np.add.at(g[f"{d}x"], np.concatenate(taken), np.concatenate(pulls))
    return loss, g


def train(data: np.ndarray, spans: tuple[np.ndarray, ...], label: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = 300, batch: int = 192, rate: float = 0.03, seed: int = 9) -> dict:
    """Weights after ``steps`` of Adam over random batches of windows ``spans`` (start, end, first, last)."""
    p, g = start_weights(classes, hidden), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        i = g.integers(0, len(label), min(batch, len(label)))
        _, grad = gradients(p, data, *(x[i] for x in spans), label[i])
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, out_of: int = 4, held: int = 2, rows: int = 500, windows_a_language: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model, of at most ``rows`` rows and ``windows_a_language`` windows of each language."""
    i, t, name = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string")
    usable = docs.where(name.isNotNull() & t.isNotNull() & i.isNotNull() & (fold(doc_id, out_of) != held)).select(i.alias("i"), name.alias("lang"), t.alias("text"))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang").orderBy(*by))
    keys = usable.select("i", "lang").withColumn("n", rank(F.xxhash64("i"), "i")).where(F.col("n") <= rows).select("i", "lang").distinct()
    few = keys.count() <= BROADCAST_KEYS
    texts = usable.join(F.broadcast(keys) if few else keys, ["i", "lang"])

    def cut(batches):
        for b in batches:
            data, offs = tn.buffer_of(b.column(1))
            data = tn.LOWER[data]
            start, end, first, last, row = windows(offs, TRAINING_WINDOW)
            lo, hi = np.maximum(start - CONTEXT, first), np.minimum(end + CONTEXT, last)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()), pa.array(start - lo, pa.int64()), pa.array(end - lo, pa.int64())],
                names=["lang", "bytes", "start", "end"],
            )

    pieces = texts.select("lang", "text").mapInArrow(cut, "lang string, bytes binary, start bigint, end bigint").distinct()
    chosen = pieces.withColumn("n", rank(F.xxhash64("bytes", "start"), "bytes", "start", "end")).where(F.col("n") <= windows_a_language)
    got = sorted((r["lang"], bytes(r["bytes"]), r["start"], r["end"]) for r in chosen.select("lang", "bytes", "start", "end").toArrow().to_pylist())
    if not got:
        return {"langs": [], "p": None}
    known = sorted({r[0] for r in got})
    data, size = np.frombuffer(b"".join(r[1] for r in got), np.uint8), np.array([len(r[1]) for r in got])
    first = np.cumsum(size) - size
    spans = (first + np.array([r[2] for r in got]), first + np.array([r[3] for r in got]), first, first + size)
    number = {x: k for k, x in enumerate(known)}
    return {"langs": known, "p": train(data, spans, np.array([number[r[0]] for r in got]), len(known))}


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind, langs = dict(docs.dtypes)[doc_id], model["langs"]
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model["p"])

    def labelled(batches):
        p, names = shared.value, np.array([*langs, "und"], dtype=object)
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            parts = [pooled(p, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in tn.slices(offs)]
            q = np.concatenate(parts) if parts else np.zeros((0, len(langs)))
            best = np.where(letters, q.argmax(axis=1) if len(q) else 0, len(langs))
            score = np.where(best < len(langs), q.max(axis=1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(labelled, f"doc_id {kind}, lang_pred string, score double")
