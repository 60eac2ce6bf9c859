"""Operator 8: quality by nearest-neighbour voting in a latent-semantic space.

Terms are words (hashed to ``WORDS`` columns, damped counts times inverse document frequency), pairs of neighbouring
character classes, and words that repeat one before; the last two tell junk, whose words no other text has. A bounded
sample of labelled rows (``sample``, the rows whose ids hash lowest) gives the term weights and the latent space
(truncated singular vectors of the centred term matrix). The sample's vectors and labels are broadcast (sample x rank
numbers, a fixed size). Every document's vector is multiplied with all of them, block by block; the ``k`` nearest by
exact cosine (ties: the sample's order) vote with their similarity as weight.

Cases: null and empty texts have the zero vector, and get the share of good labels in the sample; rows with null
or other labels than 0 and 1 teach nothing; several labels of one id each count; repeated rows are scored each;
an empty sample scores everything 0.5; empty tables give no rows; other columns are ignored; long texts are counted in
stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm.common import fold, kept, scored

CLASSES = 64
PAIRS = CLASSES * CLASSES
WORDS = 4096
TERMS = PAIRS + 2 + WORDS
ROWS_A_BLOCK = 512
REPEAT_WEIGHT, WORD_WEIGHT = 0.6, 0.5


def _classes() -> np.ndarray:
    """Byte -> class: lower-case letters each; capitals in 4 groups; digits; frequent marks each; the rest."""
    c = np.full(256, 62, np.uint16)
    c[97:123] = np.arange(26)
    c[65:91] = 26 + np.arange(26) // 7
    c[48:58] = 30
    for i, b in enumerate(b" \n\t.,;:!?'\"()[]{}<>/\\|#$%&*-_=+@~`^"):
        c[b] = 31 + min(i, 29)
    c[128:192] = 61
    c[192:] = 63
    return c


_CLASS = _classes()


def term_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x TERMS: pairs of character classes, words that repeat the word before, words met before, words."""
    return _long_counts(data) if len(offs) == 2 and len(data) > 4 * tn.SLICE_BYTES else _counts(data, offs)


def _counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 1:
        c = _CLASS[data].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offs))
        same = row[1:] == row[:-1]
        out[:, :PAIRS] = np.bincount((row[:-1] * PAIRS + c[:-1] * CLASSES + c[1:])[same], minlength=n * PAIRS).reshape(n, PAIRS)
    low = tn.LOWER[data]
    starts, ends, row = tn.words(low, offs, tn.SPACED)
    h = tn.span_hashes(low, starts, ends)
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out[:, PAIRS] = np.bincount(row[1:][again], minlength=n)
    out[:, PAIRS + 1] = np.bincount(row, minlength=n) - np.bincount(tn.distinct(h, row)[1], minlength=n)
    out[:, PAIRS + 2 :] = np.bincount(row * WORDS + (h >> np.uint64(20)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    return out


def _long_counts(data: np.ndarray) -> np.ndarray:
    """The counts of one long text, stretch by stretch."""
    out, met, last = np.zeros((1, TERMS), np.float32), np.zeros(0, np.uint64), None
    for a, b in tn.stretches(data):
        piece = data[a:b]
        out += _counts(piece, np.array([0, b - a]))
        if a:
            out[0, int(_CLASS[data[a - 1]]) * CLASSES + int(_CLASS[data[a]])] += 1
        low = tn.LOWER[piece]
        starts, ends, _ = tn.words(low, np.array([0, len(low)]), tn.SPACED)
        h = tn.span_hashes(low, starts, ends)
        if len(h):
            out[0, PAIRS] += last == h[0]
            new = np.unique(h)
            out[0, PAIRS + 1] += np.isin(new, met).sum()
            met, last = np.union1d(met, new), h[-1]
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights of rows of counts; each kind of term has unit length before the kinds are weighted."""
    pairs, words = counts[:, :PAIRS], counts[:, PAIRS + 2 :]
    total = words.sum(axis=1, keepdims=True)
    shares = counts[:, PAIRS : PAIRS + 2] / np.maximum(total, 1)
    shares[:, 1] *= total[:, 0] > 20
    structure = unit(np.c_[unit(np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))), REPEAT_WEIGHT * shares])
    return np.c_[structure, WORD_WEIGHT * unit(np.log1p(words) * idf)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_basis(x: np.ndarray, mean: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """TERMS x rank: leading right singular vectors of x - mean, by subspace iteration."""
    y = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, len(x), x.shape[1]))).astype(np.float32)
    for _ in range(4):
        z = x @ y - mean @ y
        y = np.linalg.qr(x.T @ z - np.outer(mean, z.sum(axis=0)))[0]
    u = np.linalg.svd(x @ y - mean @ y, full_matrices=False)[2].T
    return (y @ u)[:, :rank].astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most ``sample`` usable labels: those whose ids hash lowest."""
    known = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)


def training_texts(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of the chosen rows; an id that several rows carry counts once, with the smallest of their texts."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", out_of: int = 5, held: int = 0, sample: int = 3000, rank: int = 96, k: int = 15, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The model: word weights, term means, basis, the sample's vectors and labels."""
    usable = labels.where(fold(doc_id, out_of) != held)
    chosen = training_rows(docs, usable, label, sample, doc_id)
    rows = training_texts(docs, chosen, doc_id, text)

    def counted(batches):
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            for a, b in tn.slices(offs, rows=ROWS_A_BLOCK):
                x = term_counts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                has = [np.flatnonzero(r) for r in x]  # what a row has of the terms: a few hundred numbers
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([c.astype(np.uint16).tobytes() for c in has], pa.binary()), pa.array([r[c].tobytes() for r, c in zip(x, has, strict=True)], pa.binary())], names=["label", "terms", "counts"])

    got = sorted((r["label"], r["terms"], r["counts"]) for r in rows.mapInArrow(counted, "label int, terms binary, counts binary").toArrow().to_pylist())
    if not got:
        return {"idf": np.ones(WORDS, np.float32), "mean": np.zeros(TERMS, np.float32), "basis": np.zeros((TERMS, 1), np.float32), "v": np.zeros((0, 1), np.float32), "y": np.zeros(0, np.float32), "k": k}
    has = [np.frombuffer(c, np.uint16).astype(np.int64) for _, c, _ in got]
    in_rows = np.bincount(np.concatenate([c[c >= PAIRS + 2] - PAIRS - 2 for c in has]), minlength=WORDS)
    idf = (np.log((1 + len(got)) / (1 + in_rows)) + 1).astype(np.float32)
    x = np.zeros((len(got), TERMS), np.float32)
    for a in range(0, len(got), ROWS_A_BLOCK):
        part = slice(a, a + ROWS_A_BLOCK)
        for i, (_, _, n) in enumerate(got[part]):
            x[a + i, has[a + i]] = np.frombuffer(n, np.float32)
        x[part] = weighted(x[part], idf)
    mean, y = x.mean(axis=0), np.array([r[0] for r in got], np.float32)
    basis = latent_basis(x, mean, rank)
    return {"idf": idf, "mean": mean, "basis": basis, "v": unit(x @ basis - mean @ basis), "y": y, "k": k}


def vote(model: dict, x: np.ndarray, empty: np.ndarray, k: int, sharpness: float = 8.0) -> np.ndarray:
    """Scores of rows of weighted terms."""
    v, y = model["v"], model["y"]
    if not len(y):
        return np.full(len(x), 0.5)
    cos = unit(x @ model["basis"] - model["mean"] @ model["basis"]) @ v.T
    k = min(k, len(y))
    least = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    above, level = cos > least, cos == least
    chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    weight = np.where(chosen, np.maximum(cos, 1e-6) ** sharpness, 0)
    score = (weight @ y) / weight.sum(axis=1)
    score[empty] = y.mean()
    return np.clip(score.astype(np.float64), 0.0, 1.0)


def kernel(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return vote(model, weighted(term_counts(data, offs), model["idf"]), np.diff(offs) < 2, model["k"])


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and score of every row."""
    return scored(docs, keep, text, kernel, model, ROWS_A_BLOCK).toDF(*keep, "score")


def accepted(docs: DataFrame, model: dict, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more."""
    return kept(docs, text, kernel, model, lambda s: s >= threshold, ROWS_A_BLOCK)
