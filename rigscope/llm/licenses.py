"""Operator 6: license scans by winnowed fingerprints, an inverted index, and banded alignment.

Texts and templates (whole licenses, the headers of longer ones, short notices) are sequences of lower-cased
alphanumeric words. Of every ``window`` neighbouring k-word hashes of a template the smallest is its fingerprint
(rightmost on ties), so that any shared run of window + k - 1 words shares one; the inverted index maps fingerprints
to (template, place) and is broadcast: its size is that of the templates and is checked. Fingerprints found in a text
lay a template along it at an offset. No alignment in the band around an offset matches more than the template's words
that stand somewhere in that band, so offsets with too few of these end there; for the others, unless a span already
reported holds them, the words outside these spans are aligned within the band (match 2, mismatch and gap -1; of equal
scores the first cell, and a pair before a gap), many texts and offsets at a time. Reported are the matched share of the
template's words and the spans in words and bytes.

Cases: null, empty and short texts match nothing; templates of fewer than k words are one fingerprint each;
templates without id or words are none; repeated rows are reported each; empty tables give no rows; other columns
are ignored. A text with a template twice is reported twice; long texts are hashed in stretches.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.llm import textnp as tn
from rigscope.llm.license_texts import BODIES, NOTICES

K, WINDOW, BAND = 3, 3, 8
MOST_INDEX = 1_000_000
ALIGNED_AT_ONCE = 512
CELLS_AT_ONCE = 1_000_000


def notices(spark: SparkSession) -> DataFrame:
    """The short notices alone."""
    return spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")


def templates(spark: SparkSession) -> DataFrame:
    """Notices, headers and whole licenses."""
    return spark.createDataFrame(list((NOTICES | BODIES).items()), "template_id string, text string")


def word_hashes(data: np.ndarray, offs: np.ndarray):
    return tn.hashed_words(data, offs, tn.ALNUM)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = h[: len(h) - k + 1] * np.uint64(3)
    for j in range(1, k):
        s = tn.mix(s) + h[j : len(h) - k + 1 + j] * np.uint64(2 * j + 3)
    return tn.mix(s)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the winnowed hashes."""
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(v)) + window - 1 - np.argmin(v[:, ::-1], axis=1))


def align(a: np.ndarray, texts: list[np.ndarray], shifts: list[int], band: int) -> list[tuple[int, int, int]]:
    """Best local alignment of template a along each text b around b - a = shift: matched words, first and last word in b.

    Row by row of the template for all texts at once; the gaps along a row are a running maximum.
    """
    n, width, size = len(a), 2 * band + 1, len(texts)
    here = np.zeros((size, n + 2 * band), np.uint64)  # text words by place in the band
    real = np.zeros(here.shape, bool)
    for k, (b, shift) in enumerate(zip(texts, shifts, strict=True)):
        lo, hi = max(0, shift - band), min(len(b), shift + n + band)
        if lo < hi:
            here[k, lo - shift + band : hi - shift + band] = b[lo:hi]
            real[k, lo - shift + band : hi - shift + band] = True
    step = np.arange(width)
    score = np.zeros((n + 1, size, width + 2), np.int32)
    came = np.zeros((n + 1, size, width), np.int8)
    for i in range(1, n + 1):
        cells = slice(i - 1, i - 1 + width)
        pair = score[i - 1, :, 1:-1] + np.where(here[:, cells] == a[i - 1], 2, -1)
        gap = score[i - 1, :, 2:] - 1
        best = np.where(real[:, cells], np.maximum(np.maximum(pair, gap), 0), 0)
        best = np.where(real[:, cells], np.maximum.accumulate(best + step, axis=1) - step, 0)
        score[i, :, 1:-1] = best
        came[i] = np.where(best == 0, 0, np.where(best == pair, 1, np.where(best == gap, 2, 3)))
    flat = score[:, :, 1:-1].transpose(1, 0, 2).reshape(size, -1)
    top = flat.argmax(axis=1)
    i, c, k = top // width, top % width, np.arange(size)
    matched, last = np.zeros(size, np.int64), i + c - 1
    first = last.copy()
    live = flat[k, top] > 0
    none = ~live
    while live.any():
        kind = came[i[live], k[live], c[live]]
        on = k[live][kind > 0]
        live[k[live][kind == 0]] = False
        kind = came[i[on], on, c[on]]
        first[on] = i[on] + c[on] - 1
        matched[on] += (kind == 1) & (here[on, i[on] + c[on] - 1] == a[i[on] - 1])
        i[on] -= kind < 3
        c[on] += (kind == 2).astype(np.int64) - (kind == 3)
    shift = np.array(shifts, np.int64) - band
    return [(0, 0, 0) if none[x] else (int(matched[x]), int(first[x] + shift[x]), int(last[x] + shift[x])) for x in range(size)]


def hopeful(a: np.ndarray, b: np.ndarray, found: list[tuple[int, int]], least: float, band: int) -> list[tuple[int, int]]:
    """The (shift, place) whose band holds enough of the template's words: the others can't be matched to ``least``.

    An alignment pairs a template word with an equal word of its band, each template word once.
    """
    n = len(a)
    words, code = np.unique(a, return_inverse=True)
    kind = np.int16 if len(words) < 1 << 15 else np.int32
    code = code.astype(kind)
    shifts = np.unique([shift for shift, _ in found])
    lo, hi = int(shifts[0]) - band, int(shifts[-1]) + n + band
    here = np.full(hi - lo, -1, kind)
    part = b[max(lo, 0) : max(hi, 0)]
    at = np.minimum(np.searchsorted(words, part), len(words) - 1)
    here[max(-lo, 0) : max(-lo, 0) + len(part)] = np.where(words[at] == part, at, -1)
    view = np.lib.stride_tricks.sliding_window_view(here, n + 2 * band)
    kept: set[int] = set()
    for x in range(0, len(shifts), max(1, CELLS_AT_ONCE // n)):
        some = shifts[x : x + max(1, CELLS_AT_ONCE // n)]
        bands = view[some - shifts[0]]
        seen = np.zeros((len(some), n), bool)
        for t in range(2 * band + 1):
            seen |= bands[:, t : t + n] == code
        kept |= set(some[seen.sum(axis=1) >= least * n].tolist())
    return [f for f in found if f[0] in kept]


def occurrences(length: int, size: int, found: list[tuple[int, int]], least: float):
    """Spans (first, last, matched) of a template of ``length`` words in a text of ``size``, from (shift, place) of its
    fingerprints; spans never overlap. Asks for alignments: yields (lo, hi, shift) and is sent what ``align`` says,
    in places of the text.

    A fingerprint inside a span is explained by it; around any other one the words between the spans are aligned.
    """
    spans: list[tuple[int, int, int]] = []  # sorted
    vain: set[tuple[int, int, int]] = set()
    for shift, place in found:
        while True:
            i = bisect_right(spans, place, key=lambda x: x[0])
            if i and spans[i - 1][1] >= place:
                break
            lo, hi = spans[i - 1][1] + 1 if i else 0, spans[i][0] if i < len(spans) else size
            if (shift, lo, hi) in vain:
                break
            matched, first, last = yield lo, hi, shift
            if not matched or matched < least * length:
                vain.add((shift, lo, hi))
                break
            spans.insert(i, (first, last, matched))
    return spans


def spans_of(a: np.ndarray, texts: list[np.ndarray], found: list[list[tuple[int, int]]], least: float, band: int) -> list[list[tuple[int, int, int]]]:
    """The occurrences of template a in each text, from the sorted (shift, place) of its fingerprints.

    Alignments are made many at a time: those that texts wait for, and for the offsets that follow in these texts.
    One depends on its offset and the words in its band alone, so an offset asked for again between other spans is
    aligned anew only where a span cuts its band.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = [hopeful(a, b, f, least, band) if f else f for b, f in zip(texts, found, strict=True)]
    shifts = [sorted({shift for shift, _ in f}) for f in found]
    known: list[dict[tuple[int, int, int], tuple[int, int, int]]] = [{} for _ in texts]

    def banded(lo: int, hi: int, shift: int) -> tuple[int, int, int]:
        return max(lo, shift - band), min(hi, shift + len(a) + band), shift

    waiting = [(k, occurrences(len(a), len(b), f, least), None) for k, (b, f) in enumerate(zip(texts, found, strict=True))]
    while waiting:
        asked, stuck = [], []
        ahead = ALIGNED_AT_ONCE // len(waiting)
        for k, run, answer in waiting:
            try:
                while (w := banded(*run.send(answer))) in known[k]:
                    answer = known[k][w]
            except StopIteration as end:
                out[k] = end.value
                continue
            stuck.append((k, run, w))
            at = bisect_right(shifts[k], w[2])
            asked += [(k, x) for x in dict.fromkeys([w, *(banded(0, len(texts[k]), s) for s in shifts[k][at : at + ahead])]) if x not in known[k]]
        for x in range(0, len(asked), ALIGNED_AT_ONCE):
            part = asked[x : x + ALIGNED_AT_ONCE]
            answers = align(a, [texts[k][lo:hi] for k, (lo, hi, _) in part], [shift - lo for _, (lo, _, shift) in part], band)
            for (k, w), (matched, first, last) in zip(part, answers, strict=True):
                known[k][w] = matched, first + w[0], last + w[0]
        waiting = [(k, run, known[k][w]) for k, run, w in stuck]
    return out


def scan(docs: DataFrame, templates: DataFrame, least: float = 0.6, doc_id: str = "doc_id", text: str = "text", template_id: str = "template_id", template_text: str = "text") -> DataFrame:
    """doc_id, template_id, coverage, matched_words, first_word, last_word, first_byte, end_byte of each match."""
    kind = dict(docs.dtypes)[doc_id]
    listed = templates.select(F.col(f"`{template_id}`").cast("string").alias("i"), F.col(f"`{template_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    told = sorted((r["i"], r["t"]) for r in listed.limit(MOST_INDEX + 1).collect())
    if len(told) > MOST_INDEX:
        raise ValueError(f"more than {MOST_INDEX} templates")
    index: list[tuple[int, int, int]] = []
    sequences: list[np.ndarray] = []
    for n, (_, t) in enumerate(told):
        raw = np.frombuffer(t.encode(), np.uint8)
        h = word_hashes(raw, np.array([0, len(raw)]))[0]
        sequences.append(h)
        g = grams(h, min(K, len(h))) if len(h) else np.zeros(0, np.uint64)
        index += [(int(g[p]), n, int(p)) for p in winnow(g, WINDOW)]
    short = sorted({len(s) for s in sequences if 0 < len(s) < K})
    if len(index) > MOST_INDEX:
        raise ValueError(f"the templates have more than {MOST_INDEX} fingerprints")
    index.sort()
    shared = docs.sparkSession.sparkContext.broadcast((np.array([k for k, _, _ in index], np.uint64), [(n, p) for _, n, p in index], sequences, [i for i, _ in told]))

    def matches(batches):
        keys, places, seqs, ids = shared.value
        uniq = np.unique(keys)
        for batch in batches:
            data, offs = tn.buffer_of(batch.column(1))
            rows: list[tuple] = []
            for a, b in tn.slices(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                h, starts, ends, row = word_hashes(part, o)
                hits = []
                for k in (*short, K):
                    g = grams(h, k)
                    if len(g) and len(uniq):
                        at = np.flatnonzero(uniq[np.minimum(np.searchsorted(uniq, g), len(uniq) - 1)] == g)
                        at = at[row[at] == row[at + k - 1]]
                        hits += [(p, int(x)) for p, x in zip(at.tolist(), g[at].tolist(), strict=True)]
                cands: dict[tuple[int, int], list[int]] = {}
                values = np.array([x for _, x in hits], np.uint64)
                for (p, _), lo, hi in zip(hits, np.searchsorted(keys, values).tolist(), np.searchsorted(keys, values, side="right").tolist(), strict=True):
                    for n, q in places[lo:hi]:
                        cands.setdefault((int(row[p]), n), []).append((p - q, p))
                by_template: dict[int, list[int]] = {}
                for r, n in cands:
                    by_template.setdefault(n, []).append(r)
                for n, of in by_template.items():
                    edges = [np.searchsorted(row, [r, r + 1]).tolist() for r in of]
                    found = [sorted((s - lo, p - lo) for s, p in set(cands[r, n])) for r, (lo, _) in zip(of, edges, strict=True)]
                    for r, (lo, _), spans in zip(of, edges, spans_of(seqs[n], [h[lo:hi] for lo, hi in edges], found, least, BAND), strict=True):
                        rows += [(a + r, n, matched / len(seqs[n]), matched, first, last, int(starts[lo + first] - o[r]), int(ends[lo + last] - o[r])) for first, last, matched in spans]
            rows = sorted(set(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([ids[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3, 8))],
                names=["doc_id", "template_id", "coverage", "matched_words", "first_word", "last_word", "first_byte", "end_byte"],
            )

    schema = f"doc_id {kind}, template_id string, coverage double, matched_words bigint, first_word bigint, last_word bigint, first_byte bigint, end_byte bigint"
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(matches, schema)
